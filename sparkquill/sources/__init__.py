"""Scans and sinks: tables, folders of notes, PDF text, registries, logs, transcripts, graph documents."""
