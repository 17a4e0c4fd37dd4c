"""Operators over files, sections, postings, links and logs."""
