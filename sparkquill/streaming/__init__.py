"""Incremental maintenance and change streams."""
