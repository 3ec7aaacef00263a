"""Readers, writers and table-level jobs at the edges of the pipeline."""
