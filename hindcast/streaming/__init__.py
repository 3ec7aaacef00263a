"""Structured Streaming twins of the append-only logs."""
