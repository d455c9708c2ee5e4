"""Structured Streaming forms of the append-only logs."""
