"""Incremental index building by Structured Streaming."""
