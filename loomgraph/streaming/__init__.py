"""Incremental collection as Structured Streaming."""
