"""Incremental operators over Structured Streaming."""
