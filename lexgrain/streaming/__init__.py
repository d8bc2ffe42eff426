"""Structured Streaming: incremental indexing and the event log."""
