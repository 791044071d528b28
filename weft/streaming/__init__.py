"""Structured Streaming versions of the incremental statistics."""
