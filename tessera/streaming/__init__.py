"""Structured Streaming forms of the request log analytics."""
