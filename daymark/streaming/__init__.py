"""Structured Streaming versions of the hourly ingest steps."""
