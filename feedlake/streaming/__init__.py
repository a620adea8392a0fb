"""Structured Streaming forms of the log jobs and of feed ingest."""
