"""Structured Streaming: stateful deduplication, the ingest pipeline, publishing, delivery, metrics."""
