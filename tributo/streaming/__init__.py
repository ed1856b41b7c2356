"""Incremental forms of ingestion and of metrics."""
