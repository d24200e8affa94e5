"""Incremental ingest and capture-rate windows."""
