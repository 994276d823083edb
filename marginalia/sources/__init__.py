"""Readers and writers: corpus folders, JSON state, logs, article pages, parquet tables."""
