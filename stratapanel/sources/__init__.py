"""Readers, writers, the parquet cache and the parsers of text sources."""
