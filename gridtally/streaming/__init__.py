"""Ingest as a stream of files."""
