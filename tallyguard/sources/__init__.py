"""Readers, ingestion jobs and sinks."""
