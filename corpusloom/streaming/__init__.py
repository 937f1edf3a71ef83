"""Incremental ingestion and windows over event streams."""
