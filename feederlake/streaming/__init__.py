"""Incremental jobs: file ingestion and the operational sync."""
