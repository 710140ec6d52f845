"""Readers for landed extracts and stored tables."""
