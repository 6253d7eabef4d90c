"""Whole reports and the ingest-and-merge flow."""
