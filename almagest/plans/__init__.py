"""Whole jobs: ingest, catalog layouts, experiments."""
