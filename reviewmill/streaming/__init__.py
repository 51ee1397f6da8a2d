"""Continuous ingest, de-duplication and rating series."""
