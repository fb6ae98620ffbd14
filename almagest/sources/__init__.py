"""Readers and writers for catalogs, tiles and query points."""
