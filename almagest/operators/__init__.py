"""Joins, corrections and statistics on catalogs and query points."""
