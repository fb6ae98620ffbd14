"""Registered queries: each operator run over the given tables, beside the same question in SQL."""
