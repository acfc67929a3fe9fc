"""Readers for catalogs, article dumps, saved API responses and stored tables."""
