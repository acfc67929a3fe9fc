"""Composite plans: batch ranking (B1), article lists and JSON (O1), offline jobs."""
