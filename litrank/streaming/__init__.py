"""Structured Streaming jobs over arriving dump files."""
