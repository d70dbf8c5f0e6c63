"""Packers that build documents of the format from values; for tests, queries and export."""
