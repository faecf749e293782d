"""Scans (files -> rows) and parsers (rows -> documents / annotations)."""
