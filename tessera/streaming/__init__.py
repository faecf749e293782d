"""Structured Streaming versions of the corpus jobs."""
