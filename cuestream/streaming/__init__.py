"""Structured Streaming jobs; every column transform also runs on batch tables."""
