"""Readers: timed text in several formats, recogniser output, audio files."""
