"""Structured Streaming forms of the resumable and latest-state operators."""
