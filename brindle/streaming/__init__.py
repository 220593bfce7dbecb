"""Structured Streaming forms of the distributions."""
