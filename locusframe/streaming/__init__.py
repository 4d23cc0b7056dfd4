"""Structured Streaming forms of the shuffle-free operators."""
