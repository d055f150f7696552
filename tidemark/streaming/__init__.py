"""Structured Streaming forms of append, tail and materialise."""
