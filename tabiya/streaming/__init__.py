"""Structured Streaming forms of operators that make sense while data arrive."""
