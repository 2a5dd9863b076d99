"""Structured Streaming forms of the tape operators."""
