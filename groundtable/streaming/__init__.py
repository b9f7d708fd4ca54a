"""Structured Streaming forms of the log and corpus operators."""
