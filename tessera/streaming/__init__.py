"""Structured Streaming forms of the log and index operators."""
