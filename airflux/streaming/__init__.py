"""Structured Streaming forms of the hourly aggregate and of islands."""
