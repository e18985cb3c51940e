"""Structured Streaming forms of the daily statistics (an extension)."""
