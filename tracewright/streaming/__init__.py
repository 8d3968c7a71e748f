"""Structured Streaming jobs over live run logs."""
