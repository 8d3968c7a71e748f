"""Readers for decoded evidence and writers for results."""
