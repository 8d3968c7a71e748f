"""Registered queries: each binds operators to the given tables."""
