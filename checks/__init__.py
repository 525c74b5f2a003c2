"""Registered queries, their SQL, and the inputs both derive from the given tables."""
