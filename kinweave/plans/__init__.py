"""Composite plans: graph builders, search, online maintenance, partitioners, and the query registry."""
