"""Expressions: predicates over keys, documents' fields, encryption."""
