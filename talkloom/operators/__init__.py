"""Operators on conversations, chunks, clusters and series."""
