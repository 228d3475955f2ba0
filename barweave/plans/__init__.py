"""Queries with their oracles."""
