"""Queries as values."""
