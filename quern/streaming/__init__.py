"""Indexing of streams."""
