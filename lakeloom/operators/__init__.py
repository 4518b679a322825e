"""Writes, changes, feeds and maintenance of lake tables."""
