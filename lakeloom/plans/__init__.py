"""Registered queries over lake tables."""
