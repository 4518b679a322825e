"""Partition transforms and hashes."""
