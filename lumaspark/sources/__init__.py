"""Readers and writers. Every reader states its schema; nothing is inferred."""
