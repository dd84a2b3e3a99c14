"""Relational forms of the key-value store's operators."""
