"""Streams into segments."""
