"""Segments and record logs."""
