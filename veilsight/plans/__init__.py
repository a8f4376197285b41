"""Whole passes, from a source to findings."""
