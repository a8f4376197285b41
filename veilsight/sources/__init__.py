"""Readers that turn tables, JSON, logs and files into text units."""
