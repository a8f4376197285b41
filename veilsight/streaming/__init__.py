"""Structured Streaming forms of the log and change-feed passes."""
