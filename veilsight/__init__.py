"""Sensitive-data discovery over Spark DataFrames."""
