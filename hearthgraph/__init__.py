"""Listing resolution, history, scoring and search as Spark DataFrame operators."""
