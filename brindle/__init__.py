"""Queries and data processing as Spark jobs."""
