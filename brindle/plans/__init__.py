"""Queries over the star schema and the event stream."""
