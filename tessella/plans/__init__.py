"""Queries over the stored tables, by theme."""
