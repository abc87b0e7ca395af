"""Filters and scorers."""
