"""Appending streams to an index."""
