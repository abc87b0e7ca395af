"""Analyzers and scalar functions."""
