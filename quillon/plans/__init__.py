"""Queries over the canonical tables."""
