"""Operators on nodes, links and clusters."""
