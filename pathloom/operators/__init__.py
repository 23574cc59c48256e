"""Spaces and pattern queries."""
