"""Recursion and worked programs."""
