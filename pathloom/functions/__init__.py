"""Functions on paths and sets."""
