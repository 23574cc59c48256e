"""Operators that prepare training data; nothing outside imports them."""
