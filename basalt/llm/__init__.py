"""Operators for preparing training text and code; nothing else in the package imports them."""
