"""Operators for preparing training text, and their named queries."""
