"""Operators that run on streams."""
