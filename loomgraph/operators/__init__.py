"""Relational operators of the content graph."""
