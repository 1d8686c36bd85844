"""Queries: each operator applied to tables, with its SQL."""
