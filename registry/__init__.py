"""Registered queries over the given tables, each next to its reference SQL."""
