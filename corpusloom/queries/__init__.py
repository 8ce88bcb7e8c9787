"""Registered queries by topic: each module has QUERIES and SQL."""
