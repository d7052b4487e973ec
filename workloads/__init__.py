"""Panels derived from the star-schema test tables, the queries over them and their SQL checks."""
