"""Operators for preparing large text, vector and web corpora; nothing else in the library imports them."""
