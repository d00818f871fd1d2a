"""Operators on training corpora; nothing outside this package imports it."""
