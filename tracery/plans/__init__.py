"""Operators bound to the star-schema tables."""
