"""Relational operators on imaging tables."""
