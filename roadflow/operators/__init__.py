"""Relational operators built from DataFrame transformations."""
