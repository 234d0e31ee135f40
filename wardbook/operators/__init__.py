"""Relational operators over clinic tables."""
