"""Relational operators over vector tables."""
