"""Relational operators on event tables, and functions applied to subjects."""
