"""Operators over the tables of an archive."""
