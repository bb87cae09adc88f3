"""Relational operators over catalogs."""
