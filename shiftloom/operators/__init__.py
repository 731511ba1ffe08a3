"""Operators on long sensor tables and feature tables."""
