"""Incremental shift statistics."""
