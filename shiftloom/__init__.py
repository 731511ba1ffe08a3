"""Shift analytics for process sensors on Spark."""
