"""Spark jobs for large tables of two-sided contests."""
