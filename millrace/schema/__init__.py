"""Portable schemas, their differences, and row-level security."""
