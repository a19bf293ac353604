"""Queries written in Python."""
