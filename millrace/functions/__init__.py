"""Scalar functions of the query language and of the change mappings."""
