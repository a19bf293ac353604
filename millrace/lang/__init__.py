"""The pipeline language: text to a typed tree."""

from millrace.lang.errors import QueryError
from millrace.lang.parser import parse

__all__ = ["QueryError", "parse"]
