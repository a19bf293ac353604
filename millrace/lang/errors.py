"""Errors with a place in the source text."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass
class QueryError(Exception):
    """line counts from 1, column from 0; start and stop are offsets into the text."""

    message: str
    line: int | None = None
    column: int | None = None
    start: int | None = None
    stop: int | None = None

    def __str__(self) -> str:
        return self.message if self.line is None else f"{self.message} (line {self.line}, column {self.column})"


def at(message: str, text: str, start: int, stop: int) -> QueryError:
    line = text.count("\n", 0, start) + 1
    return QueryError(message, line, start - (text.rfind("\n", 0, start) + 1), start, stop)
