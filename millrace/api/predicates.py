"""Expressions and predicates as Python values."""

from __future__ import annotations

import datetime as dt
from functools import reduce
from typing import Any

from millrace.lang import tree as t


class Predicate:
    """An expression; comparisons, &, | and ~ combine it. Comparing with None tests for null."""

    __hash__ = None  # type: ignore[assignment]

    def __init__(self, node: t.Node):
        self.node = node

    def compare(self, op: str, value: Any) -> Predicate:
        op = {"==": "=", "<>": "!="}.get(op.lower(), op.lower())
        if op in ("is null", "is not null"):
            return Predicate(t.IsNull(self.node, op == "is not null"))
        if op in ("in", "not in"):
            made = self.isin(*value)
            return ~made if op == "not in" else made
        if value is None and op in ("=", "!="):
            return Predicate(t.IsNull(self.node, op == "!="))
        if op not in ("=", "!=", "<", "<=", ">", ">=", "like"):
            raise ValueError(f"unknown operator: {op}")
        return Predicate(t.Binary(op, self.node, node(value, literal=True)))

    def __eq__(self, other: object) -> Predicate:  # type: ignore[override]
        return self.compare("=", other)

    def __ne__(self, other: object) -> Predicate:  # type: ignore[override]
        return self.compare("!=", other)

    def __lt__(self, other: Any) -> Predicate:
        return self.compare("<", other)

    def __le__(self, other: Any) -> Predicate:
        return self.compare("<=", other)

    def __gt__(self, other: Any) -> Predicate:
        return self.compare(">", other)

    def __ge__(self, other: Any) -> Predicate:
        return self.compare(">=", other)

    def _arithmetic(self, op: str, other: Any) -> Predicate:
        return Predicate(t.Binary(op, self.node, node(other, literal=True)))

    def __add__(self, other: Any) -> Predicate:
        return self._arithmetic("+", other)

    def __sub__(self, other: Any) -> Predicate:
        return self._arithmetic("-", other)

    def __mul__(self, other: Any) -> Predicate:
        return self._arithmetic("*", other)

    def __truediv__(self, other: Any) -> Predicate:
        return self._arithmetic("/", other)

    def __mod__(self, other: Any) -> Predicate:
        return self._arithmetic("%", other)

    def __and__(self, other: Predicate) -> Predicate:
        if TRUE_NODE in (self.node, other.node):
            return other if self.node == TRUE_NODE else self
        return Predicate(t.Junction("and", (self.node, other.node)))

    def __or__(self, other: Predicate) -> Predicate:
        if FALSE_NODE in (self.node, other.node):
            return other if self.node == FALSE_NODE else self
        return Predicate(t.Junction("or", (self.node, other.node)))

    def __invert__(self) -> Predicate:
        return Predicate(t.Not(self.node))

    def isin(self, *values: Any) -> Predicate:
        """Membership; among nothing it is false."""
        return Predicate(t.Among(self.node, tuple(node(v, literal=True) for v in values))) if values else never()

    def between(self, low: Any, high: Any) -> Predicate:
        return Predicate(t.Between(self.node, node(low, literal=True), node(high, literal=True)))

    def like(self, pattern: str) -> Predicate:
        return self.compare("like", pattern)

    def contains(self, text: str) -> Predicate:
        """Holds the text as it is: % and _ in it are no wildcards."""
        return Predicate(t.Binary(">", t.Call("instr", (self.node, t.Literal(text))), t.Literal(0)))

    def startswith(self, text: str) -> Predicate:
        return Predicate(t.Binary("=", t.Call("substring", (self.node, t.Literal(1), t.Literal(len(text)))), t.Literal(text)))

    def alias(self, name: str) -> t.Node:
        return t.Aliased(self.node, name)


TRUE_NODE, FALSE_NODE = t.Literal(True), t.Literal(False)


def always() -> Predicate:
    return Predicate(TRUE_NODE)


def never() -> Predicate:
    return Predicate(FALSE_NODE)


def col(name: str) -> Predicate:
    return Predicate(t.Name(tuple(name.split("."))))


def call(name: str, *args: Any, distinct: bool = False) -> Predicate:
    return Predicate(t.Call(name, tuple(t.Star() if isinstance(a, str) and a == "*" else node(a) for a in args), distinct))


def param(name: str) -> Predicate:
    return Predicate(t.Param(name))


def all_of(*tests: Predicate) -> Predicate:
    return reduce(lambda a, b: a & b, tests, always())


def any_of(*tests: Predicate) -> Predicate:
    return reduce(lambda a, b: a | b, tests, never())


def node(value: Any, literal: bool = False) -> t.Node:
    """A tree for a Python value; strings are columns unless ``literal``."""
    if isinstance(value, Predicate):
        return value.node
    if isinstance(value, t.Node):
        return value
    if isinstance(value, str) and not literal:
        if value == "*":
            return t.Star()
        name, _, alias = value.partition(" as ")
        return t.Aliased(t.Name(tuple(name.strip().split("."))), alias.strip()) if alias else t.Name(tuple(value.split(".")))
    if isinstance(value, dt.datetime):
        return t.Call("timestamp_ntz" if value.tzinfo is None else "timestamp", (t.Literal(value.isoformat(" ")),))
    if isinstance(value, dt.date):
        return t.Call("date", (t.Literal(value.isoformat()),))
    return t.Literal(value)
