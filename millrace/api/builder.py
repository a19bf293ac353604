"""A fluent query over the same blocks that text makes."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from typing import Any

from pyspark.sql import DataFrame

from millrace.api.predicates import Predicate, col, node
from millrace.lang import tree as t
from millrace.plans.block import Block, Join, Source


class Query:
    """Immutable: every method returns a new query. ``where`` takes (column, operator, value), a Predicate, or a function
    of a row; and_where and or_where go on from it with AND binding tighter than OR."""

    def __init__(self, table: str | Block, alias: str | None = None, engine: Any = None, _tests: tuple = ()):
        self._block = table if isinstance(table, Block) else Block(Source(alias or table.split(".")[-1], table=table))
        self._engine, self._tests = engine, _tests

    def _with(self, _tests: tuple | None = None, **changes: Any) -> Query:
        return Query(replace(self._block, **changes), engine=self._engine, _tests=self._tests if _tests is None else _tests)

    # Columns.
    def select(self, *columns: str | Predicate | t.Node) -> Query:
        return self._with(select=tuple(node(c) for c in columns))

    def select_all(self) -> Query:
        return self._with(select=(t.Star(),))

    def distinct(self) -> Query:
        return self._with(distinct=True)

    # Conditions.
    def where(self, column: str | Predicate | Callable, op: str | None = None, value: Any = None) -> Query:
        return self._with(_tests=(*self._tests, ("and", _test(column, op, value))))

    and_where = where

    def or_where(self, column: str | Predicate | Callable, op: str | None = None, value: Any = None) -> Query:
        return self._with(_tests=(*self._tests, ("or", _test(column, op, value))))

    # Joins.
    def join(self, table: str, left: str, right: str, how: str = "inner", alias: str | None = None) -> Query:
        on = t.Binary("=", node(left), node(right))
        return self._with(joins=(*self._block.joins, Join(how, Source(alias or table.split(".")[-1], table=table), on)))

    def left_join(self, table: str, left: str, right: str, alias: str | None = None) -> Query:
        return self.join(table, left, right, "left", alias)

    # Groups, order, pages.
    def group_by(self, *columns: str | t.Node) -> Query:
        return self._with(group_by=(*self._block.group_by, *map(node, columns)))

    def having(self, test: Predicate) -> Query:
        return self._with(having=test.node)

    def order_by(self, *columns: str | t.Node) -> Query:
        return self._with(order_by=(*self._block.order_by, *(t.Sort(node(c)) for c in columns)))

    def order_by_descending(self, *columns: str | t.Node) -> Query:
        return self._with(order_by=(*self._block.order_by, *(t.Sort(node(c), True) for c in columns)))

    then_by, then_by_descending = order_by, order_by_descending

    def take(self, n: int) -> Query:
        return self._with(limit=t.Literal(n))

    def skip(self, n: int) -> Query:
        return self._with(offset=t.Literal(n))

    def union(self, other: Query, all: bool = False) -> Query:
        return self._with(sets=(*self._block.sets, ("UNION ALL" if all else "UNION", other.build())))

    # Results.
    def build(self) -> Block:
        groups: list[list[t.Node]] = []
        for how, test in self._tests:
            if how == "or" or not groups:
                groups.append([test])
            else:
                groups[-1].append(test)
        parts = [g[0] if len(g) == 1 else t.Junction("and", tuple(g)) for g in groups]
        where = () if not parts else (parts[0],) if len(parts) == 1 else (t.Junction("or", tuple(parts)),)
        return replace(self._block, where=(*self._block.where, *where))

    def rows(self, params: dict[str, Any] | None = None) -> DataFrame:
        if self._engine is None:
            raise ValueError("a query without an engine has no rows; make it with engine.from_()")
        return self._engine.run(self.build(), params)

    def sql(self, dialect: str = "spark") -> str:
        from millrace.plans.render import Renderer

        return Renderer(dialect).statement(self.build())


def _test(column: str | Predicate | Callable, op: str | None, value: Any) -> t.Node:
    if isinstance(column, Predicate):
        return column.node
    if callable(column):
        return column(_Row()).node
    return col(column).compare(op or "=", value).node


class _Row:
    """Stands for a row in a function given to where(): its attributes are columns."""

    def __getattr__(self, name: str) -> Predicate:
        return col(name)
