"""Row-level security: policies as conditions on reads and checks on writes."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.lang import tree as t
from millrace.lang.errors import QueryError
from millrace.lang.parser import parse
from millrace.plans.block import Block, Builder, Rows, rewrite
from millrace.plans.engine import Engine, statement_kind
from millrace.plans.render import Renderer
from millrace.schema.model import Policy

_SETTING = re.compile(r"current_setting\s*\(\s*'((?:[^'\\]|\\.)*)'\s*(?:,[^)]*)?\)\s*(?:::\s*([A-Za-z_]+))?")


class AccessDenied(Exception):
    def __init__(self, table: str, operation: str, policy: str):
        super().__init__(f"{operation} on {table} violates {policy}")


@dataclass(frozen=True)
class Who:
    """Who asks: the user, their roles, and the session's settings."""

    user: str | None
    roles: frozenset[str] = frozenset()
    settings: dict[str, Any] = field(default_factory=dict)


def _bound(text: str, who: Who) -> t.Node:
    """A policy's predicate with the user and the settings put in as values."""
    if len(re.findall(r"current_setting\s*\(", text)) != len(_SETTING.findall(text)):
        raise QueryError("current_setting takes one quoted name")

    def setting(m: re.Match) -> str:
        return f"__setting('{m[1]}', '{m[2] or ''}')"

    program = parse(f"x |> filter({_SETTING.sub(setting, text)})")
    tree = Builder(program).expression(program.result.steps[0].args[0], frozenset())

    def look(n: t.Node) -> t.Node | None:
        if isinstance(n, t.Call) and n.name.lower() == "current_user_id" and not n.args:
            return t.Literal(who.user)
        if isinstance(n, t.Call) and n.name == "__setting":
            value, kind = who.settings.get(n.args[0].value), n.args[1].value
            literal = t.Literal(None if value is None else str(value) if kind or not isinstance(value, bool | int | float) else value)
            return t.Call({"uuid": "string", "text": "string", "varchar": "string", "integer": "int", "numeric": "double"}.get(kind.lower(), kind.lower()), (literal,)) if kind else literal
        if isinstance(n, Rows):
            return Rows(_within(n.block, look))
        return None

    return rewrite(tree, look)


def _within(block: Block, look) -> Block:
    """The rewrite carried into a nested block."""
    return replace(block, where=tuple(rewrite(w, look) for w in block.where), having=None if block.having is None else rewrite(block.having, look), select=tuple(rewrite(s, look) for s in block.select))


def _predicate(policy: Policy, who: Who, checking: bool) -> str:
    """A policy's condition in SQL; given SQL goes before the query language, a check falls back on the reading condition."""
    sql = (policy.with_check_sql or policy.using_sql) if checking else policy.using_sql
    text = (policy.with_check or policy.using) if checking else policy.using
    if sql and not (checking and policy.with_check and not policy.with_check_sql):
        quoted = "NULL" if who.user is None else "'" + who.user.replace("'", "''") + "'"
        return f"({re.sub(r'current_user_id[(][)]', lambda _: quoted, sql)})"
    return f"({Renderer('spark').expr(_bound(text, who))})" if text else "TRUE"


def condition(policies: tuple[Policy, ...], who: Who, operation: str, checking: bool = False) -> str:
    """(any permissive) and (all restrictive) of the policies for an operation and the roles; without a permissive one, nothing passes."""
    own = [p for p in policies if {"all", operation} & set(p.operations) and (not p.roles or who.roles & set(p.roles))]
    permissive = [_predicate(p, who, checking) for p in own if p.permissive]
    restrictive = [_predicate(p, who, checking) for p in own if not p.permissive]
    return " AND ".join([f"({' OR '.join(permissive)})" if permissive else "FALSE", *restrictive])


def _reads(engine: Engine, policies: tuple[Policy, ...]) -> None:
    """Makes the tables that policies look into known to the session."""
    for p in policies:
        for text in (p.using, p.with_check):
            if text:
                program = parse(f"x |> filter({_SETTING.sub('1', text)})")
                for name in Builder(program).block(program.result).tables() - {"x"}:
                    engine.tables.provide(name)
        for text in (p.using_sql, p.with_check_sql):
            for name in engine.tables.mentioned(f"SELECT {text}") if text else ():
                engine.tables.provide(name)


def _select(engine: Engine, view: str, test: str) -> DataFrame:
    return engine.spark.sql(f"SELECT * FROM `{view}` WHERE {test}")


def secured(engine: Engine, table: str, policies: tuple[Policy, ...], who: Who, operation: str = "select") -> DataFrame:
    """The rows of a table that ``who`` may read (or change)."""
    _reads(engine, policies)
    engine.tables.provide(table)
    return _select(engine, table, condition(policies, who, operation))


class Secured(Engine):
    """An engine in a session of its own, whose tables with policies show what ``who`` may read.

    It knows the tables it was made with and no other name: the whole tables are in the first engine's session, the
    catalog and files by their path are refused. It runs queries, and INSERT, UPDATE and DELETE through execute(); rows
    that may not be written, changed or deleted raise AccessDenied and nothing is written.
    """

    def __init__(self, engine: Engine, policies: dict[str, tuple[Policy, ...]], who: Who):
        from millrace.sources.tables import Tables, adopted

        self.base, self.who, self._adopted = engine, who, adopted
        self.policies = {name.lower(): own for name, own in policies.items()}
        session = engine.spark.newSession()
        tables = Tables(session, None, engine.tables.format)
        tables.closed, tables.folder, tables.paths, tables.known = True, engine.tables.folder, dict(engine.tables.paths), dict(engine.tables.known)
        super().__init__(session, tables, engine.int_division)
        for name in self.policies:
            self._show(name)

    def _show(self, table: str) -> None:
        own = self.policies.get(table.lower())
        rows = self.base.tables.get(table) if own is None else secured(self.base, table, own, self.who)
        self.tables.register(table, self._adopted(rows, self.spark))

    def sql(self, text: str, params: dict[str, Any] | None = None) -> DataFrame:
        if statement_kind(text) not in ("select", "other") or re.match(r"\W*(?:create|drop|alter|insert|set|add|cache|refresh|load|use|reset|truncate|replace|merge|call|execute|declare|analyze|repair|msck|unset|uncache)\b", re.sub(r"--[^\n]*|/\*.*?\*/", " ", text, flags=re.S), re.I):
            raise QueryError("A secured engine runs queries; write with execute()")
        return super().sql(text, params)

    def _whole_table(self, table: str) -> DataFrame:
        return self._adopted(self.base.tables.get(table), self.spark)

    def _allow(self, table: str, operation: str, rows: DataFrame, new: bool) -> None:
        if own := self.policies.get(table.lower()):
            target = self.base.tables.get(table)
            if new and len(rows.columns) == len(target.columns) and {c.lower() for c in rows.columns} != {c.lower() for c in target.columns}:
                rows = rows.toDF(*target.columns)
            if missing := [c for c in target.columns if c.lower() not in {x.lower() for x in rows.columns}]:
                rows = rows.select("*", *[F.lit(None).cast(target.schema[c].dataType).alias(c) for c in missing])
            check_write(self.base, table, own, self.who, self._adopted(rows, self.base.spark), operation, new)

    def _insert(self, table: str, rows: DataFrame, by_name: bool) -> int:
        self._allow(table, "insert", rows, True)
        n = self.base.tables.append(table, self._adopted(rows, self.base.spark), by_name=by_name).count()
        self._show(table)
        return n

    def _replaced(self, table: str, rows: DataFrame, touched: DataFrame) -> int:
        n = touched.count()
        if n:
            self.base.tables.replace(table, self._adopted(rows, self.base.spark))
            self._show(table)
        return n


def secure(engine: Engine, policies: dict[str, tuple[Policy, ...]], who: Who) -> Secured:
    """An engine whose tables with policies show only what ``who`` may read; policies themselves look into whole tables."""
    return Secured(engine, policies, who)


def check_write(engine: Engine, table: str, policies: tuple[Policy, ...], who: Who, rows: DataFrame, operation: str, new: bool | None = None) -> DataFrame:
    """The rows, if all of them may be written (new rows of an insert or update) or touched (old ones of an update or
    delete); else AccessDenied. Without ``new``, rows of an insert or update are taken for new ones.

    One job looks for a single row that fails.
    """
    _reads(engine, policies)
    view = f"__checked_{table}"
    rows.createOrReplaceTempView(view)
    test = condition(policies, who, operation, checking=operation in ("insert", "update") if new is None else new)
    # Names qualified by the table mean the rows that are written.
    failing = engine.spark.sql(f"SELECT 1 FROM `{view}` AS `{table}` WHERE NOT coalesce(({test}), FALSE) LIMIT 1")
    if not failing.isEmpty():
        raise AccessDenied(table, operation, "row-level security")
    return rows


__all__ = ["AccessDenied", "Who", "check_write", "Secured", "condition", "secure", "secured"]
