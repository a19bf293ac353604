"""Row changes on tables by key, as rewrites of whole tables that a scan and a join make."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.sources.tables import Tables, adopted


def _same(keys: list[str]) -> Callable[[str], Column]:
    return lambda other: F.expr(" AND ".join(f"t.`{k}` <=> {other}.`{k}`" for k in keys))


def _fit(rows: DataFrame, target: DataFrame) -> DataFrame:
    """Rows with the target's columns and types; what they lack is null."""
    given = {c.lower(): c for c in rows.columns}
    return rows.select(*[(F.col(f"`{given[f.name.lower()]}`") if f.name.lower() in given else F.lit(None)).cast(f.dataType).alias(f.name) for f in target.schema])


def insert(target: DataFrame, rows: DataFrame) -> DataFrame:
    return target.unionByName(_fit(rows, target))


def _one_of(rows: DataFrame, keys: list[str], last: bool) -> DataFrame:
    """Of rows with one key the first or the last, in the order in which they are given."""
    one = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
    given = rows.select(*[F.col(f"`{k}`").alias(f"__k{i}") for i, k in enumerate(keys)], one.alias("__one"), F.monotonically_increasing_id().alias("__at"))
    pick = (F.max_by if last else F.min_by)("__one", "__at")
    return given.groupBy(*[f"__k{i}" for i in range(len(keys))]).agg(pick.alias("__one")).select("__one.*")


def insert_absent(target: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Adds the rows whose key isn't there yet; of new rows with one key the first."""
    new = _one_of(_fit(rows, target), keys, False).alias("n")
    return target.unionByName(new.join(target.alias("t"), _same(keys)("n"), "left_anti"))


def upsert(target: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows take the place of those with their key, or are added; of new rows with one key the last holds."""
    new = _one_of(_fit(rows, target), keys, True)
    return target.alias("t").join(new.alias("n"), _same(keys)("n"), "left_anti").unionByName(new)


def update(target: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Sets the columns that ``rows`` has on the rows with their keys; others stay as they are. Of rows with one key the last holds."""
    given = [c for c in rows.columns if c not in keys]
    new = _one_of(rows, keys, True).withColumn("__hit", F.lit(True))
    both = target.alias("t").join(new.alias("n"), _same(keys)("n"), "left")
    return both.select(*[(F.when(F.col("n.__hit"), F.col(f"n.`{f.name}`").cast(f.dataType)).otherwise(F.col(f"t.`{f.name}`")) if f.name in given else F.col(f"t.`{f.name}`")).alias(f.name) for f in target.schema])


def delete(target: DataFrame, keys_of: DataFrame, keys: list[str]) -> DataFrame:
    return target.alias("t").join(keys_of.select(*keys).alias("n"), _same(keys)("n"), "left_anti")


def execute(tables: Tables, table: str, change: Callable[[DataFrame], DataFrame]) -> int:
    """Puts a changed table in its place; returns how many rows were added, removed or altered (an altered row counts once)."""
    before = tables.get(table)
    after = change(before)
    n = max(before.exceptAll(after).count(), after.exceptAll(before).count())
    if n:
        tables.replace(table, after)
    return n


class Transaction:
    """Changes of several tables that take place together, or not at all if the body raises or a table can't be written.

    Inside, query(), sql(), scalar() and execute() see what the transaction has done so far, in a session of its own.
    Each table is written beside the old one and all are swapped in at the end; with one writer, readers see whole tables.
    """

    def __init__(self, tables: Tables):
        from millrace.plans.engine import Engine

        self.tables, self.staged = tables, {}
        own = Tables(tables.spark.newSession(), None, tables.format)
        own.folder, own.paths, own.known = tables.folder, dict(tables.paths), dict(tables.known)
        own.place = lambda name: None  # nothing is written before the end
        own.put = self._stage
        self.engine = Engine(own.spark, own)
        self.query, self.sql, self.scalar = self.engine.query, self.engine.sql, self.engine.scalar

    def _stage(self, changes: dict[str, DataFrame]) -> None:
        for name, rows in changes.items():
            self.staged[name.lower()] = self.engine.tables.known[name.lower()] = adopted(rows, self.engine.spark)

    def execute(self, text: str, params: dict[str, Any] | None = None) -> int:
        n = self.engine.execute(text, params)
        # An insert adds to the table that this engine knows.
        own = self.engine.tables
        self.staged |= {k: v for k, v in own.known.items() if k in own.changed}
        return n

    def get(self, table: str) -> DataFrame:
        return self.engine.tables.get(table)

    def change(self, table: str, change: Callable[[DataFrame], DataFrame]) -> None:
        self._stage({table: change(self.get(table))})

    def __enter__(self) -> Transaction:
        return self

    def __exit__(self, kind: Any, *_: Any) -> None:
        if kind is None and self.staged:
            self.tables.put({name: adopted(rows, self.tables.spark) for name, rows in self.staged.items()})


def transact(tables: Tables, body: Callable[[Transaction], Any]) -> Any:
    with Transaction(tables) as t:
        return body(t)
