"""From what there is to what is wanted: operations, and their execution on a Spark catalog."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import SparkSession

from millrace.schema.model import Schema, Table, of_struct


@dataclass(frozen=True)
class Operation:
    """kind: create_table, add_column, create_index, add_foreign_key, add_check, add_unique, enable_security, create_policy,
    and drop_table, drop_column, drop_index, drop_foreign_key, drop_check, drop_policy, disable_security."""

    kind: str
    table: str
    item: Any = None

    def sql(self) -> str | None:
        """Spark's DDL; None for what lives in our own schema alone."""
        name = f"`{self.table}`"
        if self.kind == "create_table":
            return f"CREATE TABLE {name} ({self.item.ddl()}) USING parquet"
        if self.kind == "drop_table":
            return f"DROP TABLE {name}"
        if self.kind == "add_column":
            return f"ALTER TABLE {name} ADD COLUMNS (`{self.item.name}` {self.item.type.spark()})"
        if self.kind == "drop_column":
            return f"ALTER TABLE {name} DROP COLUMN `{self.item}`"
        return None


def diff(live: Schema, desired: Schema, destructive: bool = False) -> list[Operation]:
    """What to do, additions first. Tables, columns and the rest are compared by name in any case; a column that only
    changes its type gives nothing (verify() tells). Things are dropped only if ``destructive``."""
    add: list[Operation] = []
    drop: list[Operation] = []
    for want in desired.tables:
        have = live.table(want.name)
        if have is None:
            add.append(Operation("create_table", want.name, want))
        _parts(have or Table(want.name, want.columns), want, add, drop)
    if destructive:
        drop += [Operation("drop_table", t.name) for t in live.tables if desired.table(t.name) is None]
    return add + (drop if destructive else [])


def _parts(have: Table, want: Table, add: list[Operation], drop: list[Operation]) -> None:
    kinds = [("columns", "add_column", "drop_column"), ("indexes", "create_index", "drop_index"), ("foreign_keys", "add_foreign_key", "drop_foreign_key"), ("uniques", "add_unique", "drop_unique"), ("checks", "add_check", "drop_check")]
    for attribute, make, remove in kinds:
        old, new = ({x.name.lower(): x for x in getattr(t, attribute)} for t in (have, want))
        add += [Operation(make, want.name, x) for k, x in new.items() if k not in old]
        drop += [Operation(remove, want.name, x.name) for k, x in old.items() if k not in new]
    if want.secured and not have.secured:
        add.append(Operation("enable_security", want.name))
    if have.secured and not want.secured:
        drop.append(Operation("disable_security", want.name))
    old, new = ({p.name.lower(): p for p in t.policies} for t in (have, want))
    add += [Operation("create_policy", want.name, p) for k, p in new.items() if k not in old]
    drop += [Operation("drop_policy", want.name, p.name) for k, p in old.items() if k not in new]


@dataclass
class Migrated:
    """done: what ran; noted: what has no statement in Spark and holds in our own schema alone."""

    done: list[Operation] = field(default_factory=list)
    failed: list[tuple[Operation, str]] = field(default_factory=list)
    planned: list[str] = field(default_factory=list)
    noted: list[Operation] = field(default_factory=list)


def migrate(spark: SparkSession, operations: list[Operation], dry_run: bool = False, go_on: bool = False) -> Migrated:
    """Runs operations in order. A dry run only plans. A failure ends the run, or with ``go_on`` is noted and passed over;
    either way it stays in ``failed``. Tables are created and dropped one by one: Spark has no transaction over several."""
    out = Migrated()
    for operation in operations:
        text = operation.sql()
        out.planned += [text] if text else []
        if dry_run:
            continue
        try:
            if text:
                spark.sql(text)
            (out.done if text else out.noted).append(operation)
        except Exception as e:
            out.failed.append((operation, str(e).split("\n")[0]))
            if not go_on:
                break
    return out


def inspect(spark: SparkSession, name: str = "live") -> Schema:
    """The current database's tables as a schema."""
    names = [t.name for t in spark.catalog.listTables() if not t.isTemporary]
    return Schema(name, tuple(of_struct(n, spark.table(n).schema) for n in names))
