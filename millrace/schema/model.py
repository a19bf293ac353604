"""Declared schemas: tables, keys, checks, policies; from Python, from YAML, and from what a catalog has."""

from __future__ import annotations

from dataclasses import asdict, dataclass, replace
from typing import Any

import yaml
from pyspark.sql import types as T

from millrace.schema.types import Portable, of_spark, parse


@dataclass(frozen=True)
class Column:
    name: str
    type: Portable
    nullable: bool = True
    default: str | None = None  # an expression, see defaults.py
    check: str | None = None


@dataclass(frozen=True)
class Index:
    name: str
    columns: tuple[str, ...]
    unique: bool = False


@dataclass(frozen=True)
class ForeignKey:
    name: str
    columns: tuple[str, ...]
    table: str
    references: tuple[str, ...]
    on_delete: str = "NoAction"


@dataclass(frozen=True)
class Check:
    name: str
    expression: str


@dataclass(frozen=True)
class Policy:
    name: str
    permissive: bool = True
    operations: tuple[str, ...] = ("all",)  # all, select, insert, update, delete
    roles: tuple[str, ...] = ()
    using: str | None = None
    with_check: str | None = None
    using_sql: str | None = None
    with_check_sql: str | None = None


@dataclass(frozen=True)
class Table:
    name: str
    columns: tuple[Column, ...]
    schema: str = "public"
    primary_key: tuple[str, ...] = ()
    indexes: tuple[Index, ...] = ()
    foreign_keys: tuple[ForeignKey, ...] = ()
    uniques: tuple[Index, ...] = ()
    checks: tuple[Check, ...] = ()
    policies: tuple[Policy, ...] = ()
    secured: bool = False
    comment: str | None = None

    def column(self, name: str, type: str, nullable: bool = True, default: str | None = None) -> Table:
        return replace(self, columns=(*self.columns, Column(name, parse(type), nullable, default)))

    def key(self, *columns: str) -> Table:
        return replace(self, primary_key=columns)

    def references(self, column: str, table: str, target: str) -> Table:
        return replace(self, foreign_keys=(*self.foreign_keys, ForeignKey(f"FK_{self.name}_{column}", (column,), table, (target,))))

    def struct(self) -> T.StructType:
        """The table as a DataFrame's schema; what Spark has no place for is metadata."""
        fields = []
        for c in self.columns:
            note: dict[str, Any] = {"portable": str(c.type)} | ({"default": c.default} if c.default else {}) | ({"check": c.check} if c.check else {})
            fields.append(T.StructField(c.name, c.type.data_type(), c.nullable and c.name not in self.primary_key, note))
        return T.StructType(fields)

    def ddl(self) -> str:
        return ", ".join(f"`{c.name}` {c.type.spark()}{'' if c.nullable and c.name not in self.primary_key else ' NOT NULL'}" for c in self.columns)


@dataclass(frozen=True)
class Schema:
    name: str
    tables: tuple[Table, ...] = ()

    def table(self, name: str) -> Table | None:
        return next((t for t in self.tables if t.name.lower() == name.lower()), None)

    def with_table(self, table: Table) -> Schema:
        return replace(self, tables=(*self.tables, table))


def from_yaml(text: str) -> Schema:
    raw = yaml.safe_load(text) or {}
    return Schema(raw.get("name") or "schema", tuple(map(_table, raw.get("tables") or [])))


def _table(t: dict) -> Table:
    security = t.get("rowLevelSecurity") or {}
    lower = lambda xs: tuple(str(x).lower() for x in xs or ())
    return Table(
        t["name"],
        tuple(Column(c["name"], parse(c.get("type", "Text")), c.get("isNullable", c.get("nullable", True)) is not False, c.get("defaultLqlExpression") or c.get("defaultValue"), c.get("checkConstraint")) for c in t.get("columns") or []),
        t.get("schema") or "public",
        tuple((t.get("primaryKey") or {}).get("columns") or ()),
        tuple(Index(i["name"], tuple(i.get("columns") or ()), bool(i.get("isUnique"))) for i in t.get("indexes") or []),
        tuple(ForeignKey(f.get("name") or f"FK_{t['name']}_{f['columns'][0]}", tuple(f["columns"]), f["referencedTable"], tuple(f["referencedColumns"]), f.get("onDelete", "NoAction")) for f in t.get("foreignKeys") or []),
        tuple(Index(u.get("name") or f"UQ_{t['name']}_{'_'.join(u['columns'])}", tuple(u["columns"]), True) for u in t.get("uniqueConstraints") or []),
        tuple(Check(c["name"], c["expression"]) for c in t.get("checkConstraints") or []),
        tuple(Policy(p["name"], p.get("isPermissive", True) is not False, lower(p.get("operations")) or ("all",), tuple(p.get("roles") or ()), p.get("usingLql"), p.get("withCheckLql"), p.get("usingSql"), p.get("withCheckSql")) for p in security.get("policies") or []),
        bool(security) and security.get("enabled", True) is not False,
        t.get("comment"),
    )


def to_yaml(schema: Schema) -> str:
    def clean(x: Any) -> Any:
        return {k: v for k, v in x.items() if v not in (None, [], (), {}, False)} if isinstance(x, dict) else x

    tables = []
    for t in schema.tables:
        policies = [clean({"name": p.name, "operations": list(p.operations), "roles": list(p.roles), "usingLql": p.using, "withCheckLql": p.with_check, "usingSql": p.using_sql, "withCheckSql": p.with_check_sql}) | ({} if p.permissive else {"isPermissive": False}) for p in t.policies]
        tables.append(
            clean(
                {
                    "name": t.name,
                    "schema": None if t.schema == "public" else t.schema,
                    "columns": [clean({"name": c.name, "type": str(c.type), "defaultValue": c.default, "checkConstraint": c.check}) | ({} if c.nullable else {"isNullable": False}) for c in t.columns],
                    "primaryKey": clean({"columns": list(t.primary_key)}) or None,
                    "indexes": [clean({"name": i.name, "columns": list(i.columns), "isUnique": i.unique}) for i in t.indexes],
                    "foreignKeys": [{"name": f.name, "columns": list(f.columns), "referencedTable": f.table, "referencedColumns": list(f.references), "onDelete": f.on_delete} for f in t.foreign_keys],
                    "uniqueConstraints": [{"name": u.name, "columns": list(u.columns)} for u in t.uniques],
                    "checkConstraints": [asdict(c) for c in t.checks],
                    "rowLevelSecurity": {"enabled": t.secured, "policies": policies} if t.secured or policies else None,
                    "comment": t.comment,
                }
            )
        )
    return yaml.safe_dump({"name": schema.name, "tables": tables}, sort_keys=False)


def of_struct(name: str, struct: T.StructType) -> Table:
    """A table as a catalog shows it; portable types come back from the metadata where they were kept."""
    return Table(name, tuple(Column(f.name, parse(f.metadata["portable"]) if "portable" in f.metadata else of_spark(f.dataType), f.nullable) for f in struct))


@dataclass(frozen=True)
class Mismatch:
    table: str
    column: str | None
    what: str


def verify(desired: Schema, live: Schema) -> list[Mismatch]:
    """Where live tables lack something or have another type; checks by Spark type."""
    found: list[Mismatch] = []
    for t in desired.tables:
        have = live.table(t.name)
        if have is None:
            found.append(Mismatch(t.name, None, "missing table"))
            continue
        columns = {c.name.lower(): c for c in have.columns}
        for c in t.columns:
            other = columns.get(c.name.lower())
            if other is None:
                found.append(Mismatch(t.name, c.name, "missing column"))
            elif other.type.data_type() != c.type.data_type():
                found.append(Mismatch(t.name, c.name, f"type {other.type}, not {c.type}"))
    return found


