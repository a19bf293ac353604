"""Query files as functions: a folder of ``name.sql`` and pipeline files becomes callables with parameters and a result schema."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from millrace.lang.errors import QueryError
from millrace.operators.grouping import Entity, nest
from millrace.plans.engine import Engine, parameters, statement_kind


@dataclass(frozen=True)
class QueryFile:
    """One query. Calling it with its parameters gives the rows; a parameter that isn't given is null."""

    name: str
    text: str
    sql: bool
    engine: Engine

    @property
    def parameters(self) -> list[str]:
        """In the order of their first appearance."""
        return parameters(self.text)

    @property
    def kind(self) -> str:
        return statement_kind(self.text) if self.sql else "insert" if self.engine.block(self.text).insert else "select"

    def __call__(self, **values: Any) -> DataFrame:
        if extra := set(values) - set(self.parameters):
            raise QueryError(f"{self.name} has no parameter {sorted(extra)[0]}")
        bound = dict.fromkeys(self.parameters) | values
        return self.engine.sql(self.text, bound) if self.sql else self.engine.query(self.text, bound)

    def schema(self) -> T.StructType:
        """The result's columns and types; nothing runs for it."""
        if self.kind != "select":
            raise QueryError(f"{self.name} returns no rows to describe")
        return self().schema

    def nested(self, parent: Entity, child: Entity, **values: Any) -> DataFrame:
        """The rows grouped into parents with their children."""
        return nest(self(**values), parent, child)


class Library:
    """The query files of a folder by name: ``*.sql``, and any other suffix given for pipeline texts."""

    def __init__(self, engine: Engine, folder: str, pipelines: tuple[str, ...] = (".lql", ".pipe")):
        self.files: dict[str, QueryFile] = {}
        for path in sorted(Path(folder).iterdir()):
            if path.suffix == ".sql" or path.suffix in pipelines:
                self.files[path.stem] = QueryFile(path.stem, path.read_text(), path.suffix == ".sql", engine)

    def __getitem__(self, name: str) -> QueryFile:
        return self.files[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self.files)

    def validate(self) -> dict[str, list[QueryError]]:
        """The faults of each file that has some."""
        found = {}
        for name, query in self.files.items():
            if query.sql:
                try:
                    query.kind == "select" and query.schema()
                    faults = []
                except Exception as e:
                    faults = [e if isinstance(e, QueryError) else QueryError(str(e).split("\n")[0])]
            else:
                faults = query.engine.validate(query.text)
            if faults:
                found[name] = faults
        return found
