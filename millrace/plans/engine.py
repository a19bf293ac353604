"""The engine: tables under names, and queries over them as DataFrames."""

from __future__ import annotations

import re
from typing import Any

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.lang import QueryError, parse
from millrace.lang import tree as t
from millrace.plans.block import Block, build
from millrace.plans.render import Renderer
from millrace.sources.tables import Tables

_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


class Engine:
    """Runs pipeline text, blocks and SQL over registered tables.

    ``int_division="truncate"`` makes ``/`` of two whole numbers whole, as most databases do; otherwise it is a fraction.
    """

    def __init__(self, spark: SparkSession, tables: Tables | str | dict[str, DataFrame | str] | None = None, int_division: str = "fraction"):
        self.spark = spark
        self.tables = tables if isinstance(tables, Tables) else Tables(spark, tables)
        self.int_division = int_division

    # Queries.
    def block(self, text: str) -> Block:
        return build(parse(text))

    def query(self, text: str, params: dict[str, Any] | None = None) -> DataFrame:
        """The rows of a program's last statement. A program that ends in insert writes them and returns what it wrote."""
        return self.run(self.block(text), params, text)

    def run(self, block: Block, params: dict[str, Any] | None = None, text: str = "") -> DataFrame:
        for table in sorted(block.tables()):
            self.tables.provide(table)
        try:
            rows = self._sql(self.text(block, "spark"), params)
        except (AnalysisException, ParseException) as e:
            raise self._error(e, text) from e
        if not block.insert:
            return rows
        self._allow(block.insert, "insert", rows, True)
        return self.tables.append(block.insert, rows, by_name=bool(Renderer().insert_columns(block)))

    def text(self, block: Block, dialect: str = "spark") -> str:
        renderer = Renderer(dialect, self._columns if dialect == "spark" else None, self._whole if self.int_division == "truncate" else None)
        return renderer.block(block) if dialect == "spark" else renderer.statement(block)

    def render(self, text: str, dialect: str) -> str:
        return self.text(self.block(text), dialect)

    def validate(self, text: str) -> list[QueryError]:
        """What is wrong with a program: its syntax and, for tables the engine has, its names and types."""
        try:
            block = self.block(text)
            if all(self.tables.has(x) for x in block.tables()):
                for table in block.tables():
                    self.tables.provide(table)
                self._sql(self.text(block, "spark"), dict.fromkeys(parameters(text)))
        except QueryError as e:
            return [e]
        except (AnalysisException, ParseException) as e:
            return [self._error(e, text)]
        return []

    def sql(self, text: str, params: dict[str, Any] | None = None) -> DataFrame:
        """Rows of SQL text; parameters may be written @p, $p or :p."""
        rewritten, names = placeholders(text)
        given = params or {}
        if missing := [n for n in names if n not in given]:
            raise QueryError(f"No value for parameter {missing[0]}")
        try:
            mentioned = self.tables.mentioned(rewritten)
        except ParseException as e:
            raise self._error(e, text) from e
        for table in mentioned:
            self.tables.provide(table)
        return self._sql(rewritten, {n: given[n] for n in names})

    def scalar(self, text: str, params: dict[str, Any] | None = None, kind: type | None = None, default: Any = None) -> Any:
        """The first column of the first row; ``default`` without a row, for null, and where it is not of the ``kind`` asked for."""
        row = self.sql(text, params).first()
        value = row[0] if row else None
        return default if value is None or (kind is not None and not isinstance(value, kind)) else value

    def execute(self, text: str, params: dict[str, Any] | None = None) -> int:
        """Runs an INSERT, UPDATE or DELETE on a table here; returns how many rows it touched."""
        rewritten, names = placeholders(text)
        given = params or {}
        if missing := [n for n in names if n not in given]:
            raise QueryError(f"No value for parameter {missing[0]}")
        write = Renderer("spark")
        text = _PLACEHOLDER.sub(lambda m: write.literal(t.Literal(given[m["name"]] if isinstance(given[m["name"]], bool | int | float | None) else str(given[m["name"]]))) if m["name"] else m[0], rewritten)
        jvm, plan = self.spark._jvm, self.spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
        kind = plan.getClass().getSimpleName()
        if kind not in ("InsertIntoStatement", "UpdateTable", "DeleteFromTable"):
            raise QueryError("execute takes INSERT, UPDATE or DELETE")
        relation = re.search(r"UnresolvedRelation \[(.*?)\], \[", plan.table().toString())
        table = relation[1] if relation else ""
        if not relation or ", " in table or not self.tables.has(table):
            raise QueryError(f"Unknown table: {table}")
        for name in self.tables.mentioned(text):
            self.tables.provide(name)
        column = jvm.org.apache.spark.sql.classic.ExpressionUtils.column
        if kind == "InsertIntoStatement":
            rows = DataFrame(jvm.org.apache.spark.sql.classic.Dataset.ofRows(self.spark._jsparkSession, plan.query()), self.spark)
            own = [plan.userSpecifiedCols().apply(i) for i in range(plan.userSpecifiedCols().length())]
            rows = rows.toDF(*own) if own else rows
            return self._insert(table, rows, bool(own))
        target = self._whole_table(table)
        holds = plan.condition() if kind == "DeleteFromTable" else plan.condition().get() if plan.condition().isDefined() else None
        hit = F.coalesce(Column(column(holds)), F.lit(False)) if holds is not None else F.lit(True)
        touched = target.where(hit)
        if kind == "DeleteFromTable":
            self._allow(table, "delete", touched, False)
            return self._replaced(table, target.where(~hit), touched)
        sets = plan.assignments()
        values = {sets.apply(i).key().nameParts().last().lower(): Column(column(sets.apply(i).value())) for i in range(sets.length())}
        if unknown := set(values) - {c.lower() for c in target.columns}:
            raise QueryError(f"{table} has no column {sorted(unknown)[0]}")
        new = touched.select(*[values.get(f.name.lower(), F.col(f"`{f.name}`")).cast(f.dataType).alias(f.name) for f in target.schema])
        self._allow(table, "update", touched, False)
        self._allow(table, "update", new, True)
        return self._replaced(table, target.where(~hit).unionByName(new), touched)

    # What a secured engine does otherwise.
    def _whole_table(self, table: str) -> DataFrame:
        return self.tables.get(table)

    def _allow(self, table: str, operation: str, rows: DataFrame, new: bool) -> None:
        """Raises if the rows may not be written (new rows) or touched (old ones)."""

    def _insert(self, table: str, rows: DataFrame, by_name: bool) -> int:
        return self.tables.append(table, rows, by_name=by_name).count()

    def _replaced(self, table: str, rows: DataFrame, touched: DataFrame) -> int:
        n = touched.count()
        if n:
            self.tables.replace(table, rows)
        return n

    def from_(self, table: str):
        """A fluent query on a table."""
        from millrace.api.builder import Query

        return Query(table, engine=self)

    # Inside.
    def _sql(self, text: str, params: dict[str, Any] | None) -> DataFrame:
        return self.spark.sql(text, args=params) if params else self.spark.sql(text)

    def _columns(self, table: str) -> list[str]:
        return self.tables.columns(table)

    def _type(self, x: t.Node, b: Block) -> bool:
        if isinstance(x, t.Literal):
            return isinstance(x.value, int) and not isinstance(x.value, bool)
        if isinstance(x, t.Binary):
            return x.op in "+-*/%" and self._type(x.left, b) and self._type(x.right, b)
        if isinstance(x, t.Negative):
            return self._type(x.of, b)
        if isinstance(x, t.Call):
            return x.name.lower() in ("count", "length") or (x.name.lower() in ("sum", "min", "max", "abs") and len(x.args) == 1 and self._type(x.args[0], b))
        if isinstance(x, t.Name):
            for s in b.sources():
                if s.table and (len(x.parts) == 1 or s.alias.lower() == x.parts[0].lower()):
                    found = {f.name.lower(): f.dataType for f in self.tables.schema(s.table)}
                    if x.parts[-1].lower() in found:
                        return isinstance(found[x.parts[-1].lower()], _INTEGRAL)
        return False

    def _whole(self, x: t.Binary, b: Block) -> bool:
        return self._type(x.left, b) and self._type(x.right, b)

    def _error(self, e: Exception, text: str) -> QueryError:
        """Spark's error, placed at the name it complains of where that name stands in the text."""
        message = str(e).split("\n")[0].split(";")[0]
        m = re.search(r"(?:UNRESOLVED_COLUMN|UNRESOLVED_ROUTINE|TABLE_OR_VIEW_NOT_FOUND|MISSING_AGGREGATION|AMBIGUOUS_REFERENCE)[^`\"]*[`\"]([^\s]+?)[`\"](?:\s|,|\.|$)", message)
        if m and text:
            name = m[1].replace("`", "").split(".")[-1].strip('"')
            if found := re.search(rf"(?<!\w){re.escape(name)}(?!\w)", text):
                from millrace.lang.errors import at

                return at(message, text, *found.span())
        return QueryError(message)


_PLACEHOLDER = re.compile(r"'(?:[^']|'')*'|--[^\n]*|/\*.*?\*/|\"[^\"]*\"|`[^`]*`|(?<![\w@$:])[@$:](?P<name>[A-Za-z_]\w*)|(?P<mark>\?)", re.S)


def placeholders(text: str) -> tuple[str, list[str]]:
    """The text with every parameter written :p, and their names in order of appearance; ? are named p1, p2 and so on."""
    names: list[str] = []
    marks = 0

    def one(m: re.Match) -> str:
        nonlocal marks
        if not m["name"] and not m["mark"]:
            return m[0]
        marks += bool(m["mark"])
        name = m["name"] or f"p{marks}"
        if name not in names:
            names.append(name)
        return f":{name}"

    return _PLACEHOLDER.sub(one, text), names


def parameters(text: str) -> list[str]:
    return placeholders(text)[1]


def statement_kind(text: str) -> str:
    """select, insert, update, delete, create_table, drop or other."""
    words = re.sub(r"--[^\n]*|/\*.*?\*/", " ", text, flags=re.S).lower().split()
    if not words:
        return "other"
    if words[0] == "with":
        return next((w for w in words if w in ("insert", "update", "delete")), "select")
    return {"create": "create_table" if words[1:2] == ["table"] else "other"}.get(words[0], words[0] if words[0] in ("select", "insert", "update", "delete", "drop") else "other")
