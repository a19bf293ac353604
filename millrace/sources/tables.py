"""Tables under names: DataFrames, or folders and files of Parquet, ORC, CSV or JSON."""

from __future__ import annotations

import re
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.lang.errors import QueryError

FORMATS = ("parquet", "orc", "csv", "json")


def adopted(df: DataFrame, spark: SparkSession) -> DataFrame:
    """The same rows in another session of the application, whose names it can't see."""
    if df.sparkSession is spark:
        return df
    return DataFrame(spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, df._jdf.queryExecution().analyzed()), spark)


class Tables:
    """A name's table is what was registered, or ``{folder}/{name}.{format}``, or a table of the session.

    provide() makes it a temporary view; what reads it then has its plan, so a later registration changes nothing there.
    The folder and its tables are only read unless ``writable``; a table registered at a path of its own can be written.
    ``closed`` tables know no names but their own: nothing of the session's catalog, no file by its path.
    """

    closed = False

    def __init__(self, spark: SparkSession, tables: str | dict[str, DataFrame | str] | None = None, format: str = "parquet", writable: bool = False):
        self.spark, self.format, self.writable = spark, format, writable
        self.folder = tables.rstrip("/") if isinstance(tables, str) else None
        self.known: dict[str, DataFrame] = {}
        self.paths: dict[str, tuple[str, str]] = {}
        self.registered: set[str] = set()
        self.changed: set[str] = set()
        for name, table in (tables if isinstance(tables, dict) else {}).items():
            self.register(name, table)

    def register(self, name: str, table: DataFrame | str, format: str | None = None) -> None:
        if isinstance(table, str):
            self.paths[name.lower()] = (table, format or next((f for f in FORMATS if table.endswith(f".{f}")), self.format))
            self.known.pop(name.lower(), None)
        else:
            self.known[name.lower()] = table
            self.registered.add(name.lower())

    def read(self, path: str, format: str) -> DataFrame:
        reader = self.spark.read
        return reader.option("header", True).csv(path) if format == "csv" else reader.format(format).load(path)

    def get(self, name: str) -> DataFrame:
        key = name.lower()
        if key not in self.known:
            if key in self.paths:
                self.known[key] = self.read(*self.paths[key])
            elif self.folder and "." not in name:
                try:
                    self.known[key] = self.read(f"{self.folder}/{name}.{self.format}", self.format)
                except AnalysisException as e:
                    if e.getCondition() != "PATH_NOT_FOUND":
                        raise
                    if self.closed or not self.spark.catalog.tableExists(name):
                        raise QueryError(f"Unknown table: {name}") from None
                    self.known[key] = self.spark.table(name)
            elif not self.closed and self.spark.catalog.tableExists(name):
                self.known[key] = self.spark.table(name)
            else:
                raise QueryError(f"Unknown table: {name}")
        return self.known[key]

    def has(self, name: str) -> bool:
        try:
            self.get(name)
        except QueryError:
            return False
        return True

    def provide(self, name: str) -> None:
        if "." not in name:
            adopted(self.get(name), self.spark).createOrReplaceTempView(name)
        elif self.closed:
            raise QueryError(f"Unknown table: {name}")

    def mentioned(self, sql: str) -> list[str]:
        """Names that Spark's parser takes for relations in SQL text, and that are tables here. Quotes, comments, nested
        queries and names that a WITH clause hides are the parser's business. Closed tables refuse any other name."""
        tree = self.spark._jsparkSession.sessionState().sqlParser().parsePlan(sql).treeString()
        names = {tuple(x.split(", ")) for x in re.findall(r"UnresolvedRelation \[(.*?)\], \[", tree)}
        own = {w.lower() for w in re.findall(r"(?m)^[ :+-]*CTE \[(.*?)\]", tree) for w in w.split(", ")}
        if self.closed and (bad := [n for n in names if len(n) > 1]):
            raise QueryError(f"Unknown table: {'.'.join(sorted(bad)[0])}")
        found = sorted({n[0].lower() for n in names if len(n) == 1})
        return [w for w in found if w in self.known or w in self.paths or (self.folder and self.has(w)) or (self.closed and w not in own and self.has(w))]

    def schema(self, name: str) -> T.StructType:
        return self.get(name).schema

    def columns(self, name: str) -> list[str]:
        return self.get(name).columns

    def place(self, name: str) -> tuple[str, str] | None:
        """Where a table is written (path, format); None for one that lives in this object alone."""
        key = name.lower()
        if key in self.paths:
            return self.paths[key]
        if self.folder and self.writable and key not in self.registered:
            return f"{self.folder}/{name}.{self.format}", self.format
        return None

    def append(self, name: str, rows: DataFrame, by_name: bool = False) -> DataFrame:
        """Adds rows to a table: by name if all names are the table's own, else by place. Returns the rows as added.

        Tables that have a place are appended to there; any other becomes, in this object, its union with the rows.
        """
        key = name.lower()
        if not self.has(name):
            if place := self.place(name):
                path, format = place
                rows.write.format(format).mode("append").save(path)
                self.paths[key] = (path, format)
            else:
                self.known[key] = rows
            return rows
        target = self.get(name)
        if by_name and {c.lower() for c in rows.columns} <= {c.lower() for c in target.columns}:
            given = {c.lower(): c for c in rows.columns}
            fitted = rows.select(*[(F.col(f"`{given[f.name.lower()]}`") if f.name.lower() in given else F.lit(None)).cast(f.dataType).alias(f.name) for f in target.schema])
        elif len(rows.columns) == len(target.columns):
            fitted = rows.toDF(*target.columns).select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in target.schema])
        else:
            raise QueryError(f"insert into {name}: {len(rows.columns)} columns given, the table has {len(target.columns)}")
        if place := self.place(name):
            path, format = place
            fitted.write.format(format).mode("append").save(path)
            self.known.pop(key, None)
            self.spark.catalog.refreshByPath(path)
        else:
            self.known[key] = target.unionByName(fitted)
        self.changed.add(key)
        return fitted

    def replace(self, name: str, rows: DataFrame) -> None:
        """Puts rows in a table's place."""
        self.put({name: rows})

    def put(self, changes: dict[str, DataFrame]) -> None:
        """Puts rows in the places of several tables: all of them or, if something fails, none.

        At a path they are written beside the old rows; once everything is written all are swapped in, and swapped back
        if one can't be. So rows may read any of the old tables. There must be one writer.
        """
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        mark = uuid.uuid4().hex
        places = {name: place for name in changes if (place := self.place(name))}

        def at(path: str):
            p = jvm.org.apache.hadoop.fs.Path(path)
            return p, p.getFileSystem(conf)

        def move(a: str, b: str) -> None:
            p, files = at(a)
            if not files.rename(p, at(b)[0]):
                raise OSError(f"can't move {a} to {b}")

        def remove(path: str) -> None:
            p, files = at(path)
            files.delete(p, True)

        swapped: list[str] = []
        try:
            for name, (path, format) in places.items():
                changes[name].write.format(format).save(f"{path}.staged-{mark}")
            for path, _ in places.values():
                swapped.append(path)
                if (p := at(path))[1].exists(p[0]):
                    move(path, f"{path}.old-{mark}")
                move(f"{path}.staged-{mark}", path)
        except Exception:
            for path in reversed(swapped):
                if (p := at(f"{path}.old-{mark}"))[1].exists(p[0]):
                    remove(path)
                    move(f"{path}.old-{mark}", path)
            for path, _ in places.values():
                remove(f"{path}.staged-{mark}")
            raise
        for name, rows in changes.items():
            if name in places:
                remove(f"{places[name][0]}.old-{mark}")
                self.known.pop(name.lower(), None)
                self.spark.catalog.refreshByPath(places[name][0])
            else:
                self.known[name.lower()] = rows
