"""Portable column types: their names in schema files, in three databases, and in Spark."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import types as T

# Name, PostgreSQL type, SQLite type, Spark type; {0} and {1} stand for the arguments.
TABLE = [
    ("TinyInt", "SMALLINT", "INTEGER", "tinyint"),
    ("SmallInt", "SMALLINT", "INTEGER", "smallint"),
    ("Int", "INTEGER", "INTEGER", "int"),
    ("BigInt", "BIGINT", "INTEGER", "bigint"),
    ("Decimal", "NUMERIC({0},{1})", "REAL", "decimal({0},{1})"),
    ("Money", "NUMERIC(19,4)", "REAL", "decimal(19,4)"),
    ("SmallMoney", "NUMERIC(10,4)", "REAL", "decimal(10,4)"),
    ("Float", "REAL", "REAL", "float"),
    ("Double", "DOUBLE PRECISION", "REAL", "double"),
    ("Char", "CHAR({0})", "TEXT", "char({0})"),
    ("VarChar", "VARCHAR({0})", "TEXT", "varchar({0})"),
    ("NChar", "CHAR({0})", "TEXT", "string"),
    ("NVarChar", "VARCHAR({0})", "TEXT", "string"),
    ("Text", "TEXT", "TEXT", "string"),
    ("Binary", "BYTEA", "BLOB", "binary"),
    ("VarBinary", "BYTEA", "BLOB", "binary"),
    ("Blob", "BYTEA", "BLOB", "binary"),
    ("Date", "DATE", "TEXT", "date"),
    ("Time", "TIME({0})", "TEXT", "string"),
    ("DateTime", "TIMESTAMP", "TEXT", "timestamp_ntz"),
    ("DateTimeOffset", "TIMESTAMPTZ", "TEXT", "timestamp"),
    ("RowVersion", "BYTEA", "BLOB", "binary"),
    ("Uuid", "UUID", "TEXT", "string"),
    ("Boolean", "BOOLEAN", "BOOLEAN", "boolean"),
    ("Json", "JSONB", "TEXT", "string"),
    ("Xml", "XML", "TEXT", "string"),
    ("Enum", "{0}", "TEXT", "string"),
    ("Geometry", "geometry(Geometry,{0})", "BLOB", "binary"),
    ("Geography", "geography(Geography,{0})", "BLOB", "binary"),
    ("Vector", "vector({0})", "BLOB", "array<float>"),
]
_KNOWN = {name.lower(): (name, pg, lite, spark) for name, pg, lite, spark in TABLE}
# Other names of types, and the arguments that types have where none are given.
_OTHER = {"integer": "int", "real": "float", "bool": "boolean", "guid": "uuid", "jsonb": "json", "timestamp": "rowversion"}
_DEFAULTS = {"decimal": ("18", "2"), "varchar": ("max",), "nvarchar": ("max",), "char": ("1",), "nchar": ("1",), "time": ("7",), "datetime": ("3",), "geography": ("4326",), "geometry": ("0",)}


@dataclass(frozen=True)
class Portable:
    name: str
    args: tuple[str, ...] = ()

    def __str__(self) -> str:
        if self.name == "Enum":
            return f"Enum({self.args[0]}:{'|'.join(self.args[1:])})"
        return f"{self.name}({','.join(self.args)})" if self.args else self.name

    def _text(self, k: int) -> str:
        args = self.args or _DEFAULTS.get(self.name.lower(), ())
        text = _KNOWN[self.name.lower()][k]
        if "max" in args:
            return {1: "TEXT", 2: "TEXT", 3: "string"}[k]
        return text.format(*args, *[""] * 2)

    def postgres(self) -> str:
        return self._text(1)

    def sqlite(self) -> str:
        return self._text(2)

    def spark(self) -> str:
        """The type in Spark's DDL, as columns are declared."""
        return self._text(3)

    def data_type(self) -> T.DataType:
        """The type of a DataFrame's column."""
        kind = self.spark()
        return T.StringType() if kind.startswith(("char(", "varchar(")) else T._parse_datatype_string(kind)


def parse(text: str) -> Portable:
    """A type by its name in a schema file; one that isn't known is Text."""
    m = re.fullmatch(r"\s*(\w+)\s*(?:\((.*)\))?\s*", str(text), re.S)
    if not m:
        return Portable("Text")
    key = _OTHER.get(m[1].lower(), m[1].lower())
    if key not in _KNOWN:
        return Portable("Text")
    args = m[2] or ""
    if key == "enum":
        name, _, values = args.partition(":")
        return Portable("Enum", (name.strip(), *[v.strip() for v in values.split("|") if v.strip()]))
    return Portable(_KNOWN[key][0], tuple(a.strip().lower() for a in args.split(",") if a.strip()))


def of_spark(kind: T.DataType) -> Portable:
    """The portable type that fits a Spark type best."""
    if isinstance(kind, T.DecimalType):
        return Portable("Decimal", (str(kind.precision), str(kind.scale)))
    names = {"tinyint": "TinyInt", "smallint": "SmallInt", "int": "Int", "bigint": "BigInt", "float": "Float", "double": "Double", "string": "Text", "binary": "Blob", "date": "Date", "timestamp_ntz": "DateTime", "timestamp": "DateTimeOffset", "boolean": "Boolean", "array<float>": "Vector"}
    return Portable(names.get(kind.simpleString(), "Json"))
