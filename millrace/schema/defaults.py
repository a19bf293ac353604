"""Portable default expressions as Spark SQL."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.lang.errors import QueryError
from millrace.lang.parser import parse
from millrace.plans.render import Renderer
from millrace.schema.model import Table

# Calls with a form of their own.
_CALLS = {"now()": "current_timestamp()", "current_timestamp()": "current_timestamp()", "current_date()": "current_date()", "current_time()": "date_format(current_timestamp(), 'HH:mm:ss')", "gen_uuid()": "uuid()", "uuid()": "uuid()"}


def translate(text: str) -> str:
    """A default in the query language (a number, a quoted text, true or false, null, or a call) as a Spark expression."""
    key = re.sub(r"\s+", "", text).lower()
    if key in _CALLS:
        return _CALLS[key]
    try:
        return Renderer("spark").expr(parse(f"x |> select({text})").result.steps[0].args[0])
    except (QueryError, IndexError) as e:
        raise QueryError(f"no default: {text}") from e


def fill(rows: DataFrame, table: Table) -> DataFrame:
    """Rows with the table's columns in its order; columns that are not given take their default, or null."""
    given = {c.lower(): c for c in rows.columns}

    def one(c) -> Column:
        value = F.col(f"`{given[c.name.lower()]}`") if c.name.lower() in given else F.expr(translate(c.default)) if c.default else F.lit(None)
        return value.cast(c.type.data_type()).alias(c.name)

    return rows.select(*map(one, table.columns))


def function_body(text: str, parameters: list[str] = ()) -> str:
    """A scalar expression of the query language as the body of a SQL function over its parameters."""
    return Renderer("spark").expr(parse(f"x |> select({text})").result.steps[0].args[0])
