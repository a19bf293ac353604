"""Canonical JSON and hashes of rows, batches and whole tables."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.change.errors import HashMismatch


def canonical_json(df: DataFrame) -> Column:
    """A row as JSON: keys in ordinal order, no white space, nulls kept."""
    return F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)]), {"ignoreNullFields": "false"})


def canonical_text(payload: Column) -> Column:
    """A JSON object's text with its keys in ordinal order; nested values keep their text."""
    fields = F.from_json(payload, "map<string,variant>")
    one = lambda k: F.substr(F.to_json(F.struct(k.alias("k"))), F.lit(6))
    # {"k":"name"} without its first five characters and its last is "name".
    named = F.transform(F.array_sort(F.map_keys(fields)), lambda k: F.concat(F.regexp_replace(one(k), r"\}$", ":"), F.coalesce(F.to_json(F.element_at(fields, k)), F.lit("null"))))
    return F.when(payload.isNotNull(), F.concat(F.lit("{"), F.array_join(named, ","), F.lit("}")))


def line() -> Column:
    """A change as the line that batch hashes are made of."""
    return F.concat(F.col("version").cast("string"), F.lit(":"), F.col("table_name"), F.lit(":"), F.col("pk_value"), F.lit(":"), F.lower("operation"), F.lit(":"), F.coalesce("payload", F.lit("null")), F.lit("\n"))


def row_hash(df: DataFrame) -> Column:
    return F.sha2(canonical_json(df), 256)


def table_sums(df: DataFrame) -> DataFrame:
    """One row: the number of rows, and the sums of the four 60-bit pieces of their hashes, as text.

    Sums don't mind the order, so they are taken where the rows lie; tables with other rows have the same ones only by a
    clash of four sums.
    """
    pieces = [F.conv(F.substr(F.col("h"), F.lit(15 * k + 1), F.lit(15)), 16, 10).cast("decimal(38,0)") for k in range(4)]
    sums = [F.coalesce(F.sum(p), F.lit(0)).cast("string").alias(f"s{k}") for k, p in enumerate(pieces)]
    return df.select(row_hash(df).alias("h")).agg(F.count("*").alias("n"), *sums)


def table_hash(df: DataFrame) -> str:
    """A hash of a table's rows that does not depend on how they lie; a single small row comes to the driver."""
    return hashlib.sha256(":".join(map(str, table_sums(df).first())).encode()).hexdigest()


def database_hash(tables: dict[str, DataFrame]) -> str:
    """The hash of tables by name, in ordinal order of their names."""
    return hashlib.sha256("".join(f"{name}:{table_hash(tables[name])}\n" for name in sorted(tables)).encode()).hexdigest()


def verify(expected: str, found: str) -> None:
    if expected != found:
        raise HashMismatch(expected, found)
