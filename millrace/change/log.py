"""The change log: its schema, its batches, the state it stands for, and capture by comparing snapshots."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.change.hashing import canonical_json, line

SCHEMA = "version long, table_name string, pk_value string, operation string, payload string, origin string, timestamp string"
COLUMNS = ["version", "table_name", "pk_value", "operation", "payload", "origin", "timestamp"]


@dataclass(frozen=True)
class Batch:
    changes: DataFrame
    from_version: int
    to_version: int
    has_more: bool
    hash: str


def since(log: DataFrame, version: int) -> DataFrame:
    return log.where(F.col("version") > version)


def fetch_batch(log: DataFrame, from_version: int, size: int = 1000) -> Batch:
    """The next ``size`` changes by version. One top-k job finds where the batch ends and whether more follow; the rows
    themselves stay distributed, cut out by their range of versions."""
    ends = since(log, from_version).select("version").orderBy("version").limit(size + 1)
    count, last = ends.agg(F.count("*"), F.max(F.struct("version"))).first()
    if not count:
        return Batch(log.limit(0), from_version, from_version, False, "")
    more = count > size
    to = ends.limit(size).agg(F.max("version")).first()[0] if more else last[0]
    rows = since(log, from_version).where(F.col("version") <= to)
    return Batch(rows, from_version, to, more, batch_hash(rows))


def batch_hash(changes: DataFrame) -> str:
    """SHA-256 over the changes' lines in the order of their versions. A batch has a bounded number of rows."""
    row = changes.agg(F.sha2(F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("version", line().alias("line")))), lambda x: x["line"])), 256)).first()
    return row[0]


def batches(log: DataFrame, from_version: int, size: int = 1000):
    """Every batch after a version, one after the other. Changes are numbered once, which tells where all batches end."""
    own = since(log, from_version).select(F.col("version").alias("at"))
    count = own.count()
    if not count:
        return
    ends = [r["at"] for r in numbered(own, F.col("at")).where((F.col("version") % size == 0) | (F.col("version") == count)).select("at").collect()]
    for to in (ends := sorted(ends)):
        rows = log.where((F.col("version") > from_version) & (F.col("version") <= to))
        yield Batch(rows, from_version, to, to != ends[-1], batch_hash(rows))
        from_version = to


def statistics(log: DataFrame) -> DataFrame:
    return log.agg(F.max("version").alias("max_version"), F.min("version").alias("min_version"), F.count("*").alias("entries"))


def without_echo(log: DataFrame, origin: str) -> DataFrame:
    """Changes that did not come from ``origin``."""
    return log.where(~F.col("origin").eqNullSafe(F.lit(origin)))


def latest(log: DataFrame) -> DataFrame:
    """The last change of each row; pre-aggregated where it lies, so hot rows move once per task."""
    last = F.max_by(F.struct("operation", "payload", "origin", "timestamp"), "version")
    rows = log.groupBy("table_name", "pk_value").agg(F.max("version").alias("version"), last.alias("c"))
    return rows.select("version", "table_name", "pk_value", "c.operation", "c.payload", "c.origin", "c.timestamp")


def state(log: DataFrame) -> DataFrame:
    """The rows that a log leaves: the last image of each row that is not deleted."""
    return latest(log).where(F.col("operation") != "delete")


def capture(before: DataFrame, after: DataFrame, table: str, key: str, origin: str, timestamp: str, from_version: int = 0, suppressed: bool = False) -> DataFrame:
    """The change log between two snapshots of a table with a single-column key.

    Rows that differ give inserts, updates and deletes; deletes have no payload. Versions follow the order of keys. While
    suppressed there is none.
    """
    both = before.select(F.col(key).alias("k"), canonical_json(before).alias("old")).join(after.select(F.col(key).alias("k"), canonical_json(after).alias("new")), "k", "full")
    changed = both.where(~F.col("old").eqNullSafe(F.col("new")))
    if suppressed:
        changed = changed.limit(0)
    operation = F.when(F.col("old").isNull(), "insert").when(F.col("new").isNull(), "delete").otherwise("update")
    rows = changed.select(F.lit(table).alias("table_name"), F.to_json(F.struct(F.col("k").alias(key))).alias("pk_value"), operation.alias("operation"), F.col("new").alias("payload"), F.lit(origin).alias("origin"), F.lit(timestamp).alias("timestamp"), "k")
    return numbered(rows, F.col("k"), from_version).select(*COLUMNS)


def numbered(rows: DataFrame, order: Column, after: int = 0) -> DataFrame:
    """Adds ``version``: after + 1, after + 2 and so on by ``order``, without bringing all rows to one task.

    Rows are ranged by the order; each range counts from the sizes of those before it, which are as few as the ranges.
    """
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keyed = rows.withColumn("__order", order)
    kind = keyed.schema["__order"].dataType
    if kind.simpleString() in ("string", "binary"):
        # Quantiles of the keys with the least hashes; they steer where the ranges end, and all rows are ranged.
        some = keyed.select("__order").where("__order is not null").orderBy(F.xxhash64("__order")).limit(64 * parts).collect()
        some = sorted(r[0].encode() if isinstance(r[0], str) else bytes(r[0]) for r in some)
        cuts = [x.decode() if kind.simpleString() == "string" else x for x in sorted(set(some[len(some) * i // parts] for i in range(1, parts) if some))]
    else:
        cuts = sorted(set(keyed.agg(F.percentile_approx("__order", [i / parts for i in range(1, parts)] or [0.5], 1000)).first()[0] or []))
    steps = [1 << k for k in reversed(range(len(cuts).bit_length()))]
    at_or_below = lambda k: F.coalesce(F.get(F.array(*[F.lit(c).cast(kind) for c in cuts]), k) <= F.col("__order"), F.lit(False))
    found = F.aggregate(F.lit(steps), F.lit(0), lambda k, step: k + F.when(at_or_below(k + step - 1), step).otherwise(0)) if cuts else F.lit(0)
    # Nulls sort first, as in a window.
    keyed = keyed.withColumn("__range", F.when(F.col("__order").isNull(), -1).otherwise(found))
    sizes = keyed.groupBy("__range").agg(F.count("*").alias("__n"))
    starts = sizes.select(F.col("__range").alias("r"), (F.coalesce(F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("__start"))
    own = keyed.join(starts, F.col("__range").eqNullSafe(F.col("r")))
    place = F.row_number().over(Window.partitionBy("__range").orderBy("__order"))
    return own.withColumn("version", (place + F.col("__start") + after).cast("long")).drop("__order", "__range", "__start", "r")
