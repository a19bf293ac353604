"""Helpers that the operators of this subpackage share.

Intermediate tables go to the folder the cluster names in ``spark.checkpoint.dir`` as Parquet, so a lost executor
costs a reread, never a wrong result.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_SETTING = "spark.checkpoint.dir"
_written: dict[int, list[str]] = {}


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder. Where none is set, a master on this machine (tests) gets a temporary folder, and any
    other has none that all executors share: an error."""
    context = spark.sparkContext
    folder = spark.conf.get(_SETTING, None) or context.getConf().get(_SETTING)
    if not folder and context._jsc.sc().getCheckpointDir().isDefined():
        folder = context._jsc.sc().getCheckpointDir().get()
    if not folder:
        if not (context.master or "").startswith("local"):
            raise ValueError(f"{_SETTING} must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="millrace-")
        spark.conf.set(_SETTING, folder)
    return folder.rstrip("/")


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Writes ``df`` to the shared folder and returns it read back: a durable cut of the lineage."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/millrace-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.setdefault(id(spark.sparkContext), []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Deletes every table that materialise() wrote in this session; results not yet stored must not be used after."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in _written.pop(id(spark.sparkContext), []):
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)


#: Rows that one task puts in order; more rows are cut into ranges.
RANGE = 1 << 16


def accumulated(df: DataFrame, within: list[str], order: list[Column], sums: dict[str, Column], tag: str, rows: int | None = None, most: int = RANGE) -> DataFrame:
    """``df`` with the columns ``sums``: of each row the sum over the rows before it, in ``order`` among those with equal ``within``.

    ``order`` must tell all rows of a group apart; sums must be exact (whole numbers, or fractions that add up exactly).
    Above ``most`` rows the table is cut into ranges of about as many, at most one a task; each adds the sums of the
    ranges before it, so no group, however large, comes to one task. Give a stored table: it is counted first.
    """
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = min(tasks, -(-(df.count() if rows is None else rows) // most))
    zero = {k: F.lit(0).cast(df.select(F.sum(v)).schema[0].dataType) for k, v in sums.items()}

    def over(v: Column, groups: list[str], by: list[Column], k: str) -> Column:
        line = Window.partitionBy(*groups).orderBy(*by) if groups else Window.orderBy(*by)
        return F.coalesce(F.sum(v).over(line.rowsBetween(Window.unboundedPreceding, -1)), zero[k])

    if ranges < 2:
        return df.select("*", *[over(v, within, order, k).alias(k) for k, v in sums.items()])
    cut = materialise(df.repartitionByRange(ranges, *[F.col(w) for w in within], *order).withColumn("__range", F.spark_partition_id()), f"{tag}-ranges")
    # As few rows in a group as there are ranges.
    starts = cut.groupBy("__range", *within).agg(*[F.sum(v).alias(k) for k, v in sums.items()])
    starts = starts.select("__range", *within, *[over(F.col(k), within, [F.col("__range")], k).alias(f"__{k}") for k in sums])
    own = cut.select("*", *[over(v, ["__range", *within], order, k).alias(k) for k, v in sums.items()]).alias("o")
    same = F.col("o.__range") == F.col("s.__range")
    for w in within:
        same = same & F.col(f"o.{w}").eqNullSafe(F.col(f"s.{w}"))
    joined = own.join(starts.alias("s"), same)
    return joined.select(*[F.col(f"o.{c}") for c in df.columns], *[(F.col(f"o.{k}") + F.col(f"s.__{k}")).alias(k) for k in sums])


def fingerprint_of_row(df: DataFrame) -> Column:
    """A hash of all columns that Spark can hash: equal rows have equal ones."""
    plain = [F.col(f"`{f.name}`") for f in df.schema if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    return F.xxhash64(*plain)


def runs_of(batches: Iterable[pa.RecordBatch], keys: list[str], columns: list[str], most: int | None = None) -> Iterator[tuple[dict[str, np.ndarray], np.ndarray | None]]:
    """Cuts sorted batches into pieces that never split a run of equal keys.

    Yields the columns of the piece as arrays, and the offsets where its runs start (with the end appended). Memory
    holds one batch and the longest run. With ``most``, a run that grows past so many rows is given in pieces of its own,
    with None for the offsets, and memory holds about that many rows.
    """
    held: dict[str, list[np.ndarray]] = {c: [] for c in columns}
    long: dict[str, object] | None = None

    def give(parts: dict[str, np.ndarray]):
        n = len(parts[columns[0]])
        change = np.zeros(n, bool)
        change[0] = True
        for k in keys:
            change[1:] |= parts[k][1:] != parts[k][:-1]
        return parts, np.append(np.flatnonzero(change), n)

    for batch in batches:
        if not batch.num_rows:
            continue
        new = {c: batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in columns}
        if long is not None:
            same = int(np.logical_and.reduce([new[k] == long[k] for k in keys]).sum())
            if same:
                yield {c: new[c][:same] for c in columns}, None
            if same == batch.num_rows:
                continue
            new, long = {c: new[c][same:] for c in columns}, None
        last = np.zeros(len(new[columns[0]]), bool)
        for k in keys:
            last |= new[k] != new[k][-1]
        cut = int(np.flatnonzero(last)[-1]) + 1 if last.any() else 0
        joins = held[columns[0]] and all(held[k][-1][-1] == new[k][0] for k in keys)
        if held[columns[0]] and (cut or not joins):
            # What is held ends inside this batch: either before it, or at the end of this batch's first run.
            stop = cut if joins else 0
            yield give({c: np.concatenate([*held[c], new[c][:stop]]) for c in columns})
            held = {c: [] for c in columns}
            new = {c: new[c][stop:] for c in columns}
            cut -= stop
        if cut:
            yield give({c: new[c][:cut] for c in columns})
        for c in columns:
            held[c].append(new[c][cut:])
        if most and sum(map(len, held[columns[0]])) > most:
            long = {k: held[k][-1][-1] for k in keys}
            yield {c: np.concatenate(held[c]) for c in columns}, None
            held = {c: [] for c in columns}
    if held[columns[0]]:
        yield give({c: np.concatenate(held[c]) for c in columns})


def forest(n: int, near: Callable[[int, np.ndarray], np.ndarray]) -> np.ndarray:
    """For rows 0..n-1, the first row of each one's component; near(i, rows) says which of rows link with row i.

    Every row is looked up once against the rows that no component has yet, so a dense group costs little.
    """
    root, rest = np.arange(n), np.arange(n)
    while len(rest):
        first, rest = rest[0], rest[1:]
        todo = [first]
        while todo and len(rest):
            hit = near(todo.pop(), rest)
            if hit.any():
                got = rest[hit]
                root[got] = first
                todo.extend(got.tolist())
                rest = rest[~hit]
    return root


def connect(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest row of each row's component under links a-b, of rows 0..n-1."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while not np.array_equal(further := new[new], new):
            new = further
        if np.array_equal(new, root):
            return root
        root = new


#: Edges that one task connects in memory (16 bytes each); more are contracted first.
FEW_EDGES = 1 << 18


def _solved(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of all edges of a graph: (hi, to) for every node that isn't its component's smallest."""
    table = pa.Table.from_batches(list(batches), pa.schema([("hi", pa.int64()), ("lo", pa.int64())]))
    hi, lo = (table.column(c).to_numpy() for c in ("hi", "lo"))
    nodes, at = np.unique(np.concatenate((hi, lo)), return_inverse=True)
    root = connect(len(nodes), at[: len(hi)], at[len(hi) :])
    tied = np.flatnonzero(root != np.arange(len(nodes)))
    yield pa.RecordBatch.from_arrays([pa.array(nodes[tied]), pa.array(nodes[root[tied]])], ["hi", "to"])


def connected_components(edges: DataFrame, tag: str = "components", few: int = FEW_EDGES) -> DataFrame:
    """Of edges (a long, b long): (node, component) for every node that has a smaller one in its component.

    The component is its smallest node; nodes that are not returned are their own. Each round hooks every node to its
    smallest neighbour, shortens the paths, and contracts the edges, so the rounds grow with the logarithm of the graph;
    once ``few`` edges are left, one task connects them. Nothing but the number of edges comes to the driver. Each join
    reads stored tables on both sides, so that a hub's rows can be split when they are dealt out.
    """
    edges = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), f"{tag}-edges")
    hooks: list[DataFrame] = []
    while (left := edges.count()) > few:
        hook = materialise(edges.groupBy("hi").agg(F.min("lo").alias("to")), f"{tag}-hooks")
        # Paths are followed to their ends: a hook that ended at a hooked node would tear its component apart.
        while True:
            for _ in range(2):
                further = hook.select(F.col("hi").alias("to"), F.col("to").alias("next"))
                hook = hook.join(further, "to", "left").select("hi", F.coalesce("next", "to").alias("to"))
            hook = materialise(hook, f"{tag}-hooks")
            if hook.join(hook.select(F.col("hi").alias("to")), "to", "left_semi").isEmpty():
                break
        hooks.append(hook)
        low = hook.select(F.col("hi").alias("lo"), F.col("to").alias("low"))
        moved = edges.join(hook, "hi").join(low, "lo", "left").select("to", F.coalesce("low", "lo").alias("lo")).where("to <> lo")
        edges = materialise(moved.select(F.greatest("to", "lo").alias("hi"), F.least("to", "lo").alias("lo")).distinct(), f"{tag}-edges")
    if left:
        hooks.append(materialise(edges.repartition(1).mapInArrow(_solved, "hi long, to long"), f"{tag}-hooks"))
    if not hooks:
        return edges.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    out = hooks[-1].select(F.col("hi").alias("node"), F.col("to").alias("component"))
    for hook in reversed(hooks[:-1]):
        later = out.select(F.col("node").alias("to"), "component")
        out = out.unionByName(hook.join(later, "to", "left").select(F.col("hi").alias("node"), F.coalesce("component", "to").alias("component")))
    return out
