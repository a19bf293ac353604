"""Near-duplicate documents by SimHash and covering locality-sensitive hashing.

For radius r, bit i of a fingerprint gets a non-zero label of r + 1 bits, and each of the 2^(r+1) - 1 non-zero vectors v
gives a mask of the bits whose label has odd product with v. The labels of any r differing bits span too little to be
odd with every v, so two fingerprints within the radius agree under some mask: no pair can be missed. Each mask keeps
about half of the bits.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import connected_components, forest, materialise, runs_of

RADIUS = 4
#: A bucket with more fingerprints is cut again by masks over the bits it has left free; then 2^16 is the most it can hold.
LARGE_BUCKET = 4096


def masks(bits: list[int], radius: int) -> list[int]:
    """Covering masks over the given bit numbers."""
    size = (1 << radius + 1) - 1
    label = {bit: k % size + 1 for k, bit in enumerate(bits)}
    return [sum(1 << b for b in bits if (label[b] & v).bit_count() & 1) for v in range(1, size + 1)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(text: str | None, words_in_shingle: int = 4) -> int:
    """The majority of each bit over the hashes of all shingles, repeats included; 0 where there are no words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line, k = b" ".join(words), min(words_in_shingle, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - k + 1].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(line[a:b], 42) for a, b in zip(starts, ends[k - 1 :].tolist(), strict=True)), np.uint64, len(starts))
    set_in = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        set_in += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * set_in > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Of the columns to ``keep`` and text: those columns, fp (long, the 64 bits signed). Null text has no words: fingerprint zero."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(x.as_py()) for x in batch.column(len(keep))), np.uint64, batch.num_rows).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(fps)], [*keep, "fp"])

    own = docs.select(*keep, "text")
    return own.mapInArrow(rows, T.StructType([*own.schema.fields[:-1], T.StructField("fp", T.LongType())]))


def _linked(radius: int, large: int | None):
    """Over rows sorted by (t, key): star edges a-b of each bucket's components; rows of large buckets come back as they
    are, piece by piece as they are read."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for parts, at in runs_of(batches, ["t", "key"], ["t", "key", "fp"], large):
            if at is None:  # a piece of a large bucket, which memory needn't hold whole
                yield pa.RecordBatch.from_arrays([pa.array(parts["t"]), pa.array(parts["fp"]), pa.array(parts["key"])], ["t", "a", "b"])
                continue
            fp, lengths = parts["fp"].view(np.uint64), np.diff(at)
            a, b, again = [], [], []
            two = at[:-1][lengths == 2]
            close = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= radius]
            a.append(fp[close])
            b.append(fp[close + 1])
            for k in np.flatnonzero(lengths > 2):
                own = fp[at[k] : at[k + 1]]
                if large and len(own) > large:
                    again.append(np.arange(at[k], at[k + 1]))
                    continue
                root = forest(len(own), lambda i, rest, own=own: np.bitwise_count(own[rest] ^ own[i]) <= radius)
                tied = np.flatnonzero(root != np.arange(len(own)))
                a.append(own[root[tied]])
                b.append(own[tied])
            if again:
                pick = np.concatenate(again)
                yield pa.RecordBatch.from_arrays([pa.array(parts["t"][pick]), pa.array(parts["fp"][pick]), pa.array(parts["key"][pick])], ["t", "a", "b"])
            x, y = np.concatenate(a), np.concatenate(b)
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), -1, np.int32)), pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], ["t", "a", "b"])

    return rows


def _buckets(df: DataFrame, radius: int, large: int | None) -> DataFrame:
    return df.repartition("t", "key").sortWithinPartitions("t", "key").mapInArrow(_linked(radius, large), "t int, a long, b long")


def links(distinct: DataFrame, radius: int = RADIUS, large: int = LARGE_BUCKET) -> DataFrame:
    """Of distinct fingerprints (fp long): edges (a, b) that connect just what chains of pairs within the radius connect."""
    first = masks(list(range(64)), radius)
    tables = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key")) for t, m in enumerate(first)])
    found = materialise(_buckets(distinct.select("fp", F.inline(tables)), radius, large), "simhash-links")
    # The pairs of a large bucket agree in all bits of its mask, so masks over the other bits cover them.
    second = [masks([b for b in range(64) if not m >> b & 1], radius) for m in first]
    finer = F.lit([[signed(m | f) for f in own] for m, own in zip(first, second, strict=True)])
    rest = found.where("t >= 0").select(F.col("a").alias("fp"), "t", F.posexplode(F.get(finer, F.col("t"))).alias("u", "mask"))
    rest = rest.select("fp", (F.col("t") * 64 + F.col("u")).cast("int").alias("t"), F.col("fp").bitwiseAND(F.col("mask")).alias("key"))
    return found.where("t < 0").select("a", "b").unionByName(_buckets(rest, radius, None).select("a", "b"))


def near_duplicates(docs: DataFrame, radius: int = RADIUS, keep: tuple[str, ...] = ()) -> DataFrame:
    """Of (doc_id, text): doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id of the component), and
    component (the smallest fingerprint of the component, which tells components of null ids apart), and the columns to ``keep``.

    One row per input row, repeated rows included. Null and wordless texts have fingerprint zero and are linked like any
    other. A null doc_id is kept and counts for no component's smallest; a component of nulls only has a null id. Other
    columns are ignored; an empty table gives no rows. Equal fingerprints are one node, so copies cost nothing.
    """
    fps = materialise(fingerprints(docs, ("doc_id", *keep)), "simhash-fps")
    nodes = materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-nodes")
    parts = connected_components(links(nodes.select("fp"), radius), "simhash")
    owned = nodes.join(parts.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))
    owned = materialise(owned, "simhash-owned")
    least = owned.groupBy("component").agg(F.min("first").alias("component_id"))
    named = materialise(owned.join(least, "component").select("fp", "component_id", "component"), "simhash-named")
    return fps.join(named, "fp").select("doc_id", *keep, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "component")
