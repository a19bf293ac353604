"""Repeated passages by sparse suffix arrays.

Of all suffixes (at word starts), only those at minimiser positions are retained: a position is one if the hash of its
next HEAD words is the least within a window of WINDOW positions. Any PASSAGE = HEAD + WINDOW - 1 words hold one, at the
same place wherever they stand, so equal passages retain equal suffixes. Suffixes that agree in their head come together
and are sorted; neighbours that agree in a whole passage from the head on are equal there, and the match is extended to
the left word by word: for each further word before the head the sort is taken anew over the passages that start there,
since the best partner of a longer left side need not be a neighbour in the order of the right sides. So a word is
reported if and only if it lies in a passage of PASSAGE words that another row has too.

Words are compared by 64-bit hashes: of a passage travel the 64 bits of its head's hash and 48 bits of its own, both
made of whole word hashes. Passages that differ are taken for equal with probability 2^-48 a pair of equal heads.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import connected_components, materialise, runs_of

HEAD, WINDOW = 26, 25
PASSAGE, REACH = HEAD + WINDOW - 1, WINDOW - 1
#: Bytes of a passage's hash that travel.
WIDE = 6
#: Suffixes of one head that a task compares in memory; those of a head with more are compared by an aggregation.
MOST_OF_HEAD = 1 << 18
#: One document in so many is looked at for crowded heads beforehand, and the fewest suffixes there that make one. Both
#: steer how the work is dealt out and never the result.
LOOK, CROWD = 16, 32
_BASE = 0x9E3779B97F4A7C15
_MIX = 0xD6E8FEB86659FD93
#: Odd weights by which the passages around a head add up to one sum.
_WEIGHTS = np.random.default_rng(3).integers(1, 1 << 63, WINDOW, np.uint64) * np.uint64(2) + np.uint64(1)
_FOUND = ["row", "doc_id", "start", "stop", "other", "other_id"]
_SUFFIX = ["key", "at", "rest", "sum", "passages", "more"]


class _Hashes(dict):
    """Hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


@lru_cache(maxsize=1)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    n = 1 << bits
    with np.errstate(over="ignore"):
        up = np.multiply.accumulate(np.full(n, _BASE, np.uint64))
        down = np.multiply.accumulate(np.full(n, pow(_BASE, -1, 1 << 64), np.uint64))
    return up, down


def rolled(hashes: np.ndarray, *sizes: int) -> list[np.ndarray]:
    """For each size, the hashes of all runs of so many words."""
    up, down = _powers(max(16, len(hashes).bit_length()))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes * up[: len(hashes)], dtype=np.uint64)))
    out = []
    for size in sizes:
        h = (sums[size:] - sums[:-size]) * down[: len(sums) - size]
        h ^= h >> np.uint64(32)
        h *= np.uint64(_MIX)
        h ^= h >> np.uint64(32)
        out.append(h)
    return out


def retained(heads: np.ndarray) -> np.ndarray:
    """Positions of the minimisers among a document's head hashes."""
    if len(heads) < WINDOW:
        return np.empty(0, np.int64)
    least = np.lib.stride_tricks.sliding_window_view(heads, WINDOW).argmin(axis=1) + np.arange(len(heads) - WINDOW + 1)
    return least[np.concatenate(([True], least[1:] != least[:-1]))]


def _words(text: pa.Scalar) -> list[bytes]:
    return (text.as_py() or "").encode("utf-8", "surrogatepass").split()


def _heads(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The head of every retained suffix."""
    known = _Hashes()
    for batch in batches:
        for words in map(_words, batch.column(0)):
            if len(words) >= PASSAGE:
                (heads,) = rolled(np.fromiter(map(known.__getitem__, words), np.uint64, len(words)), HEAD)
                yield pa.RecordBatch.from_arrays([pa.array(heads[retained(heads)].view(np.int64))], ["key"])


def _runs(places: np.ndarray) -> np.ndarray:
    """The first and the last place of each run of ascending places at most a passage apart, one after the other."""
    apart = np.flatnonzero(np.diff(places) > PASSAGE)
    return np.stack((places[np.append(0, apart + 1)], places[np.append(apart, len(places) - 1)]), axis=1).ravel()


def _suffixes(crowded: np.ndarray):
    """Rows (deal, crowd, key, row, doc_id, at, rest, passages, more): retained suffixes with the hashes of the passages around them.

    Suffixes of one document that agree in all that is compared (periodic texts have many) are one row: the first, with
    the places of all of them in ``more``: the first and the last of each run of places at most a passage apart, whose
    stretches touch whatever they are. Suffixes of a crowded head are dealt out evenly, others by their head.
    """

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, around = _Hashes(), np.arange(WINDOW) - REACH
        for batch in batches:
            parts: list[list] = [[], [], [], [], [], []]
            for k, words in enumerate(map(_words, batch.column(2))):
                if len(words) < PASSAGE:
                    continue
                heads, passages = rolled(np.fromiter(map(known.__getitem__, words), np.uint64, len(words)), HEAD, PASSAGE)
                at = retained(heads)
                heads, rest = heads[at], np.minimum(len(words) - HEAD - at, REACH)
                wide = passages[np.clip(at[:, None] + around, 0, len(passages) - 1)]
                more: list[list[int] | None] = [None] * len(at)
                if len(np.unique(heads)) < len(heads):
                    _, first, which = np.unique(heads + _sums(wide, at, rest), return_index=True, return_inverse=True)
                    order, sizes = np.argsort(which, kind="stable"), np.bincount(which)
                    more = [_runs(p).tolist() if len(p) > 1 else None for p in np.split(at[order], np.cumsum(sizes)[:-1])]
                    at, heads, rest, wide = at[first], heads[first], rest[first], wide[first]
                for column, x in zip(parts, (heads.view(np.int64), np.full(len(at), k), at, rest, wide, more), strict=True):
                    column.append(x)
            if parts[0]:
                key, k, at, rest, wide = map(np.concatenate, parts[:5])
                raw = np.ascontiguousarray(wide[:, :, None].view(np.uint8).reshape(len(key), WINDOW, 8)[:, :, 8 - WIDE :])
                raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(WIDE * WINDOW), len(key), [None, pa.py_buffer(raw)]).cast(pa.binary())
                take, more = pa.array(k), pa.array([m for own in parts[5] for m in own], pa.list_(pa.int32()))
                crowd, row = np.isin(key, crowded), batch.column(0).take(take)
                spread = (row.to_numpy().view(np.uint64) * np.uint64(_BASE) + at.astype(np.uint64) * np.uint64(_MIX)).view(np.int64)
                deal = np.where(crowd, spread, key)
                columns = [pa.array(deal), pa.array(crowd), pa.array(key), row, batch.column(1).take(take), pa.array(at.astype(np.int32)), pa.array(rest.astype(np.int32)), raw, more]
                yield pa.RecordBatch.from_arrays(columns, ["deal", "crowd", "key", "row", "doc_id", "at", "rest", "passages", "more"])

    return rows


def _wide(raw: np.ndarray) -> np.ndarray:
    """The passages' hashes of rows as numbers; their lost low bytes are zero."""
    out = np.zeros((len(raw), WINDOW, 8), np.uint8)
    out[:, :, 8 - WIDE :] = np.frombuffer(b"".join(raw.tolist()), np.uint8).reshape(len(raw), WINDOW, WIDE)
    return out.reshape(len(raw), WINDOW * 8).view(np.uint64)


def _sums(wide: np.ndarray, at: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """A sum of all that is compared: equal only for suffixes with equal passages around them."""
    kept = wide >> np.uint64(8 * (8 - WIDE))
    j = np.arange(WINDOW)
    kept = np.where((REACH - j <= at[:, None]) & (j <= rest[:, None]), kept, np.uint64(0))
    mixed = (kept ^ (kept << np.uint64(23))) * np.uint64(_MIX)
    mixed ^= mixed >> np.uint64(29)
    return (mixed * _WEIGHTS).sum(axis=1, dtype=np.uint64) + (np.minimum(at, REACH) * 64 + rest).astype(np.uint64) * np.uint64(_BASE)


def _spread(hit: np.ndarray, columns: dict[str, np.ndarray], start: np.ndarray, stop: np.ndarray, other: np.ndarray) -> list[np.ndarray]:
    """Stretches for all places of the suffixes ``hit``; those of one suffix that touch are joined."""
    row, ids, at, more = (columns[c] for c in ("row", "doc_id", "at", "more"))
    out: list[list] = [[row[hit]], [ids[hit]], [start], [stop], [row[other]], [ids[other]]]
    for k in np.flatnonzero(np.array([more[h] is not None for h in hit], bool)):
        h, o = hit[k], other[k]
        by = np.asarray(more[h], np.int64) - at[h]
        a, b = start[k] + by[::2], stop[k] + by[1::2]
        new = np.concatenate(([True], a[1:] > b[:-1]))
        a, b = a[new], b[np.append(np.flatnonzero(new)[1:], len(b)) - 1]
        for column, x in zip(out, (np.full(len(a), row[h]), np.full(len(a), ids[h]), a, b, np.full(len(a), row[o]), np.full(len(a), ids[o])), strict=True):
            column.append(x)
    return [np.concatenate(x) for x in out]


def _compared(most: int):
    """Over suffixes sorted by head: stretches (row, doc_id, start, stop, other, other_id) of what lies in a passage that
    another row has too, one for each other row that stands for a group of equal passages. Suffixes of crowded heads
    come back as they are, with no stretch."""
    names = ["crowd", "key", "row", "doc_id", "at", "rest", "passages", "more"]

    def given(columns: list[pa.Array], length: int, suffix: bool) -> pa.RecordBatch:
        kinds = [pa.int64()] * 6 if suffix else [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.int32())]
        blank = [pa.nulls(length, k) for k in kinds]
        if suffix:  # row and doc_id go with both kinds
            return pa.RecordBatch.from_arrays([*columns[:2], *blank[2:], *columns[2:]], _FOUND + _SUFFIX)
        return pa.RecordBatch.from_arrays([*columns, *blank], _FOUND + _SUFFIX)

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, cuts in runs_of(batches, ["crowd", "key"], names, most):
            n = len(piece["key"])
            aside = piece["crowd"] if cuts is not None else np.ones(n, bool)
            for back in np.array_split(np.flatnonzero(aside), aside.sum() // (1 << 14) + 1) if aside.any() else ():
                own = {c: piece[c][back] for c in names}
                sums = _sums(_wide(own["passages"]), own["at"].astype(np.int64), own["rest"].astype(np.int64))
                raw = [pa.array(own["passages"], pa.binary()), pa.array(own["more"], pa.list_(pa.int32()))]
                yield given([pa.array(own["row"]), pa.array(own["doc_id"]), pa.array(own["key"]), pa.array(own["at"]), pa.array(own["rest"]), pa.array(sums.view(np.int64)), *raw], len(back), True)
            if cuts is None:
                continue
            lengths = np.diff(cuts)
            pick = np.flatnonzero(np.repeat(lengths > 1, lengths) & ~aside)
            if not len(pick):
                continue
            run = np.repeat(np.arange(len(lengths)), lengths)[pick]
            own = {c: piece[c][pick] for c in names}
            # Rows go by document id, those without one last: the first and the last of a group don't depend on the split.
            order = np.lexsort((own["row"], own["doc_id"], own["row"] < 0))
            run, own = run[order], {c: x[order] for c, x in own.items()}
            row, at, rest, wide = own["row"], own["at"].astype(np.int64), own["rest"], _wide(own["passages"])
            first, last, partner, pairs = np.full(len(row), REACH + 1), np.full(len(row), -1), np.full(len(row), -1), []
            for j in range(REACH, -1, -1):  # passages from the head on, then with one word more before it, and so on
                it = np.flatnonzero((REACH - j <= at) & (j <= rest))
                if len(it) < 2:
                    continue
                it = it[np.lexsort((wide[it, j], run[it]))]
                differ = np.concatenate(([True], (wide[it[1:], j] != wide[it[:-1], j]) | (run[it[1:]] != run[it[:-1]])))
                starts, group = np.flatnonzero(differ), np.cumsum(differ) - 1
                lo, hi = it[starts][group], it[np.append(starts[1:], len(it)) - 1][group]
                shared = row[lo] != row[hi]
                hit, other = it[shared], np.where(row[it] == row[lo], hi, lo)[shared]
                first[hit], last[hit] = j, np.maximum(last[hit], j)
                new = row[partner[hit]] != row[other]
                new |= partner[hit] < 0
                pairs.append(np.stack((hit[new], other[new])))
                partner[hit] = other
            if pairs and (found := np.concatenate(pairs, axis=1)).size:
                _, keep = np.unique(np.stack((found[0], row[found[1]])), axis=1, return_index=True)
                hit, other = found[:, keep]
                done = _spread(hit, own, at[hit] - (REACH - first[hit]), at[hit] + HEAD + last[hit], other)
                yield given(list(map(pa.array, done)), len(done[0]), False)

    return rows


def _of_crowds(suffixes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stretches of the suffixes of crowded heads, by aggregation: suffixes with equal surroundings count as one, so that
    a third of all rows can share a passage. A suffix has one stretch for each run of its places, with the least of the
    rows that stand for its groups; the links (a, b) join the rows that stand for the groups that meet in one suffix."""
    who = F.struct((F.col("row") < 0).alias("none"), "doc_id", "row")
    alike = suffixes.groupBy("key", "sum").agg(F.min(who).alias("lo"), F.max(who).alias("hi"), F.first("passages").alias("passages"), F.first(F.least("at", F.lit(REACH))).alias("at"), F.first("rest").alias("rest"))
    fitting = F.expr(f"filter(sequence(0, {REACH}), j -> {REACH} - j <= at and j <= rest)")
    each = F.transform(fitting, lambda j: F.struct(j.alias("j"), F.substring("passages", j * WIDE + 1, F.lit(WIDE)).alias("passage")))
    own = materialise(alike.select("key", "sum", "lo", "hi", F.inline(each)), "suffix-crowds")
    shared = own.groupBy("key", "j", "passage").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo.row <> hi.row")
    met = own.drop("lo", "hi").join(materialise(shared, "suffix-shared"), ["key", "j", "passage"])
    # At most WINDOW different groups meet in one suffix.
    met = materialise(met.groupBy("key", "sum").agg(F.min("j").alias("first"), F.max("j").alias("last"), F.collect_set(F.struct("lo", "hi")).alias("groups")), "suffix-met")
    rows = F.array_distinct(F.transform("groups", lambda g: g["lo"]["row"]))
    links = met.select(rows.alias("rows")).where("size(rows) > 1").select(F.col("rows")[0].alias("a"), F.explode(F.expr("slice(rows, 2, size(rows) - 1)")).alias("b"))
    least = F.array_min(F.transform("groups", lambda g: F.when(F.col("row") == g["lo"]["row"], g["hi"]).otherwise(g["lo"])))
    own = suffixes.join(met, ["key", "sum"]).select("row", "doc_id", "first", "last", least.alias("with"), F.coalesce("more", F.array("at", "at")).alias("runs"))
    out = own.select("row", "doc_id", "first", "last", "with", F.inline(F.expr("transform(sequence(0, size(runs) - 2, 2), k -> struct(cast(runs[k] as long) as from, cast(runs[k + 1] as long) as to))")))
    start, stop = F.col("from") - REACH + F.col("first"), F.col("to") + HEAD + F.col("last")
    return out.select("row", "doc_id", start.alias("start"), stop.alias("stop"), F.col("with.row").alias("other"), F.col("with.doc_id").alias("other_id")), links


def repeated_passages(docs: DataFrame, most: int = MOST_OF_HEAD, look: int = LOOK, crowd: int = CROWD) -> DataFrame:
    """Of (doc_id, text): (doc_id, start, stop, n_words, other_doc, component_id) of every stretch made of passages that another row has.

    Words are what ASCII white space separates; start and stop (exclusive) count words from 0. other_doc is a document
    that shares part of the stretch: of the groups of rows with an equal passage the smallest id, and for that one the
    largest; of several the smallest. component_id is the smallest doc_id that chains of shared passages reach, itself
    included. Documents without such a passage have no row: texts that are null or shorter than a passage never have, nor
    has a passage that repeats within one document only. A repeated row counts as another document. A null doc_id is
    kept and comes after all others; a component of such only has a null id. Other columns are ignored; an empty table
    gives no rows. The result does not depend on how the input is split.
    """
    spark = docs.sparkSession
    # A row's number is negative where it has no id.
    number = F.monotonically_increasing_id()
    own = docs.select(F.when(F.col("doc_id").isNull(), -1 - number).otherwise(number).alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc_id"), "text")
    # Heads that hold more than an eighth of a task's share; there are at most eight times the tasks of them.
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    seen = own.where(F.pmod(F.xxhash64("doc_id", F.col("row") < 0, F.length("text")), F.lit(look)) == 0).select("text").mapInArrow(_heads, "key long")
    seen = materialise(seen.groupBy("key").agg(F.count("*").alias("n")), "suffix-heads")
    every = seen.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    crowded = seen.where((F.col("n") >= crowd) & (F.col("n") * (8 * tasks) > every)).select("key").collect()
    keys = np.array(sorted(r["key"] for r in crowded), np.int64)
    suffixes = own.mapInArrow(_suffixes(keys), "deal long, crowd boolean, key long, row long, doc_id long, at int, rest int, passages binary, more array<int>")
    dealt = suffixes.repartition("deal").drop("deal").sortWithinPartitions("crowd", "key")
    found = materialise(dealt.mapInArrow(_compared(most), "row long, doc_id long, start long, stop long, other long, other_id long, key long, at int, rest int, sum long, passages binary, more array<int>"), "suffix-found")
    aside = found.where("key is not null").select("row", "doc_id", *_SUFFIX)
    found = found.where("key is null").select(*_FOUND)
    links = found.select(F.col("row").alias("a"), F.col("other").alias("b"))
    if not aside.isEmpty():
        stretches, more = _of_crowds(aside)
        found = materialise(found.unionByName(stretches), "suffix-all")
        links = found.select(F.col("row").alias("a"), F.col("other").alias("b")).unionByName(more)
    # Stretches of one document that touch or overlap become one.
    line = Window.partitionBy("row").orderBy("start", "stop")
    reached = F.max("stop").over(line.rowsBetween(Window.unboundedPreceding, -1))
    merged = found.withColumn("new", F.coalesce((F.col("start") > reached).cast("int"), F.lit(1)))
    merged = merged.withColumn("stretch", F.sum("new").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    other = F.min(F.struct((F.col("other") < 0).alias("none"), F.col("other_id").alias("id"))).alias("other")
    merged = materialise(merged.groupBy("row", "stretch").agg(F.first("doc_id").alias("doc_id"), F.min("start").alias("start"), F.max("stop").alias("stop"), other), "suffix-stretches")
    parts = connected_components(links, "suffix")
    merged = merged.join(parts.withColumnRenamed("node", "row"), "row", "left").withColumn("component", F.coalesce("component", "row"))
    merged = materialise(merged, "suffix-owned")
    least = merged.groupBy("component").agg(F.min(F.struct((F.col("row") < 0).alias("none"), F.col("doc_id").alias("id"))).alias("least"))
    out = merged.join(materialise(least, "suffix-least"), "component")

    def shown(none: str, value: str):
        return F.when(~F.expr(none), F.col(value))

    return out.select(shown("row < 0", "doc_id").alias("doc_id"), "start", "stop", (F.col("stop") - F.col("start")).alias("n_words"), shown("other.none", "other.id").alias("other_doc"), shown("least.none", "least.id").alias("component_id"))
