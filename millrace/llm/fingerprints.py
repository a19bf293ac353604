"""Document fingerprints by SimHash, and search by permuted block tables, in DataFrame operations only.

A document's terms are its five-word shingles, each weighing as often as it occurs. Every bit of a term's hash votes with
the term's weight for or against that bit; the fingerprint has the bits that win. Votes are summed two bits to a long, in
halves of 32 bits, which no text can overflow. Search cuts the fingerprint into radius + 3 blocks: two fingerprints
within the radius agree in three blocks at least, so a table for each choice of three blocks, permuted to the front as
the key, finds every pair.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHINGLE = 5
RADIUS = 3
_SPACES = " \t\n\v\f\r"
_PAIR = 0x0000000100000001


def term_hashes(text: Column) -> Column:
    """Hashes of all shingles of the lower-cased words; fewer words than a shingle has are one term, none give no term."""
    trimmed = F.btrim(F.lower(F.coalesce(text, F.lit(""))), F.lit(_SPACES))
    words = F.split(trimmed, r"[\x20\x09-\x0D]+")
    hashes = F.transform(words, lambda w: F.xxhash64(w))

    def shingles(h: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(h) - SHINGLE)
        return F.transform(at, lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(SHINGLE)]))

    # One pass through a one-element array binds the hashes to a name, so that they are made once.
    many = F.flatten(F.transform(F.array(hashes), lambda h: F.when(F.size(h) < SHINGLE, F.array(F.xxhash64(h))).otherwise(shingles(h))))
    return F.when(trimmed == "", F.array().cast("array<bigint>")).otherwise(many)


def votes(hash_: Column) -> list[Column]:
    """Sums whose halves count the hashes with bit j and with bit j + 32."""
    return [F.sum(F.shiftrightunsigned(hash_, j).bitwiseAND(F.lit(_PAIR))).alias(f"v{j}") for j in range(32)]


def decided(total: Column) -> Column:
    """The fingerprint of the sums that votes() made."""
    out = F.lit(0).cast("long")
    for j in range(32):
        low, high = F.col(f"v{j}").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(F.col(f"v{j}"), 32)
        for bit, count in ((j, low), (j + 32, high)):
            out = out.bitwiseOR(F.when(count * 2 > total, F.lit((1 << bit) - (1 << 64) * (bit == 63))).otherwise(F.lit(0)).cast("long"))
    return out


def likeness(a: Column, b: Column) -> Column:
    return (64 - F.bit_count(a.bitwiseXOR(b))) / 64.0


def as_text(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _range_of(docs: DataFrame, parts: int) -> Column:
    """The number of a row's range, ascending in (doc_id, hash of the text), nulls first; about ``parts`` of about equal size."""
    none = -(1 << 63)
    key = F.coalesce("doc_id", F.lit(none))
    cuts = docs.agg(F.percentile_approx(key, [k / parts for k in range(1, parts)] or [0.5], max(10_000, 4 * parts))).first()[0] or []
    values = sorted(set(cuts))
    if not values:
        return F.lit(0)
    ends = [bisect_right(cuts, v) for v in values]  # cuts up to each value, itself included
    array = lambda xs: F.lit(xs).cast("array<bigint>")
    # Binary search: how many values are not above the key.
    steps = [1 << k for k in reversed(range(len(values).bit_length()))]
    found = F.aggregate(F.lit(steps), F.lit(0), lambda at, step: at + F.when(F.coalesce(F.get(array(values), at + step - 1) <= key, F.lit(False)), step).otherwise(0))

    def placed(at: Column) -> Column:
        end, start = F.coalesce(F.get(array(ends), at - 1), F.lit(0)), F.coalesce(F.get(array(ends), at - 2), F.lit(0))
        # A value that is several cuts fills several ranges; they share its rows by the top bits of the hash.
        many = (F.get(array(values), at - 1) == key) & (F.col("doc_id").isNull() | (F.col("doc_id") != none))
        top = F.shiftrightunsigned(F.xxhash64("text").bitwiseXOR(F.lit(none)), 33)
        return F.when(many, start + 1 + F.shiftright(top * (end - start), 31)).otherwise(end).cast("int")

    return F.get(F.transform(F.array(found), placed), F.lit(0))


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Of (doc_id, text): doc_id, n_chars, edited_sha256, fp, edited_fp, near_edited, near_next.

    The edited text has its last quarter (rounded down) replaced by as much from the start of the next document, by
    ascending doc_id and after the last the first; a lone document follows itself. One row per input row; rows with equal
    ids follow each other by text, null ids come first, null texts are empty. A text without words has fingerprint zero.
    Other columns are ignored; an empty table gives no rows.

    Documents are dealt out once, by ranges of doc_id between quantiles; an id (or the lack of one) that fills more than
    a range is cut further by the hash of the text. Each range also gets a copy of the row that starts the next one.
    Everything after that stays in the range's task. Only rows equal in id and text can't be parted.
    """
    spark = docs.sparkSession
    # Four ranges to a task, so that unequal ranges even out.
    parts = max(1, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.col("text")]
    own = own.withColumn("part", _range_of(own, parts)).withColumn("copy", F.lit(False))
    # As few rows on the driver as there are ranges: where each range starts, and which range comes before it.
    least = F.min(F.struct(F.col("doc_id").isNotNull().alias("id"), "doc_id", F.xxhash64("text").alias("h")))
    starts = sorted((r["part"], r["least"]["doc_id"], r["least"]["h"]) for r in own.groupBy("part").agg(least.alias("least")).collect())
    before = [(part, doc_id, h, starts[k - 1][0]) for k, (part, doc_id, h) in enumerate(starts)]
    before = spark.createDataFrame(before, "part int, doc_id long, h long, into int").alias("b")
    same = (F.col("o.part") == F.col("b.part")) & F.col("o.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.xxhash64("o.text") == F.col("b.h"))
    firsts = own.alias("o").join(F.broadcast(before), same).groupBy("into").agg(F.min(F.struct(F.col("o.text").alias("text"), F.col("o.doc_id").alias("doc_id"))).alias("one"))
    rows = own.unionByName(firsts.select("one.doc_id", "one.text", F.col("into").alias("part"), F.lit(True).alias("copy")))
    line = Window.partitionBy("part").orderBy("copy", *order)
    rows = rows.withColumn("following", F.lead("text").over(line)).withColumn("at", F.row_number().over(line))
    size, gone = F.char_length("text"), F.floor(F.char_length("text") / 4).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), size - gone), F.substr(F.coalesce("following", F.lit("")), F.lit(1), gone))
    rows = rows.select("part", "at", "copy", "doc_id", size.cast("long").alias("n_chars"), "text", edited.alias("edited"))
    sides = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("text").alias("body")), F.struct(F.lit(1).alias("side"), F.col("edited").alias("body"))))
    rows = rows.select("part", "at", "copy", "doc_id", "n_chars", F.unhex(F.sha2("edited", 256)).alias("digest"), sides.alias("s"))
    terms = rows.select("part", "at", "copy", "doc_id", "n_chars", "digest", "s.side", F.explode_outer(term_hashes(F.col("s.body"))).alias("h"))
    keys = ["part", "at", "copy", "doc_id", "n_chars", "digest"]
    counted = terms.groupBy(*keys, "side").agg(F.count("h").alias("n"), *votes(F.col("h")))
    fps = counted.select(*keys, "side", decided(F.col("n")).alias("fp"))
    both = fps.groupBy(*keys).agg(F.max(F.when(F.col("side") == 0, F.col("fp"))).alias("fp"), F.max(F.when(F.col("side") == 1, F.col("fp"))).alias("edited_fp"))
    both = both.withColumn("next_fp", F.lead("fp").over(Window.partitionBy("part").orderBy("at"))).where("not copy")
    return both.select(
        "doc_id", "n_chars", F.lower(F.hex("digest")).alias("edited_sha256"), "fp", "edited_fp", likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.coalesce("next_fp", "fp")).alias("near_next")
    )


def block_masks(radius: int = RADIUS) -> list[int]:
    """A mask for each choice of three of radius + 3 blocks."""
    n = radius + 3
    edges = [64 * k // n for k in range(n + 1)]
    blocks = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])]
    return [sum(c) for c in combinations(blocks, 3)]


def within(queries: DataFrame, fingerprints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Pairs (query, fp, distance) of distinct fingerprints of ``queries`` and of ``fingerprints`` (column fp) within the radius.

    Every pair comes once, in however many tables it meets. Queries are a stated set; no other pairs are made.
    """
    masks = [m - (1 << 64) * (m >> 63) for m in block_masks(radius)]

    def keyed(df: DataFrame, name: str) -> DataFrame:
        # A generator of its own on each side: shared, the two sides' columns could not be told apart.
        tables = F.posexplode(F.lit(masks).cast("array<bigint>")).alias("table", "mask")
        return df.select(F.col("fp").alias(name)).distinct().select(name, tables).select(name, "table", F.col(name).bitwiseAND(F.col("mask")).alias("key"))

    left, right = keyed(queries, "query"), keyed(fingerprints, "fp")
    distance = F.bit_count(F.col("query").bitwiseXOR(F.col("fp"))).cast("int")
    met = left.join(right, ["table", "key"]).select("query", "fp", distance.alias("distance"))
    return met.where(F.col("distance") <= radius).distinct()
