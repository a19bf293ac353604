"""Mixing sources to target weights by Sainte-Laguë apportionment, in DataFrame operations only.

Targets come from weights by water-filling under a cap. Targets become numbers of equal blocks of tokens: every block
goes to the highest of the quotients target / 1, target / 3, target / 5 and so on, first among the sources and then among
the shards of each source. A shard's documents lie in seeded order on a line that is cut into blocks; whole passes are
taken first, then the blocks that a seeded draw ranks first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import RANGE, accumulated, materialise

WEIGHTS = (3.0, 1.0, 2.0)
#: All targets together, as a share of all sizes; the most that a source gives, in times its size.
TOTAL, MOST = 1.5, 2.0
#: A block has the tokens of the total divided by the first, at most the second.
BLOCKS, LARGEST_BLOCK = 1 << 20, 256
#: Tokens in a shard.
SHARD = 1 << 20


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _joined(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``left`` with the other columns of ``right``; null keys match."""
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}"))
    return left.alias("l").join(right.alias("r"), same, how).select("l.*", *[F.col(f"r.{c}") for c in right.columns if c not in keys])


class _Steps:
    """How a table of known size is worked on: up to ``most`` rows in windows of one plan, more in stored steps of
    aggregates and joins, which bring no group to one task."""

    def __init__(self, rows: int, most: int, tag: str):
        self.rows, self.most, self.tag, self.small = rows, most, tag, rows <= most

    def store(self, df: DataFrame) -> DataFrame:
        return df if self.small else materialise(df, self.tag)

    def of_group(self, df: DataFrame, groups: list[str], **made: Column) -> DataFrame:
        """Adds aggregates of each row's group."""
        if self.small:
            return df.select("*", *[v.over(Window.partitionBy(*groups)).alias(k) for k, v in made.items()])
        return _joined(df, df.groupBy(*groups).agg(*[v.alias(k) for k, v in made.items()]), groups)

    def before(self, df: DataFrame, groups: list[str], order: list[Column], **sums: Column) -> DataFrame:
        return accumulated(df, groups, order, sums, self.tag, self.rows if self.small else None, self.most)


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, total: float = TOTAL, most: float = MOST, at_once: int = RANGE) -> DataFrame:
    """Of (source, source_size): adds target, by code point order of the source (null last) with the weights in turn.

    The sources share ``total`` times all sizes by weight; a target stops at ``most`` times its source's size and the
    excess is shared again by weight, until none is above. Sources fill up in the order of cap / weight, so one pass in
    that order finds the level at which the rest stands. Sources may be as many as hosts: above ``at_once`` no step
    brings all to one task. Give a stored table: it is counted first.
    """
    do, name = _Steps(sources.count(), at_once, "mix-targets"), [F.col("source").isNull(), F.col("source")]
    own = do.before(sources.withColumn("all", F.lit(0)), ["all"], name, turn=F.lit(1))
    own = own.withColumn("weight", F.get(F.array(*map(F.lit, weights)), (F.col("turn") % len(weights)).cast("int"))).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    own = do.store(own.withColumn("fills", F.col("cap") / F.col("weight")))
    own = do.store(do.of_group(own, ["all"], every=F.sum("source_size"), weights=F.sum("weight")))
    # From the first source that isn't filled on, levels only fall: the highest of them is that source's, and where all stand.
    own = do.before(own, ["all"], [F.col("fills"), *name], caps_before=F.col("cap"), weight_before=F.col("weight"))
    level = F.greatest(F.col("every") * F.lit(float(total)) - F.col("caps_before"), F.lit(0.0)) / (F.col("weights") - F.col("weight_before"))
    own = own.withColumn("level", level).withColumn("full", F.col("cap") <= F.col("level") * F.col("weight"))
    own = do.of_group(do.store(own), ["all"], stands=F.max(F.when(~F.col("full"), F.col("level"))))
    return own.select("source", "source_size", F.when(F.col("full"), F.col("cap")).otherwise(F.least(F.col("stands") * F.col("weight"), F.col("cap"))).alias("target"))


def apportion(parts: DataFrame, key: list[str], within: list[str], share: str, seats: str, name: str, rows: int | None = None, at_once: int = RANGE) -> DataFrame:
    """Adds ``name``: the Sainte-Laguë seats of each row, its share of the ``seats`` of the rows with the same ``within``.

    Equals handing out seats one by one to the highest quotient share / (2 taken + 1), ties by key. Rounding each share
    at the mean price gives all but a few; the next quotients up (or the last ones given) are ranked for the difference.
    How many of its own a row may need follows from its share, so the ranked rows are about three times the rows. Sums
    of shares are taken in decimals, so that their order can't matter; groups may be of any size. Give the number of
    ``rows``, or a stored table to count.
    """
    do = _Steps(parts.count() if rows is None else rows, at_once, "mix-seats")
    keys, groups = list(dict.fromkeys([*within, *key])), within or ["__all"]
    own = do.store(parts.select("*", *([] if within else [F.lit(0).alias("__all")])))
    own = do.of_group(own, groups, __sum=F.sum(F.col(share).cast("decimal(38,9)")), __rows=F.count("*"))
    own = own.withColumn("__whole", F.col("__sum").cast("double")).withColumn("__part", F.when(F.col("__whole") > 0, F.col(share) / F.col("__whole")).otherwise(F.lit(0.0)))
    own = do.of_group(do.store(own.withColumn("__first", F.floor(F.col("__part") * F.col(seats) + 0.5).cast("long"))), groups, __given=F.sum("__first"))
    own = own.withColumn("__off", F.when(F.col("__whole") > 0, F.col(seats) - F.col("__given")).otherwise(F.lit(0)).cast("long"))
    own = own.withColumn("__tries", (F.ceil(F.col("__part") * (F.abs("__off") + F.col("__rows"))) + 2).cast("long"))
    own = own.withColumn("__tries", F.when(F.col("__off") > 0, F.least("__tries", "__off")).when(F.col("__off") < 0, F.least("__tries", -F.col("__off"), "__first")).otherwise(F.lit(0)))
    step = F.explode(F.sequence(F.lit(1).cast("long"), "__tries")).alias("__step")
    gains = F.col("__off") > 0
    seat = F.when(gains, F.col("__first") + F.col("__step") - 1).otherwise(F.col("__first") - F.col("__step"))
    tried = own.where("__tries > 0").select(*dict.fromkeys([*groups, *keys]), "__part", "__first", "__off", step).withColumn("__quotient", F.col("__part") / (2 * seat + 1))
    tried = do.store(tried.withColumn("__gains", gains))
    # Of equal quotients the smaller key has the seat, so it is the first to gain one and the last to lose one.
    ups = [F.when(gains, F.col(k)) for k in key]
    downs = [F.desc(F.when(~gains, F.col(k))) for k in key]
    won = do.before(tried, groups, [F.when(gains, -F.col("__quotient")).otherwise(F.col("__quotient")), *[c.asc() for c in ups], *downs, F.asc("__step")], __rank=F.lit(1))
    won = won.where("__rank < abs(__off)").groupBy(*keys).agg(F.sum(F.signum("__off")).cast("long").alias("__more"))
    out = _joined(own, won, keys, "left")
    return out.select(*parts.columns, (F.col("__first") + F.coalesce("__more", F.lit(0))).alias(name))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, total: float = TOTAL, most: float = MOST, seed: int = 17, keep: tuple[str, ...] = ()) -> DataFrame:
    """Of (doc_id, source, text): doc_id, size (words), source_size, target (its source's), taken (words, repeats
    counted), and the columns to ``keep``.

    One row per input row, repeated rows included; no row takes more than ``most`` rounded up to whole passes times its
    size. Null texts have size 0 and take nothing. The null source is a source. Reruns agree: only doc_id, source, text
    and the seed decide. Other columns are ignored; an empty table gives no rows. A source's taken words differ from its
    target by about a block. Shards number as many as the words ask for, and no step brings a source to one task.
    """
    sized = materialise(docs.select("doc_id", "source", words(F.col("text")).alias("size"), F.xxhash64("text").alias("mark"), *keep), "mix-sizes")
    sources = materialise(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-names")
    sources = materialise(targets(sources, weights, total, most), "mix-sources")
    every, names = sources.agg(F.coalesce(F.sum(F.col("target").cast("decimal(38,9)")), F.lit(0)).cast("double"), F.count("*")).first()
    block = max(1, min(LARGEST_BLOCK, int(every / BLOCKS)))
    seats = F.lit(int(every / block + 0.5)).cast("long")
    quotas = apportion(sources.withColumn("seats", seats), ["source"], [], "target", "seats", "quota", names)
    count = F.greatest(F.ceil(F.col("source_size") / SHARD), F.lit(1)).cast("long")
    quotas = materialise(quotas.select("source", "source_size", "target", "quota", count.alias("shards")), "mix-quotas")
    most_shards = quotas.agg(F.coalesce(F.sum("shards"), F.lit(0))).first()[0]

    def with_source(left: DataFrame) -> DataFrame:
        # Stored tables on both sides, so that a hot source's rows can be split when they are dealt out.
        return left.alias("d").join(quotas.alias("q"), F.col("d.source").eqNullSafe(F.col("q.source")))

    shard = F.pmod(F.xxhash64(F.lit(seed), "d.doc_id", "d.mark"), F.col("shards"))
    placed = materialise(with_source(sized).select("d.doc_id", "d.source", "d.size", "source_size", "target", "quota", "d.mark", shard.alias("shard"), *keep), "mix-placed")
    shards = placed.groupBy("source", "shard").agg(F.sum("size").alias("words"), F.first("quota").alias("quota"))
    shards = apportion(shards, ["source", "shard"], ["source"], "words", "quota", "blocks", most_shards).select("source", "shard", "words", "blocks")
    shards = materialise(shards.withColumn("line", F.ceil(F.col("words") / block).cast("long")), "mix-shards")
    joined = placed.alias("d").join(shards.alias("s"), (F.col("d.source").eqNullSafe(F.col("s.source"))) & (F.col("d.shard") == F.col("s.shard")))
    cell, seeded = Window.partitionBy("source", "shard"), [F.xxhash64(F.lit(seed + 1), "doc_id", "mark"), F.col("doc_id"), F.col("size")]
    lined = joined.select(*keep, "doc_id", "mark", "d.source", "d.shard", "size", "source_size", "target", "line", F.least("blocks", F.ceil(F.col("line") * F.lit(float(most)))).cast("long").alias("blocks"))
    lined = lined.withColumn("end", F.sum("size").over(cell.orderBy(*seeded).rowsBetween(Window.unboundedPreceding, 0)))
    lined = lined.withColumn("passes", F.when(F.col("line") > 0, F.floor(F.col("blocks") / F.col("line"))).otherwise(F.lit(0)).cast("long")).withColumn("row", F.monotonically_increasing_id())
    lined = materialise(lined, "mix-lined")
    # The blocks of each shard, ranked by a seeded draw; those before the remainder are taken once more.
    extra = F.col("blocks") - F.floor(F.col("blocks") / F.col("line")) * F.col("line")
    some = shards.withColumn("blocks", F.least("blocks", F.ceil(F.col("line") * F.lit(float(most))))).where("line > 0").withColumn("extra", extra).where("extra > 0")
    drawn = some.select("source", "shard", "extra", F.explode(F.sequence(F.lit(0).cast("long"), F.col("line") - 1)).alias("block"))
    drawn = drawn.withColumn("rank", F.row_number().over(cell.orderBy(F.xxhash64(F.lit(seed + 2), "source", "shard", "block"), "block"))).where("rank <= extra")
    start = F.col("end") - F.col("size")
    spans = lined.where("size > 0").select("row", "source", "shard", "size", "end", F.explode(F.sequence(F.floor(start / block), F.floor((F.col("end") - 1) / block))).alias("block"))
    met = spans.alias("a").join(drawn.alias("b"), (F.col("a.source").eqNullSafe(F.col("b.source"))) & (F.col("a.shard") == F.col("b.shard")) & (F.col("a.block") == F.col("b.block")))
    overlap = F.least(F.col("end"), (F.col("a.block") + 1) * block) - F.greatest(F.col("end") - F.col("size"), F.col("a.block") * block)
    more = met.groupBy("row").agg(F.sum(overlap).alias("more"))
    taken = F.col("passes") * F.col("size") + F.coalesce("more", F.lit(0))
    return lined.join(more, "row", "left").select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), *keep)
