"""Parents with their children, from flat rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Entity:
    name: str
    keys: tuple[str, ...]
    columns: tuple[str, ...]
    parents: tuple[str, ...] = ()


def nest(flat: DataFrame, parent: Entity, child: Entity, order: tuple[str, ...] = ()) -> DataFrame:
    """A row per parent key: the parent's columns and an array of its children, named as the child entity.

    Every flat row makes a child, all-null ones of a left join too. Children are ordered by ``order``, else by all their
    columns, so that reruns agree; a parent's other columns come from the first such row.
    """
    others = [c for c in parent.columns if c not in parent.keys]
    one = F.struct(*[F.col(c) for c in child.columns])
    rank = F.struct(*[F.col(c) for c in (order or child.columns)])
    rows = flat.groupBy(*parent.keys).agg(F.array_sort(F.collect_list(F.struct(rank.alias("rank"), one.alias("one")))).alias("__rows"), *[F.min_by(c, F.struct(*[F.col(x) for x in (order or child.columns)])).alias(c) for c in others])
    return rows.select(*parent.columns, F.transform("__rows", lambda r: r["one"]).alias(child.name))
