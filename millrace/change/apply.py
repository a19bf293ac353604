"""Applies changes to tables, set by set."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.change.errors import DeferredChangesError
from millrace.change.log import latest, without_echo


@dataclass(frozen=True)
class ForeignKey:
    child: str
    column: str
    parent: str
    key: str


@dataclass
class Applied:
    """tables: rows after the changes; applied and skipped: numbers of changes; passes: how often deferral went round."""

    tables: dict[str, DataFrame]
    applied: int = 0
    skipped: int = 0
    passes: int = 0
    deferred: dict[str, int] = field(default_factory=dict)


def _folded(changes: DataFrame, version: Column | None) -> DataFrame:
    """Of each row (pk_value) what its changes in order come to: ``first``, its last image, insert or delete, and ``then``,
    the update with the highest Version after it, of equal ones the earliest.

    An update without a Version counts as an image. Both are pre-aggregated where they lie, so hot rows move once a task.
    """
    if version is None:
        last = latest(changes)
        one = F.struct("operation", "payload")
        return last.select("pk_value", one.alias("first"), F.lit(None).cast(last.select(one).schema[0].dataType).alias("then"))
    change = F.struct("operation", "payload")
    own = changes.select("pk_value", "version", change.alias("change"), F.when(F.lower("operation") == "update", version).alias("number"))
    whole = own.where("number is null").groupBy("pk_value").agg(F.max("version").alias("since"), F.max_by("change", "version").alias("first"))
    later = own.where("number is not null").join(whole.select("pk_value", "since"), "pk_value", "left").where(F.col("version") > F.coalesce("since", F.lit(-1)))
    best = later.groupBy("pk_value").agg(F.max_by("change", F.struct("number", -F.col("version"))).alias("then"))
    return whole.join(best, "pk_value", "full").select("pk_value", "first", "then")


def merge(target: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """A table after its changes, as if they were applied one by one in the order of their versions.

    Rows keep their last image, deletes go. An update of a table with a column Version counts only if the row has none or
    a lower one at that point. Images lacking a column leave it null on new rows and as it was on old ones.
    """
    kind = T.StructType([T.StructField(f.name, f.dataType) for f in target.schema])
    versions = [c for c in target.columns if c.lower() == "version"]
    number = F.from_json("payload", kind)[versions[0]] if versions else None
    new = _folded(changes, number).select(F.get(F.map_values(F.from_json("pk_value", "map<string,string>")), F.lit(0)).cast(target.schema[key].dataType).alias("__key"), "first", "then")
    old = target.select(F.struct(*[F.col(f"`{c}`") for c in target.columns]).alias("__old"), F.col(key).alias("__key"))
    both = old.join(new, "__key", "full").withColumn("__there", F.col("__old").isNotNull())
    both = both.withColumn("__old", F.coalesce("__old", F.lit(None).cast(kind)))
    for step in ("first", "then"):
        operation, payload = F.col(step)["operation"], F.col(step)["payload"]
        image, given, deletes = F.from_json(payload, kind), F.json_object_keys(payload), F.lower(operation) == "delete"
        counts = operation.isNotNull()
        if versions:
            counts = counts & ~F.coalesce((F.lower(operation) == "update") & F.col("__there") & (F.col("__old")[versions[0]] >= image[versions[0]]), F.lit(False))
        fields = [
            F.when(~counts, F.col("__old")[f.name]).when(deletes, F.lit(None)).when(F.coalesce(F.array_contains(given, f.name), F.lit(False)), image[f.name])
            .otherwise(F.col("__key") if f.name == key else F.col("__old")[f.name]).cast(f.dataType).alias(f.name)
            for f in target.schema
        ]
        both = both.select("__key", "first", "then", F.struct(*fields).alias("__old"), F.when(counts, ~deletes).otherwise(F.col("__there")).alias("__there"))
    return both.where("__there").select("__old.*")


def orphans(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Rows whose parent isn't there; a null reference has none to lack."""
    keys = parent.select(F.col(key).alias("__parent")).distinct()
    return child.where(F.col(column).isNotNull()).join(keys, F.col(column) == F.col("__parent"), "left_anti")


def apply_changes(tables: dict[str, DataFrame], keys: dict[str, str], changes: DataFrame, own_origin: str, foreign_keys: tuple[ForeignKey, ...] = (), passes: int = 3) -> Applied:
    """Applies a log's changes to the tables they name.

    Changes of our own origin are echoes and skipped. The others go in all at once, so their order can't matter: a row
    lacks its parent only if nothing brings it. Such rows are held back, and pass by pass what then lacks them, until no
    more are found or ``passes`` are done; DeferredChangesError tells how many. Rows that lacked a parent before the
    changes are let be.
    """
    total = changes.count()
    foreign = without_echo(changes, own_origin)
    counted = foreign.count()
    out = dict(tables)
    for name in tables:
        out[name] = merge(tables[name], foreign.where(F.col("table_name") == name), keys[name])
    done = Applied(out, counted, total - counted)
    known = [fk for fk in foreign_keys if fk.child in out and fk.parent in out]
    for done.passes in range(1, max(1, passes) + 1 if known else 1):
        found = 0
        for fk in known:
            own = F.col(keys[fk.child]).alias("__held")
            before = orphans(tables[fk.child], fk.column, tables[fk.parent], fk.key).select(own)
            held = orphans(out[fk.child], fk.column, out[fk.parent], fk.key).select(own).join(before, "__held", "left_anti")
            if n := held.count():
                out[fk.child] = out[fk.child].join(held, F.col(keys[fk.child]) == F.col("__held"), "left_anti")
                done.deferred[fk.child] = done.deferred.get(fk.child, 0) + n
                found += n
        if not found:
            break
    if left := sum(done.deferred.values()):
        raise DeferredChangesError(left, done.passes)
    return done
