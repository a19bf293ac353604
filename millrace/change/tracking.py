"""Which mapped changes are still to be carried over, and what is remembered afterwards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.change.config import MappingConfig
from millrace.change.hashing import canonical_text

STATE = "mapping_id string, last_synced_version long, last_sync_timestamp string, records_synced long"
HASHES = "mapping_id string, source_pk string, payload_hash string, synced_at string"


def pending(mapped: DataFrame, config: MappingConfig, state: DataFrame, hashes: DataFrame) -> DataFrame:
    """Mapped changes to carry over.

    By version: above the mapping's last. By hash: deletes, and images whose source hash differs from the one remembered.
    By timestamp or externally: all. Without tracking: all.
    """
    how = F.lit("all")
    for m in config.mappings:
        how = F.when(F.col("mapping_id") == m.id, m.tracking.strategy if m.tracking.enabled else "all").otherwise(how)
    own = mapped.withColumn("__how", how).withColumn("source_hash", F.sha2(canonical_text(F.col("payload")), 256))
    own = own.join(state.select("mapping_id", F.col("last_synced_version").alias("__last")), "mapping_id", "left")
    known = hashes.select("mapping_id", F.col("source_pk").alias("pk_value"), F.col("payload_hash").alias("__hash"))
    own = own.join(known, ["mapping_id", "pk_value"], "left")
    newer = F.col("version") > F.coalesce("__last", F.lit(0))
    differs = (F.col("operation") == "delete") | ~F.col("source_hash").eqNullSafe(F.col("__hash"))
    return own.where(F.when(F.col("__how") == "version", newer).when(F.col("__how") == "hash", differs).otherwise(True)).select(*mapped.columns, "source_hash")


def advance(state: DataFrame, done: DataFrame, now: str) -> DataFrame:
    """The mapping state after changes were carried over: versions move on, counts add up."""
    new = done.groupBy("mapping_id").agg(F.max("version").alias("v"), F.count("*").alias("n"))
    both = state.join(new, "mapping_id", "full")
    return both.select("mapping_id", F.greatest("last_synced_version", "v").alias("last_synced_version"), F.when(F.col("n").isNotNull(), F.lit(now)).otherwise(F.col("last_sync_timestamp")).alias("last_sync_timestamp"), (F.coalesce("records_synced", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("records_synced"))


def remember(hashes: DataFrame, done: DataFrame, now: str) -> DataFrame:
    """The hashes after changes were carried over; deleted rows are forgotten."""
    last = done.groupBy("mapping_id", "pk_value").agg(F.max_by(F.struct("operation", "source_hash"), "version").alias("c"))
    new = last.select("mapping_id", F.col("pk_value").alias("source_pk"), F.col("c.source_hash").alias("payload_hash"), F.lit(now).alias("synced_at"), F.col("c.operation").alias("__op"))
    old = hashes.join(new.select("mapping_id", "source_pk"), ["mapping_id", "source_pk"], "left_anti")
    return old.unionByName(new.where(F.col("__op") != "delete").drop("__op"))
