"""Clients, tombstones, subscriptions and notifications."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.change.errors import FullResyncRequired

CLIENTS = "origin_id string, last_sync_version long, last_sync_timestamp string, created_at string"
SUBSCRIPTIONS = "subscription_id string, origin_id string, subscription_type string, table_name string, filter string, created_at string, expires_at string"


def safe_version(clients: DataFrame) -> int:
    """Up to which version every client has applied the changes; 0 without clients."""
    return clients.agg(F.coalesce(F.min("last_sync_version"), F.lit(0)).cast("long")).first()[0]


def check_resync(client_version: int, oldest: int) -> None:
    if client_version < oldest:
        raise FullResyncRequired(client_version, oldest)


def behind(clients: DataFrame, oldest: int) -> DataFrame:
    """Clients that need a full resync: they ask for changes from before the oldest that is kept."""
    return clients.where(F.col("last_sync_version") < oldest)


def stale(clients: DataFrame, now: str, days: int = 90) -> DataFrame:
    """Clients whose last contact is more than ``days`` before ``now`` (ISO time in UTC)."""
    limit = (datetime.fromisoformat(now.replace("Z", "+00:00")) - timedelta(days=days)).replace(tzinfo=None).isoformat()
    return clients.where(F.to_timestamp_ntz(F.substring("last_sync_timestamp", 1, 19)) < F.lit(limit).cast("timestamp_ntz"))


def purge(log: DataFrame, safe: int) -> DataFrame:
    """The log without the tombstones that every client has applied."""
    return log.where(~((F.col("operation") == "delete") & (F.col("version") <= safe))) if safe > 0 else log


def touch(clients: DataFrame, origin: str, version: int, now: str) -> DataFrame:
    """Clients with one client's state set, added if it is new."""
    spark = clients.sparkSession
    new = spark.createDataFrame([(origin, version, now)], "origin_id string, v long, t string")
    both = clients.join(new, "origin_id", "full")
    return both.select("origin_id", F.coalesce("v", "last_sync_version").alias("last_sync_version"), F.coalesce("t", "last_sync_timestamp").alias("last_sync_timestamp"), F.coalesce("created_at", "t").alias("created_at"))


def live(subscriptions: DataFrame, now: str) -> DataFrame:
    """Subscriptions that have not expired; times are compared as texts."""
    return subscriptions.where(F.col("expires_at").isNull() | (F.lit(now) <= F.col("expires_at")))


def notifications(log: DataFrame, subscriptions: DataFrame, now: str) -> DataFrame:
    """(subscription_id, origin_id, and the change) for every live subscription that a change concerns.

    Table and query subscriptions take every change of their table; record subscriptions those whose key is in their
    filter, a JSON list. Record filters become rows, so matching is an equi-join.
    """
    own = live(subscriptions, now).select("subscription_id", "origin_id", F.lower("subscription_type").alias("type"), "table_name", "filter")
    broad = own.where("type <> 'record'").drop("type", "filter")
    keys = F.explode(F.from_json("filter", "array<string>")).alias("pk")
    narrow = own.where("type = 'record'").select("subscription_id", "origin_id", "table_name", keys)
    changes = log.withColumn("__key", F.get(F.map_values(F.from_json("pk_value", "map<string,string>")), F.lit(0)))
    listed = narrow.select("subscription_id", "origin_id", "table_name", F.coalesce(F.get(F.map_values(F.from_json("pk", "map<string,string>")), F.lit(0)), F.col("pk")).alias("__key")).distinct()
    renamed = lambda df: df.withColumnRenamed("origin_id", "subscriber")
    out = renamed(broad).join(changes.drop("__key"), "table_name").unionByName(renamed(listed).join(changes, ["table_name", "__key"]).drop("__key"))
    return out.select("subscription_id", F.col("subscriber").alias("origin_id"), "version", "table_name", "pk_value", "operation", "payload", "origin", "timestamp")
