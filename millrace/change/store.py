"""What replication remembers, as small tables: state, session, clients, subscriptions, mapping state and hashes."""

from __future__ import annotations

import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.change import clients, tracking
from millrace.change.coordinator import Session
from millrace.operators import dml
from millrace.sources.tables import Tables

# The tables, their columns and their keys.
TABLES = {
    "_sync_state": ("key string, value string", ["key"]),
    "_sync_clients": (clients.CLIENTS, ["origin_id"]),
    "_sync_subscriptions": (clients.SUBSCRIPTIONS, ["subscription_id"]),
    "_sync_mapping_state": (tracking.STATE, ["mapping_id"]),
    "_sync_record_hashes": (tracking.HASHES, ["mapping_id", "source_pk"]),
}


class Store:
    """Reads, upserts and deletes rows of these tables. With a folder they are Parquet there and outlive the session;
    writes replace a table as a whole, so there must be one writer."""

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark = spark
        self.tables = Tables(spark, folder, writable=True) if folder else Tables(spark)
        for name, (schema, _) in TABLES.items():
            if not self.tables.has(name):
                self.tables.replace(name, spark.createDataFrame([], schema))

    def get(self, table: str, **where: Any) -> DataFrame:
        rows = self.tables.get(table)
        for column, value in where.items():
            rows = rows.where(F.col(column).eqNullSafe(F.lit(value)))
        return rows

    def put(self, table: str, rows: DataFrame | list[tuple]) -> None:
        schema, keys = TABLES[table]
        new = rows if isinstance(rows, DataFrame) else self.spark.createDataFrame(rows, schema)
        self.tables.replace(table, dml.upsert(self.tables.get(table), new, keys))

    def set(self, table: str, rows: DataFrame) -> None:
        """Puts rows in the place of the whole table."""
        self.tables.replace(table, rows)

    def delete(self, table: str, **where: Any) -> int:
        gone = self.get(table, **where)
        n = gone.count()
        if n:
            self.tables.replace(table, dml.delete(self.tables.get(table), gone, TABLES[table][1]))
        return n

    # State.
    def value(self, key: str) -> str | None:
        row = self.get("_sync_state", key=key).first()
        return row["value"] if row else None

    def origin(self) -> str:
        """This replica's id; made once."""
        found = self.value("origin_id")
        if not found:
            found = str(uuid.uuid4())
            self.put("_sync_state", [("origin_id", found)])
        return found

    def session(self) -> Session:
        return Session(self.origin(), int(self.value("last_server_version") or 0), int(self.value("last_push_version") or 0))

    def save(self, session: Session) -> None:
        self.put("_sync_state", [("last_server_version", str(session.pulled)), ("last_push_version", str(session.pushed))])

    # Subscriptions.
    def expire(self, now: str) -> int:
        """Deletes the subscriptions that have expired."""
        everything = self.get("_sync_subscriptions")
        kept = clients.live(everything, now)
        n = everything.count() - kept.count()
        if n:
            self.tables.replace("_sync_subscriptions", kept)
        return n
