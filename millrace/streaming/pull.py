"""Incremental pull as a stream: the log is an append-only folder, the cursor is the stream's checkpoint."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from millrace.change.log import SCHEMA, without_echo


def read_log(spark: SparkSession, folder: str, files_at_once: int = 100) -> DataFrame:
    """The log's files as they come, a bounded number in each micro-batch."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_at_once).parquet(folder)


def pull_stream(spark: SparkSession, folder: str, origin: str, apply: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Hands each micro-batch's foreign changes to apply(changes, batch id).

    A batch can come again after a failure, with the same id: apply() must be idempotent, as a merge by key is. With
    ``once`` the stream ends when it has caught up.
    """
    changes = without_echo(read_log(spark, folder), origin)
    writer = changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")).start()


class Buffers:
    """What live subscribers have not read yet: at most ``size`` events each, the oldest dropped first, and none for a
    subscriber that has not been heard of for ``idle`` seconds. Times are given, in seconds."""

    def __init__(self, size: int = 1000, idle: float = 3600):
        self.size, self.idle = size, idle
        self.events: dict[str, deque[Any]] = {}
        self.seen: dict[str, float] = {}
        self.dropped: dict[str, int] = {}

    def open(self, subscriber: str, now: float) -> None:
        self.events.setdefault(subscriber, deque(maxlen=self.size))
        self.dropped.setdefault(subscriber, 0)
        self.seen[subscriber] = now

    def offer(self, subscriber: str, event: Any) -> bool:
        """Whether there is such a subscriber."""
        if subscriber not in self.events:
            return False
        self.dropped[subscriber] += len(self.events[subscriber]) == self.size
        self.events[subscriber].append(event)
        return True

    def touch(self, subscriber: str, now: float) -> None:
        if subscriber in self.seen:
            self.seen[subscriber] = now

    def take(self, subscriber: str, now: float) -> list[Any]:
        """All that is buffered, which is gone then."""
        self.touch(subscriber, now)
        out = list(self.events.get(subscriber, ()))
        if out:
            self.events[subscriber].clear()
        return out

    def clean(self, now: float) -> list[str]:
        """Forgets the subscribers that have been idle; their names."""
        gone = [k for k, at in self.seen.items() if now - at >= self.idle]
        for k in gone:
            del self.events[k], self.seen[k], self.dropped[k]
        return gone


def fan_out(spark: SparkSession, folder: str, subscriptions: DataFrame, deliver: Callable[[DataFrame, int], None], checkpoint: str, now: Callable[[], str]) -> StreamingQuery:
    """Live subscriptions: every micro-batch's notifications go to deliver()."""
    from millrace.change.clients import notifications

    def each(changes: DataFrame, batch: int) -> None:
        deliver(notifications(changes, subscriptions, now()), batch)

    return read_log(spark, folder).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, width: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """An extension: counts and sums of events by tumbling windows of event time, for batch or stream alike."""
    own = events.withColumn("ts", F.col("ts").cast("timestamp"))
    own = own.withWatermark("ts", lateness) if own.isStreaming else own
    return own.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", lateness: str = "10 minutes") -> DataFrame:
    """An extension: a user's sessions, which end after a gap without events."""
    own = events.withColumn("ts", F.col("ts").cast("timestamp"))
    own = own.withWatermark("ts", lateness) if own.isStreaming else own
    return own.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")
