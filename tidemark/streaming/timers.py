"""Streams with timers: runs and sessions that end by the clock, and promises that fall due.

State is held until the watermark has passed and taken in order of event time then, so rows that
come late, within the watermark, give what a batch over the same rows gives. State goes when a
run or session is handed out. Times are microseconds, as Spark's and SQL's are; watermarks and timers
are whole milliseconds. transformWithState needs the RocksDB state store (see use_rocksdb).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

STATE = StructType([StructField("began", LongType()), StructField("last", LongType()), StructField("n", LongType()), StructField("waiting", ArrayType(LongType()))])


def use_rocksdb(spark: SparkSession) -> None:
    """Sets the state store that timers need, where a stream hasn't been started with another."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Sessions(StatefulProcessor):
    """Sessions of a key: one ends ``idle`` microseconds after its last event, or ``longest`` after its first.

    State of a key: the open session, and the times that the watermark hasn't reached. Timers
    stand at the first of these and just after the open session's end; all that is due is taken in order.
    """

    def __init__(self, idle: int, longest: int | None):
        self.idle, self.longest = idle, longest

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("session", STATE)

    def end(self, began: int, last: int) -> int:
        return last + self.idle if self.longest is None else min(last + self.idle, began + self.longest)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        began, last, n, waiting = self.held()
        fresh = [int(t) for batch in rows for t in batch["at"]]
        waiting = sorted([*waiting, *fresh])
        self.handle.registerTimer(-(-waiting[0] // 1000))
        self.state.update((began, last, n, waiting))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        began, last, n, waiting = self.held()
        now = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()) * 1000
        ended = []
        due = [t for t in waiting if t <= now]
        for t in due:
            if n and t >= self.end(began, last):
                ended.append((began, self.end(began, last), n))
                n = 0
            began, last, n = (t, t, 1) if not n else (began, t, n + 1)
        if n and self.end(began, last) < now:
            ended.append((began, self.end(began, last), n))
            began, last, n = 0, 0, 0
        waiting = waiting[len(due) :]
        if n or waiting:
            self.state.update((began, last, n, waiting))
            if waiting:
                self.handle.registerTimer(-(-waiting[0] // 1000))
            if n:
                self.handle.registerTimer(self.end(began, last) // 1000 + 1)
        else:
            self.state.clear()
        if ended:
            yield pd.DataFrame([(key[0], *x) for x in ended], columns=["key", "began", "ended", "n"])

    def held(self) -> tuple[int, int, int, list[int]]:
        if not self.state.exists():
            return 0, 0, 0, []
        began, last, n, waiting = self.state.get()
        return began, last, n, list(waiting)


def timed_sessions(events: DataFrame, key: str, ts: str, idle: int, longest: int | None = None, late: str = "1 hour") -> DataFrame:
    """(key, began, ended, n) of each session once the watermark has passed its end; idle and longest in seconds.

    As batch_sessions over the rows that aren't later than ``late``: rows without a time are left out, those without a key are one key's. With longest left out this is
    the debounced run: requests less than idle apart are one run, which is due at ended.
    """
    use_rocksdb(events.sparkSession)
    marked = events.select(F.col(key).cast("string").alias("key"), F.col(ts).alias("event_time"), F.unix_micros(ts).alias("at")).where("at IS NOT NULL").withWatermark("event_time", late)
    found = marked.groupBy("key").transformWithStateInPandas(Sessions(idle * 1_000_000, longest and longest * 1_000_000), "key string, began long, ended long, n long", "Append", "EventTime")
    return found.select("key", F.timestamp_micros("began").alias("began"), F.timestamp_micros("ended").alias("ended"), "n")


def batch_sessions(events: DataFrame, key: str, ts: str, idle: int, longest: int | None = None) -> DataFrame:
    """(key, began, ended, n) of all sessions; each key's times stream by in order, and one session is held."""

    def split(batches):
        key, began, last, n = None, 0, 0, 0
        end = lambda: last + idle * 1_000_000 if longest is None else min(last + idle * 1_000_000, began + longest * 1_000_000)
        for batch in batches:
            out = []
            for k, t in zip(batch["key"], batch["at"], strict=True):
                if n and (k != key or t >= end()):
                    out.append((key, began, end(), n))
                    n = 0
                key, began, last, n = (k, t, t, 1) if not n else (k, began, t, n + 1)
            yield pd.DataFrame(out, columns=["key", "began", "ended", "n"])
        if n:
            yield pd.DataFrame([(key, began, end(), n)], columns=["key", "began", "ended", "n"])

    rows = events.select(F.col(key).cast("string").alias("key"), F.unix_micros(ts).alias("at")).where("at IS NOT NULL")
    found = rows.repartition("key").sortWithinPartitions("key", "at").mapInPandas(split, "key string, began long, ended long, n long")
    return found.select("key", F.timestamp_micros("began").alias("began"), F.timestamp_micros("ended").alias("ended"), "n")


def promise_outcomes(promises: DataFrame, deliveries: DataFrame, late: str = "1 hour") -> DataFrame:
    """(promise_id, thread, made_at, due_at, delivery_id, sent_at): each delivery of a promise's thread from when it was made until it is due; one row without a delivery for a promise that none came for.

    promises (promise_id, thread, made_at, due_at), deliveries (delivery_id, thread, sent_at). As a
    stream the join holds each side only as long as the other's watermark can still bring a
    match: LONGEST_PROMISE days after a promise was made its row goes, with or without a delivery. So
    an overdue promise comes out by itself. A batch over the same rows gives the same.
    """
    p = promises.withWatermark("made_at", late)
    d = deliveries.select("delivery_id", F.col("thread").alias("d_thread"), "sent_at").withWatermark("sent_at", late)
    within = (F.col("thread") == F.col("d_thread")) & (F.col("sent_at") >= F.col("made_at")) & (F.col("sent_at") <= F.col("due_at")) & (F.col("sent_at") <= F.col("made_at") + F.expr(f"INTERVAL {LONGEST_PROMISE} DAYS"))
    return p.join(d, within, "left").select("promise_id", "thread", "made_at", "due_at", "delivery_id", "sent_at")


#: Days after which a promise is no longer waited for.
LONGEST_PROMISE = 90


def run_into(df: DataFrame, path: str) -> DataFrame:
    """Everything available now, written as Parquet at path by a stream that can be started again, and read from there."""
    query = df.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{path}/rows")
