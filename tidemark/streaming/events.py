"""Streaming forms of the window, session, dedupe, upsert and thread-state operators.

Each gives, after Trigger.AvailableNow, what its batch form gives over the same rows. Late rows
within the watermark change results; beyond it they are dropped, which is why upserts carry none.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.operators.upsert import upsert


def tumbling_counts(events: DataFrame, key: str, ts: str, width: str, limit: int, late: str = "1 hour") -> DataFrame:
    """Requests per key and window against a limit."""
    counted = events.withWatermark(ts, late).groupBy(key, F.window(ts, width).alias("w")).agg(F.count("*").alias("n"))
    return counted.select(key, F.col("w.start").alias("window_start"), "n", (F.col("n") <= limit).alias("ok"), F.greatest(F.lit(0), limit - F.col("n")).alias("remaining"))


def sliding_means(events: DataFrame, key: str, ts: str, value: str, width: str, slide: str, late: str = "1 hour") -> DataFrame:
    means = events.withWatermark(ts, late).groupBy(key, F.window(ts, width, slide).alias("w")).agg(F.avg(value).alias("mean"), F.count("*").alias("n"))
    return means.select(key, F.col("w.start").alias("window_start"), "mean", "n")


def sessions(events: DataFrame, key: str, ts: str, idle: str, late: str = "1 hour") -> DataFrame:
    """Sessions that end after an idle time."""
    found = events.withWatermark(ts, late).groupBy(key, F.session_window(ts, idle).alias("w")).agg(F.count("*").alias("n"))
    return found.select(key, F.col("w.start").alias("began"), F.col("w.end").alias("ended"), "n")


def first_of_each(events: DataFrame, keys: list[str], ts: str, within: str) -> DataFrame:
    """Rows whose keys didn't come before within the watermark: idempotent enqueue."""
    return events.withWatermark(ts, within).dropDuplicatesWithinWatermark(keys)


class UpsertSink:
    """foreachBatch(UpsertSink(path, keys, payload)): keeps a table of current rows with versions.

    Rows lie in buckets by a hash of their key. A batch rewrites only the buckets that it has rows
    of, each as a generation named by the batch; it reads generations before its own, so a batch
    that is run again after a failure gives the same, whatever it had written. No late row is
    lost: a change that comes late is a change like any other. Older generations may be deleted.
    """

    def __init__(self, path: str, keys: list[str], payload: list[str], buckets: int = 64):
        self.path, self.keys, self.payload, self.buckets = path, keys, payload, buckets

    def current(self, spark: SparkSession, before: int | None = None) -> DataFrame | None:
        """The table's rows, or as they were before a batch; None if nothing was written yet."""
        folder = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
            return None
        every = spark.read.parquet(self.path)
        if before is not None:
            every = every.where(F.col("generation") < before)
        newest = every.groupBy("bucket").agg(F.max("generation").alias("generation"))  # a row for each bucket
        return every.join(F.broadcast(newest), ["bucket", "generation"]).drop("generation")

    def __call__(self, rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int").alias("bucket")
        fresh = rows.select(*self.keys, *self.payload)
        touched = [r["bucket"] for r in fresh.select(bucket).distinct().collect()]  # as many as there are buckets at most
        old = self.current(spark, batch)
        old = fresh.limit(0).withColumn("version", F.lit(1)) if old is None else old.where(F.col("bucket").isin(touched)).drop("bucket")
        merged = upsert(old, fresh, self.keys, self.payload).select("*", bucket, F.lit(batch).alias("generation"))
        merged.write.partitionBy("bucket", "generation").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(self.path)


def thread_states(messages: DataFrame) -> DataFrame:
    """(conv_id, n, state) after each batch that touches a conversation; see thread_state for the rules.

    messages has conv_id, turn, role and text. The state kept for a conversation is its number of
    messages and its last one, however many there are.
    """
    return messages.groupBy("conv_id").applyInPandasWithState(fold_thread, "conv_id long, n long, state string", "n long, turn long, role string, asks boolean", "update", GroupStateTimeout.NoTimeout)


def fold_thread(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    n, turn, role, asks = state.get if state.exists else (0, -1, "", False)
    for rows in batches:
        n += len(rows)
        last = rows.loc[rows["turn"].idxmax()]
        if last["turn"] > turn:
            turn, role, asks = int(last["turn"]), str(last["role"]), "?" in (last["text"] or "")
    state.update((n, turn, role, asks))
    yield pd.DataFrame({"conv_id": [key[0]], "n": [n], "state": [thread_state(role, asks)]})


def thread_state(role: str, asks: bool) -> str:
    """Whose turn it is, from who spoke last and whether they asked."""
    if role == "system":
        return "FYI"
    if role == "user":
        return "AWAITING_US" if asks else "ACTIVE"
    if role == "assistant":
        return "AWAITING_THEM" if asks else "RESOLVED"
    return "ACTIVE"


def run_to_end(df: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Everything available now, through a table in memory: for tests and small results."""
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return df.sparkSession.table(name)
