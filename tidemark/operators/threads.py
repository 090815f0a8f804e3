"""Whose turn it is in a thread of messages, from all of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def thread_status(messages: DataFrame, promises: DataFrame) -> DataFrame:
    """(thread, n, status, since): how each thread stands, and since when someone waits.

    messages (thread, sent, mine, automated, asks, addressed, closes), promises (thread, inbound,
    is_open, made_at). Automated messages don't count. In this order: without a message FYI; the
    last one closes the matter and doesn't ask us: RESOLVED; others asked us after our last
    message and had the last word: AWAITING_US; our last message asks: AWAITING_THEM; a promise
    made to us is open: AWAITING_THEM; all promises are closed: RESOLVED; we never wrote and
    nothing was addressed to us: FYI; else ACTIVE. Each thread is two aggregates; its messages
    never meet in one row.
    """
    people = messages.where(~F.coalesce(F.col("automated"), F.lit(False)))
    asks_us = ~F.col("mine") & F.col("asks") & F.col("addressed")
    ours = people.groupBy("thread").agg(F.max(F.when(F.col("mine"), F.col("sent"))).alias("our_last"))
    dated = people.join(ours, "thread")
    waiting = asks_us & (F.col("our_last").isNull() | (F.col("sent") > F.col("our_last")))
    state = dated.groupBy("thread").agg(
        F.count("*").alias("n"),
        F.max_by(F.struct("mine", "asks", "closes", asks_us.alias("asks_us"), "sent"), "sent").alias("last"),
        F.min(F.when(waiting, F.col("sent"))).alias("asked_at"),
        F.bool_or("mine").alias("wrote"),
        F.bool_or("addressed").alias("addressed"),
    )
    owed = promises.groupBy("thread").agg(F.min(F.when(F.col("inbound") & F.col("is_open"), F.col("made_at"))).alias("owed_since"), F.bool_and(~F.col("is_open")).alias("all_closed"))
    every = messages.select("thread").distinct().join(state, "thread", "left").join(owed, "thread", "left")
    status = (
        F.when(F.col("last").isNull(), "FYI")
        .when(F.col("last.closes") & ~F.col("last.asks_us"), "RESOLVED")
        .when(~F.col("last.mine") & F.col("asked_at").isNotNull(), "AWAITING_US")
        .when(F.col("last.mine") & F.col("last.asks"), "AWAITING_THEM")
        .when(F.col("owed_since").isNotNull(), "AWAITING_THEM")
        .when(F.col("all_closed"), "RESOLVED")
        .when(~F.col("wrote") & ~F.col("addressed"), "FYI")
        .otherwise("ACTIVE")
    )
    since = F.when(status == "AWAITING_US", F.col("asked_at")).when((status == "AWAITING_THEM") & F.col("last.mine") & F.col("last.asks"), F.col("last.sent")).when(status == "AWAITING_THEM", F.col("owed_since"))
    return every.select("thread", F.coalesce("n", F.lit(0)).alias("n"), status.alias("status"), since.alias("since"))
