"""Insights, delegates, source precedence and other parts of the read models."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import ranking


def insights(analyzers: dict[str, Callable[[], DataFrame]]) -> DataFrame:
    """(fingerprint, kind, subject, importance, n) of all analyzers, each of which gives (subject, importance) rows.

    A fingerprint is kind and subject; of rows that share one the most important counts, and n
    says how many there were.
    """
    every = None
    for kind, build in analyzers.items():
        one = build().select(F.lit(kind).alias("kind"), F.col("subject").cast("string").alias("subject"), F.col("importance").cast("double").alias("importance"))
        every = one if every is None else every.unionByName(one)
    found = every.groupBy("kind", "subject").agg(F.max("importance").alias("importance"), F.count("*").alias("n"))
    return found.select(F.concat_ws(":", "kind", "subject").alias("fingerprint"), "kind", "subject", "importance", "n")


def delegates(tasks: DataFrame, people: DataFrame, loads: DataFrame, skill: str) -> DataFrame:
    """tasks with ``delegate``: of the people with the task's skill the one with the least load, then the smallest id.

    people (person, skill), loads (person, load). One person is found for each skill, not for
    each task; null where nobody has the skill.
    """
    loaded = people.join(loads, "person", "left").withColumn("load", F.coalesce("load", F.lit(0)))
    best = loaded.groupBy(skill).agg(F.min(F.struct("load", "person")).alias("best"))
    return tasks.join(best, skill, "left").withColumn("delegate", F.col("best.person")).drop("best")


def by_precedence(rows: DataFrame, keys: list[str], source: str, ranks: list[str], values: list[str]) -> DataFrame:
    """One row a key, from the source that comes first in ranks; sources not in the list come last, by name."""
    rank = F.coalesce(F.create_map(*(F.lit(x) for k, s in enumerate(ranks) for x in (s, k)))[F.col(source)], F.lit(len(ranks)))
    best = rows.groupBy(*keys).agg(F.min(F.struct(rank.alias("rank"), source, *values)).alias("best"))
    return best.select(*keys, *(F.col(f"best.{c}").alias(c) for c in (source, *values)))


def day_agenda(items: DataFrame, day: str, starts: Column, all_day: Column, importance: str, id_col: str) -> DataFrame:
    """items with ``place`` in their local day: by start, all-day items at the day's first instant and before others of that instant, then by importance. A day of any size is several ranges (see ranking.numbered)."""
    timed = items.withColumn("__start", F.when(all_day, F.col("midnight")).otherwise(starts)).withColumn("__later", F.when(all_day, 0).otherwise(1))
    return ranking.numbered(timed, [day], [F.asc("__start"), F.asc("__later"), F.desc(importance), F.asc(id_col)]).drop("__start", "__later")


def may_lose_role(users: DataFrame, group: str, role: str, keeper: str) -> DataFrame:
    """users with ``keepers`` of their group and ``may_change``: the last keeper of a group keeps the role."""
    counts = users.groupBy(group).agg(F.count_if(F.col(role) == keeper).alias("keepers"))
    return users.join(counts, group).withColumn("may_change", (F.col(role) != keeper) | (F.col("keepers") > 1))


def snapshot(values: DataFrame, history: DataFrame, keys: list[str], day: str) -> DataFrame:
    """history after a day's values are taken: they replace those of the same keys and day, so taking them again changes nothing."""
    return history.join(values.select(*keys, day), [*keys, day], "left_anti").unionByName(values)


def refreshed(table: DataFrame, fresh: DataFrame, partition: str) -> DataFrame:
    """table after the partitions that fresh has were deleted and inserted again. To write it, use dynamic partition overwrite."""
    return table.join(fresh.select(partition).distinct(), partition, "left_anti").unionByName(fresh)
