"""Idempotent upserts by natural key and content hash."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def content_hash(*columns: str) -> Column:
    """SHA-256 over the columns' JSON, so that null and empty differ."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def stable_json(held: Column) -> Column:
    """A map as JSON with its keys in order, so that equal contents have equal texts; null for null."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(held))))


def classify_changes(current: DataFrame, incoming: DataFrame, keys: list[str], payload: list[str]) -> DataFrame:
    """incoming with ``change``: created, updated or unchanged against current, by key and content."""
    old = current.select(*keys, content_hash(*payload).alias("__old"))
    state = F.when(F.col("__old").isNull(), "created").when(F.col("__old") == F.col("__new"), "unchanged").otherwise("updated")
    return incoming.withColumn("__new", content_hash(*payload)).join(old, keys, "left").withColumn("change", state).drop("__new", "__old")


def upsert(current: DataFrame, incoming: DataFrame, keys: list[str], payload: list[str]) -> DataFrame:
    """current after incoming: new keys added, changed rows replaced with version + 1, others as they were.

    current has a ``version``. Applying the same rows twice is the same as once. Where incoming
    repeats a key, the greatest payload wins.
    """
    newest = incoming.groupBy(*keys).agg(F.max(F.struct(*payload)).alias("__in"))
    both = current.withColumn("__cur", F.struct(*payload)).select(*keys, "__cur", "version").join(newest, keys, "full")
    same = reduce(lambda a, b: a & b, [F.col(f"__cur.{p}").eqNullSafe(F.col(f"__in.{p}")) for p in payload])
    keep = F.col("__in").isNull() | (F.col("version").isNotNull() & same)
    return both.select(
        *keys,
        *(F.when(keep, F.col(f"__cur.{p}")).otherwise(F.col(f"__in.{p}")).alias(p) for p in payload),
        F.when(keep, F.col("version")).otherwise(F.coalesce(F.col("version"), F.lit(0)) + 1).alias("version"),
    )


def fold_edges(edges: DataFrame) -> DataFrame:
    """Edges of a relation graph, one a pair and relation: most confidence, distinct evidence, first and last seen."""
    return edges.groupBy("from_id", "relation", "to_id").agg(
        F.max("confidence").alias("confidence"), F.countDistinct("source_id").alias("evidence"), F.min("seen_at").alias("first_seen"), F.max("seen_at").alias("last_seen")
    )


def repoint(edges: DataFrame, merged: DataFrame) -> DataFrame:
    """fold_edges after entities were merged: merged has (old_id, new_id). Edges from an entity to itself go."""
    for end in ("from_id", "to_id"):
        names = merged.select(F.col("old_id").alias(end), F.col("new_id").alias("__new"))
        edges = edges.join(names, end, "left").withColumn(end, F.coalesce("__new", end)).drop("__new")
    return fold_edges(edges.where("from_id <> to_id"))
