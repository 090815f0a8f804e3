"""Rows per group: latest, last n, ranked with a cap, first occurrence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Rows that a task sorts or gathers, as aimed at.
ROWS = 500_000


def parts(spark: SparkSession, rows: int) -> int:
    """Into how many partitions so many rows are dealt: ROWS each, and no fewer than the session has."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS))


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int = 1, rank: str | None = None) -> DataFrame:
    """The first n rows of each group. Give order a unique last key, or ties fall anyhow.

    Spark keeps n rows of a group in each task before the shuffle (WindowGroupLimit).
    """
    name = rank or "__rank"
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= n)
    return out if rank else out.drop(name)


def last_points(df: DataFrame, keys: list[str], order: str, n: int, fields: list[str], name: str) -> DataFrame:
    """Each group's last n rows, oldest first, as an array of structs."""
    last = top_per_group(df, keys, [F.desc(order), *(F.desc(f) for f in fields)], n)
    return last.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, *fields))).alias(name))


def capped_top(df: DataFrame, group: str, order: list[Column], n: int, cap: int, pinned: Column | None = None) -> DataFrame:
    """n rows by order, at most cap of a group, and then, if places are left, the best of the others.

    pinned rows come first whatever their group and count towards its cap. Rows without a group
    have no cap. Places are numbered from 1 in ``place``. Only n rows of a group, and n of all
    rows, are ever compared in one task.
    """
    pin = F.coalesce(pinned, F.lit(False)) if pinned is not None else F.lit(False)
    first = df.withColumn("__pin", pin)
    by_group = Window.partitionBy(group).orderBy(F.desc("__pin"), *order)
    ranked = first.withColumn("__of_group", F.row_number().over(by_group)).where((F.col("__of_group") <= n) | F.col("__pin") | F.col(group).isNull())
    tier = F.when(F.col("__pin"), 0).when(F.col(group).isNull() | (F.col("__of_group") <= cap), 1).otherwise(2)
    best = ranked.withColumn("__tier", tier).orderBy("__tier", *order).limit(n)
    place = F.row_number().over(Window.orderBy("__tier", *order))
    return best.withColumn("place", place).drop("__pin", "__of_group", "__tier")


def first_occurrences(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Ordered dedupe: of rows with the same key the first by order stays."""
    return top_per_group(df, keys, order)


def since_last(df: DataFrame, keys: list[str], order: str, event: Column) -> DataFrame:
    """The rows after each group's last event; all rows of a group without one."""
    last = F.max(F.when(event, F.col(order))).over(Window.partitionBy(*keys))
    return df.withColumn("__last", last).where(F.col("__last").isNull() | (F.col(order) > F.col("__last"))).drop("__last")


def first_that_has_rows(frames: list[DataFrame]) -> DataFrame:
    """The rows of the first of several frames of one schema that isn't empty. Each is looked at for one row only."""
    every = None
    for k, df in enumerate(frames):
        one = df.withColumn("__k", F.lit(k))
        every = one if every is None else every.unionByName(one)
    found = [df.limit(1).select(F.lit(k).alias("__first")) for k, df in enumerate(frames)]
    first = found[0]
    for df in found[1:]:
        first = first.unionByName(df)
    least = first.agg(F.min("__first").alias("__first"))
    return every.join(F.broadcast(least), F.col("__k") == F.col("__first")).drop("__k", "__first")


def newest_items(entities: DataFrame, items: DataFrame, most: int) -> DataFrame:
    """(entity, item, at, place): of each of entities (entity), any table of them, the ``most`` newest items (entity, item, at), an item once."""
    own = items.join(entities.select("entity").distinct(), "entity", "left_semi").groupBy("entity", "item").agg(F.max("at").alias("at"))
    place = F.row_number().over(Window.partitionBy("entity").orderBy(F.desc("at"), F.asc("item")))
    return own.withColumn("place", place).where(F.col("place") <= most).select("entity", "item", "at", "place")
