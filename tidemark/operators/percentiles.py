"""Exact percentiles of groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Buckets into which a group's range of values is cut; only the buckets that hold the asked ranks are sorted.
BUCKETS = 4096


def exact_percentiles(df: DataFrame, keys: list[str], value: Column, asked: dict[str, float], buckets: int = BUCKETS) -> DataFrame:
    """keys and, for each name of asked, the exact percentile of value in the group, interpolated; nulls aren't counted.

    Spark's own exact percentile holds all distinct values of a group in one buffer. Here equal
    values are first counted, the range of a group is cut into buckets, and their counts say in
    which bucket the wanted ranks lie; only these buckets' values are put in order. So a task has
    a group's bucket counts or one bucket's values, not the group.
    """
    counted = df.select(*keys, value.cast("double").alias("v")).where("v IS NOT NULL").groupBy(*keys, "v").agg(F.count("*").alias("n"))
    ends = counted.groupBy(*keys).agg(F.min("v").alias("low"), F.max("v").alias("high"), F.sum("n").alias("total"))
    same = [F.col(f"c.{k}").eqNullSafe(F.col(f"e.{k}")) for k in keys]
    on = same[0] if same else F.lit(True)
    for s in same[1:]:
        on = on & s
    placed = counted.alias("c").join(ends.alias("e"), on).select(*(F.col(f"c.{k}").alias(k) for k in keys), "v", "n", "total", "low", "high")
    bucket = F.when(F.col("high") > F.col("low"), F.least(F.lit(buckets - 1), F.floor((F.col("v") - F.col("low")) / (F.col("high") - F.col("low")) * buckets))).otherwise(F.lit(0)).cast("int")
    placed = placed.select(*keys, "v", "n", "total", bucket.alias("bucket"))
    sizes = placed.groupBy(*keys, "bucket").agg(F.sum("n").alias("size"), F.first("total").alias("total"))
    before = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("before", F.coalesce(F.sum("size").over(before), F.lit(0)))
    rank = lambda p: (F.col("total") - 1) * F.lit(p)
    holds = F.lit(False)
    for p in asked.values():
        for edge in (F.floor(rank(p)), F.ceil(rank(p))):
            holds = holds | ((edge >= F.col("before")) & (edge < F.col("before") + F.col("size")))
    wanted = sizes.where(holds).select(*(F.col(k).alias(f"w_{k}") for k in keys), F.col("bucket").alias("w_bucket"), "before")
    match = F.col("bucket") == F.col("w_bucket")
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"w_{k}"))
    inside = placed.join(wanted, match).select(*keys, "bucket", "v", "n", "total", "before")
    upto = F.sum("n").over(Window.partitionBy(*keys, "bucket").orderBy("v"))
    ranked = inside.withColumn("last", F.col("before") + upto - 1).withColumn("first", F.col("last") - F.col("n") + 1)
    at = lambda edge: F.max(F.when((F.col("first") <= edge) & (F.col("last") >= edge), F.col("v")))
    low = {name: at(F.floor(rank(p))).alias(f"{name}_low") for name, p in asked.items()}
    high = {name: at(F.ceil(rank(p))).alias(f"{name}_high") for name, p in asked.items()}
    found = ranked.groupBy(*keys).agg(*low.values(), *high.values(), F.first("total").alias("total"))
    between = lambda name, p: F.col(f"{name}_low") + (F.col(f"{name}_high") - F.col(f"{name}_low")) * (rank(p) - F.floor(rank(p)))
    return found.select(*keys, *(between(name, p).alias(name) for name, p in asked.items()))
