"""Places, runs and greedy choices in an order, without one task for all rows or for a hot key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.kept import counted, kept


def numbered(df: DataFrame, by: list[str], order: list[Column], name: str = "place") -> DataFrame:
    """df with each row's number in its group ``by``, from 1, in ``order``, which tells all rows of a group apart.

    Rows are dealt by ranges of group and order, so a group of any size is cut into several ranges. Within a range
    they are numbered, and a range's number of rows before it, a row for each group and range, is added.
    """
    rows = kept(df.repartitionByRange(*by, *order).withColumn("__range", F.spark_partition_id()))
    sizes = rows.groupBy(*by, "__range").agg(F.count("*").alias("__n"))
    upto = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    before = counted(sizes.withColumn("__before", F.coalesce(F.sum("__n").over(upto), F.lit(0))).drop("__n"))
    own = rows.withColumn("__k", F.row_number().over(Window.partitionBy(*by, "__range").orderBy(*order)))
    renamed = before.select(*(F.col(b).alias(f"__by{k}") for k, b in enumerate(by)), F.col("__range").alias("__r"), "__before")
    same = F.col("__range") == F.col("__r")
    for k, b in enumerate(by):
        same = same & F.col(b).eqNullSafe(F.col(f"__by{k}"))
    return own.join(renamed, same).select(*df.columns, (F.col("__k") + F.col("__before")).cast("int").alias(name))


def running_total(df: DataFrame, by: list[str], order: str, values: list[str]) -> DataFrame:
    """df, one row for each group ``by`` and ``order``, with ``values`` summed up in order within the group, the row itself included.

    As in numbered, a group of any size is cut into ranges, and a range adds what the ranges before it sum up to.
    """
    rows = kept(df.repartitionByRange(*by, order).withColumn("__range", F.spark_partition_id()))
    upto = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*by, "__range").agg(*(F.sum(v).alias(v) for v in values))
    before = counted(sums.select(*(F.col(b).alias(f"__by{k}") for k, b in enumerate(by)), F.col("__range").alias("__r"), *(F.coalesce(F.sum(v).over(upto), F.lit(0)).alias(f"__{v}") for v in values)))
    along = Window.partitionBy(*by, "__range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    own = rows.select(*by, order, "__range", *(F.coalesce(F.sum(v).over(along), F.lit(0)).alias(v) for v in values))
    same = F.col("__range") == F.col("__r")
    for k, b in enumerate(by):
        same = same & F.col(b).eqNullSafe(F.col(f"__by{k}"))
    return own.join(before, same).select(*by, order, *((F.col(v) + F.col(f"__{v}")).alias(v) for v in values))


def gap_runs(rows: DataFrame, key: str, at: str, gap: int, slice_: int | None = None) -> DataFrame:
    """(key, began, last, n): rows of a key of which each comes less than ``gap`` seconds after the one before.

    Times are cut into slices. Runs are found within a slice, and then the last run of a slice and
    the first of the next one are joined where they are that near, over a row for each
    slice. So a key of most rows is as many tasks as it has slices (a thousand gaps each).
    """
    width = (slice_ or 1000 * gap) * 1_000_000
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    each = rows.select(F.col(key).alias("key"), micros.alias("t")).where("t IS NOT NULL").withColumn("slice", F.floor(F.col("t") / width))
    within = Window.partitionBy("key", "slice").orderBy("t")
    fresh = F.coalesce((F.col("t") - F.lag("t").over(within) >= gap * 1_000_000).cast("int"), F.lit(1))
    marked = each.withColumn("fresh", fresh).withColumn("k", F.sum("fresh").over(within.rowsBetween(Window.unboundedPreceding, 0)))
    runs = kept(marked.groupBy("key", "slice", "k").agg(F.min("t").alias("began"), F.max("t").alias("last"), F.count("*").alias("n")))
    slices = runs.groupBy("key", "slice").agg(F.min("began").alias("first"), F.max("last").alias("end"), F.max("k").alias("runs"))
    along = Window.partitionBy("key").orderBy("slice")
    slices = slices.withColumn("joined", F.coalesce(F.col("first") - F.lag("end").over(along) < gap * 1_000_000, F.lit(False)))
    # The slice in which the run begins that is the last of this one.
    begins = F.max(F.when((F.col("runs") > 1) | ~F.col("joined"), F.col("slice"))).over(along.rowsBetween(Window.unboundedPreceding, 0))
    slices = slices.withColumn("chain", begins).withColumn("before", F.lag("chain").over(along))
    both = runs.join(slices.select(F.col("key").alias("skey"), F.col("slice").alias("s"), "runs", "joined", "chain", "before"), F.col("key").eqNullSafe(F.col("skey")) & (F.col("slice") == F.col("s")))
    is_first, is_last = F.col("k") == 1, F.col("k") == F.col("runs")
    # A run is named by the slice in which it begins and whether it is the last there.
    name = F.when(is_first & F.col("joined"), F.struct(F.col("before").alias("s"), F.lit(-1).cast("long").alias("k"))).when(is_last, F.struct(F.col("chain").alias("s"), F.lit(-1).cast("long").alias("k"))).otherwise(F.struct(F.col("slice").alias("s"), F.col("k").cast("long").alias("k")))
    whole = both.groupBy("key", name.alias("name")).agg(F.min("began").alias("began"), F.max("last").alias("last"), F.sum("n").alias("n"))
    return whole.select(F.col("key").alias(key), F.timestamp_micros("began").alias("began"), F.timestamp_micros("last").alias("last"), "n")


def greedy_choice(rows: DataFrame, id_col: str, pairs: DataFrame) -> DataFrame:
    """(id): of rows those that a pass in order would take: each that isn't paired with one taken before it.

    pairs (before, after) of ids, the one that comes first first. In each round, rows with no
    undecided one before them are taken and what is paired with these goes, so all keys advance
    together; rounds are as many as the longest chain of pairs.
    """
    open_ = kept(rows.select(F.col(id_col).alias("id")).distinct())
    pairs = kept(pairs.select("before", "after").distinct())
    taken = None
    while True:
        waiting = pairs.select(F.col("after").alias("id")).distinct()
        free = kept(open_.join(waiting, "id", "left_anti"))
        taken = free if taken is None else kept(taken.unionByName(free))
        gone = pairs.join(free.select(F.col("id").alias("before")), "before", "left_semi").select(F.col("after").alias("id")).distinct()
        open_ = kept(open_.join(free, "id", "left_anti").join(gone, "id", "left_anti"))
        if open_.isEmpty():
            return taken
        left = open_.select("id")
        pairs = kept(pairs.join(left.withColumnRenamed("id", "before"), "before", "left_semi").join(left.withColumnRenamed("id", "after"), "after", "left_semi"))
