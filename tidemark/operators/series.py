"""Gap-filled series, month spines and trailing frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def day_spine(spark: SparkSession, last: str, n: int) -> DataFrame:
    """The n days up to and with ``last``."""
    end = F.lit(last).cast("date")
    return spark.range(1).select(F.explode(F.sequence(F.date_sub(end, n - 1), end)).alias("day"))


def month_spine(spark: SparkSession, first: str, last: str) -> DataFrame:
    """The first days of the months from first up to last, which is left out."""
    start, end = F.lit(first).cast("date"), F.lit(last).cast("date")
    months = F.sequence(F.trunc(start, "MONTH"), end, F.expr("interval 1 month"))
    return spark.range(1).select(F.explode(months).alias("month")).where(F.col("month") < end)


def fill(spine: DataFrame, counted: DataFrame, on: str, values: list[str]) -> DataFrame:
    """counted on every row of the spine, 0 where it has none."""
    return spine.join(counted, on, "left").select(on, *(F.coalesce(F.col(v), F.lit(0).cast(counted.schema[v].dataType)).alias(v) for v in values))


def trailing(value: Column, rows: int, order: Column, keys: tuple[str, ...] = (), full_only: bool = False) -> Column:
    """The mean over the last ``rows`` rows.

    With full_only it is null for a frame that isn't full, unless the row is the last of all.
    """
    base = Window.partitionBy(*keys).orderBy(order)
    frame = base.rowsBetween(-(rows - 1), 0)
    mean = F.avg(value).over(frame)
    if not full_only:
        return mean
    is_last = F.row_number().over(Window.partitionBy(*keys).orderBy(order.desc())) == 1
    return F.when((F.count(F.lit(1)).over(frame) == rows) | is_last, mean)


def change_from_previous(value: Column, order: list[Column], keys: list[str]) -> Column:
    """(value - previous) / |previous|; null without a previous value or if that is 0."""
    before = F.lag(value).over(Window.partitionBy(*keys).orderBy(*order))
    return F.when(before != 0, (value - before) / F.abs(before))


def ordered_sum(df: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """(*keys, value): each group's doubles added up one after the other in ``order``, so the last digit doesn't depend on tasks.

    Rows of a group stream by in a sorted task and one running sum is held.
    """
    along = Window.partitionBy(*keys).orderBy(order)
    last = df.select(*keys, F.sum(value).over(along.rowsBetween(Window.unboundedPreceding, 0)).alias(value), F.lead(F.lit(True)).over(along).alias("__more"))
    return last.where("__more IS NULL").drop("__more")
