"""States over time: intervals from a log of changes, and what held at an instant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.kept import counted, kept
from tidemark.operators.ranking import numbered, running_total


def validity(changes: DataFrame, key: str, at: str, tie: str, state: list[str]) -> DataFrame:
    """(key, *state, valid_from, valid_to): from each change of a key until its next one, or without an end.

    Changes of one instant follow each other by ``tie``, and only the last of them holds. A change is joined with
    the next by its number, so a key of most changes is no single task.
    """
    placed = kept(numbered(changes.select(key, at, tie, *state), [key], [F.asc(at), F.asc(tie)]))
    following = placed.select(F.col(key).alias("__key"), (F.col("place") - 1).alias("__place"), F.col(at).alias("valid_to"))
    same = F.col(key).eqNullSafe(F.col("__key")) & (F.col("place") == F.col("__place"))
    return placed.join(following, same, "left").where(F.col("valid_to").isNull() | (F.col("valid_to") > F.col(at))).select(key, *state, F.col(at).alias("valid_from"), "valid_to")


def size_class(length: Column) -> Column:
    """The least c with 2 ** c seconds at least as long as an interval; 63 for one without an end."""
    return F.when(length.isNull(), 63).otherwise(F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(length, F.lit(1)))))).cast("int")


def held_at(intervals: DataFrame, instants: DataFrame, instant: str) -> DataFrame:
    """Each instant with every interval that holds then: valid_from <= instant < valid_to.

    An interval goes to the one or two buckets of its size class that it touches, buckets being
    as wide as the longest of the class; an instant goes to its bucket of each class that occurs
    (some dozens). So long intervals make no more rows than short ones, and the join is an equi-join;
    intervals without an end share one bucket, in which an instant meets those that had begun.
    """
    sized = intervals.withColumn("__class", size_class(F.unix_seconds("valid_to") - F.unix_seconds("valid_from")))
    width = F.when(F.col("__class") == 63, F.lit(1 << 62)).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("__class")))
    begin, end = F.floor(F.unix_seconds("valid_from") / width), F.floor((F.unix_seconds(F.coalesce("valid_to", "valid_from"))) / width)
    placed = sized.withColumn("__bucket", F.explode(F.sequence(begin, end)))
    classes = counted(placed.select("__class").distinct())
    points = instants.crossJoin(F.broadcast(classes)).withColumn("__bucket", F.floor(F.unix_seconds(instant) / width))
    met = placed.join(points, ["__class", "__bucket"])
    return met.where((F.col("valid_from") <= F.col(instant)) & (F.col("valid_to").isNull() | (F.col(instant) < F.col("valid_to")))).drop("__class", "__bucket")


def totals_at(intervals: DataFrame, instants: DataFrame, instant: str, state: str, value: str | None = None) -> DataFrame:
    """Each instant with every state that some interval is in then: n intervals, and the sum of ``value`` over them if given.

    For counts, no instant meets an interval: an interval adds one to its state at its beginning and
    takes it away at its end, and a running sum of these steps is read at the instants. Rows are at
    most those of different times of change and different instants, for each state.
    """
    sums = ["n"] if value is None else ["n", value]
    step = lambda at, sign: F.struct(F.col(at).alias("at"), F.lit(sign).alias("n"), *([] if value is None else [(sign * F.col(value)).alias(value)]))
    each = intervals.select(F.col(state).alias("state"), F.explode(F.array(step("valid_from", 1), step("valid_to", -1))).alias("s")).where("s.at IS NOT NULL")
    steps = kept(each.select("state", "s.*").groupBy("state", "at").agg(*(F.sum(s).alias(s) for s in sums)))
    asked = instants.select(F.col(instant).alias("at")).where("at IS NOT NULL").distinct()
    points = asked.crossJoin(F.broadcast(steps.select("state").distinct())).select("state", "at", *(F.lit(0).cast(steps.schema[s].dataType).alias(s) for s in sums))
    both = steps.unionByName(points).groupBy("state", "at").agg(*(F.sum(s).alias(s) for s in sums))
    held = running_total(both, ["state"], "at", sums).where("n > 0").select(F.col("state").alias(state), F.col("at").alias("__at"), *sums)
    return instants.join(held, F.col(instant) == F.col("__at")).drop("__at")
