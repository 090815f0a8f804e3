"""Joins that Spark has no keyword for: as-of, nearest within a range, for all, recursive, paired."""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.operators import graphs, groups, likeness
from tidemark.operators.kept import kept


def asof_backward(left: DataFrame, right: DataFrame, key: str, at: str, ts: str, value: str, name: str) -> DataFrame:
    """Each left row with the value of the last right row of its key at or before ``at``.

    Left and right rows are put in one stream per key and the last value is carried forward, so
    each side is shuffled once and no pair of rows is made. The right side is reduced to one
    value per key and time, the largest.
    """
    points = right.groupBy(F.col(key), F.col(ts).alias("__at")).agg(F.max(value).alias("__value"))
    asked = left.withColumn("__at", F.col(at)).withColumn("__asked", F.lit(1))
    both = asked.unionByName(points.withColumn("__asked", F.lit(0)), allowMissingColumns=True)
    order = Window.partitionBy(key).orderBy("__at", "__asked").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = F.last("__value", ignorenulls=True).over(order)
    return both.withColumn(name, carried).where("__asked = 1").drop("__at", "__asked", "__value")


def asof_forward(left: DataFrame, changes: DataFrame, key: str, at: str, ts: str, before: str, current: Column, name: str) -> DataFrame:
    """The value that held at ``at``: what the first later change changed it from, else the current one."""
    points = changes.groupBy(F.col(key), F.col(ts).alias("__at")).agg(F.min(before).alias("__value"))
    asked = left.withColumn("__at", F.col(at)).withColumn("__asked", F.lit(1))
    both = asked.unionByName(points.withColumn("__asked", F.lit(0)), allowMissingColumns=True)
    # A change at the same instant is not later, so it sorts before the rows that ask.
    order = Window.partitionBy(key).orderBy("__at", "__asked").rowsBetween(1, Window.unboundedFollowing)
    found = F.first("__value", ignorenulls=True).over(order)
    return both.withColumn("__found", found).where("__asked = 1").withColumn(name, F.coalesce(F.col("__found"), current)).drop("__at", "__asked", "__value", "__found")


def within_range(left: DataFrame, right: DataFrame, keys: list[str], left_at: Column, right_at: Column, seconds: int) -> DataFrame:
    """Pairs of equal keys whose instants are at most so many seconds apart.

    Instants are dealt into buckets as long as the range; the right row stands in its own bucket
    and both neighbours, so the join is an equi-join on keys and bucket. Columns of both sides
    besides the keys must differ.
    """
    slot = lambda at: F.floor(F.unix_seconds(at.cast("timestamp")) / seconds)
    a = left.withColumn("__slot", slot(left_at))
    b = right.withColumn("__slot", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: slot(right_at) + d)))
    return a.join(b, [*keys, "__slot"]).drop("__slot").where(F.abs(F.unix_micros(left_at.cast("timestamp")) - F.unix_micros(right_at.cast("timestamp"))) <= seconds * 1_000_000)


def for_all(parents: DataFrame, children: DataFrame, on: str, holds: Column) -> DataFrame:
    """Parents that have children, all of which hold. Children are reduced to one row a parent first."""
    good = children.groupBy(on).agg(F.bool_and(F.coalesce(holds, F.lit(False))).alias("__all")).where("__all")
    return parents.join(good.select(on), on, "left_semi")


def family(edges: DataFrame, roots: DataFrame, most: int | None = None) -> DataFrame:
    """(root, node, depth) of all that hangs below each root in edges (parent, child), itself at depth 0: at any depth, or down to ``most`` levels.

    A node that is reached again farther down keeps its least depth, so cycles end. A few levels
    are walked from the roots; without a bound the whole hierarchy's paths are doubled, which
    takes as many rounds as the depth has binary digits (see graphs).
    """
    if most is not None:
        return graphs.reach(edges, roots, most)
    own = roots.select("root", F.col("root").alias("node"), F.lit(0).alias("depth")).where("root IS NOT NULL").distinct()
    below = graphs.ancestors(edges).where("node <> ancestor").select(F.col("ancestor").alias("root"), "node", "depth")
    return own.unionByName(below.join(own.select("root"), "root", "left_semi"))


def family_items(entities: DataFrame, edges: DataFrame, items: DataFrame) -> DataFrame:
    """(entity, members, items, first_seen, last_seen): for each of entities (entity), any table of them, the size of its family below and its members' source items.

    items (entity, item, seen_at). An item that several members have counts once. A member's items
    are reduced before they meet the families, and meet each family that the member is in. Items
    are dealt into partitions by their number, before and after that.
    """
    families = family(edges, entities.select(F.col("entity").alias("root"))).select("root", "node")
    n = groups.parts(items.sparkSession, items.count())
    own = items.repartition(n, "entity", "item").groupBy("entity", "item").agg(F.min("seen_at").alias("first"), F.max("seen_at").alias("last"))
    met = families.join(own, families.node == own.entity, "left").select("root", "item", "first", "last")
    each = met.repartition(n, "root", "item").groupBy("root", "item").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    found = each.groupBy("root").agg(F.count("item").alias("items"), F.min("first").alias("first_seen"), F.max("last").alias("last_seen"))
    sizes = families.groupBy("root").agg(F.count("*").alias("members"))
    return sizes.join(found, "root").select(F.col("root").alias("entity"), "members", "items", "first_seen", "last_seen")


def neighbours(edges: DataFrame, node: Column, limit: int) -> DataFrame:
    """A node's edges in both directions, one for each neighbour and direction, by evidence, at most limit."""
    out = edges.where(F.col("from_id") == node).select(F.lit("out").alias("direction"), "relation", F.col("to_id").alias("other"), "evidence", "last_seen")
    into = edges.where(F.col("to_id") == node).select(F.lit("in").alias("direction"), "relation", F.col("from_id").alias("other"), "evidence", "last_seen")
    each = out.unionByName(into).groupBy("direction", "relation", "other").agg(F.max("evidence").alias("evidence"), F.max("last_seen").alias("last_seen"))
    return each.orderBy(F.desc("evidence"), "direction", "relation", "other").limit(limit)


def opposite_pairs(df: DataFrame, key: list[str], amount: str, account: str, id_col: str) -> DataFrame:
    """(out_id, in_id) of transfers: legs of opposite sign and equal size, in different accounts, each used once.

    A key's legs (day, currency, size) are matched by themselves, in order of id: an outgoing leg
    takes the first free incoming one of another account. Keys with legs of one sign only are left
    out. Where one account pays and one other receives, that is the n-th of one with the n-th of
    the other, a join on their numbers. Only keys on which more accounts meet reach Python, where
    a partition's keys stream by, incoming legs first, and one key's free legs are held, a queue
    for each account.
    """

    def match(batches):
        now, free = None, {}
        for rows in batches:
            pairs = []
            for k, leg, size, where in zip(rows["key"], rows["id"], rows["amount"], rows["account"], strict=True):
                if k != now:
                    now, free = k, {}
                if size > 0:
                    free.setdefault(where, deque()).append(leg)
                elif others := [(queue[0], name) for name, queue in free.items() if queue and name != where]:
                    pairs.append((leg, free[min(others)[1]].popleft()))
            yield pd.DataFrame(pairs, columns=["out_id", "in_id"], dtype="int64")

    value = F.col(amount)
    legs = df.select(F.to_json(F.struct(*key, F.abs(value).alias("size"))).alias("key"), value.alias("amount"), F.col(account).alias("account"), F.col(id_col).alias("id")).where(value != 0)
    out = F.when(F.col("amount") < 0, F.col("account"))
    into = F.when(F.col("amount") > 0, F.col("account"))
    kinds = legs.groupBy("key").agg(F.min(out).alias("o1"), F.max(out).alias("o2"), F.min(into).alias("i1"), F.max(into).alias("i2")).where("o1 IS NOT NULL AND i1 IS NOT NULL")
    kinds = kinds.select("key", F.expr("o1 = o2 AND i1 = i2 AND o1 <> i1").alias("plain")).where("NOT (o1 = o2 AND i1 = i2 AND o1 = i1)")
    both = legs.join(kinds, "key")
    number = F.row_number().over(Window.partitionBy("key", F.col("amount") < 0).orderBy("id"))
    numbered = both.where("plain").withColumn("n", number)
    payers = numbered.where("amount < 0").select("key", "n", F.col("id").cast("long").alias("out_id"))
    takers = numbered.where("amount > 0").select("key", "n", F.col("id").cast("long").alias("in_id"))
    paired = both.where("NOT plain").drop("plain").repartition("key").sortWithinPartitions("key", F.col("amount") < 0, "id")
    return payers.join(takers, ["key", "n"]).select("out_id", "in_id").unionByName(paired.mapInPandas(match, "out_id long, in_id long"))


def bag_difference(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """What changed between two bags of (key, value): values on one side only, paired by their order within a key.

    (key, old, new); old null for what was added, new null for what is gone. Values on both sides
    as often as on the other cancel out. Copies are counted and subtracted; only what is left
    over becomes rows, numbered from its values' counts.
    """
    signed = before.select(key, value, F.lit(1).alias("__n")).unionByName(after.select(key, value, F.lit(-1).alias("__n")))
    left = signed.groupBy(key, value).agg(F.sum("__n").alias("__n")).where("__n <> 0")
    upto = F.sum(F.abs("__n")).over(Window.partitionBy(key, F.col("__n") > 0).orderBy(value))
    left = left.withColumn("__upto", upto)
    placed = left.select(key, value, "__n", F.explode(F.sequence(F.col("__upto") - F.abs("__n") + 1, "__upto")).alias("__place"))
    gone = placed.where("__n > 0").select(key, "__place", F.col(value).alias("old"))
    come = placed.where("__n < 0").select(key, "__place", F.col(value).alias("new"))
    return gone.join(come, [key, "__place"], "full").select(key, "old", "new")


def jaccard_pairs(df: DataFrame, key: str, id_col: str, tokens: str, least: float) -> DataFrame:
    """(key, a, b, likeness) of rows of one key, a < b, whose token sets have a Jaccard likeness of ``least`` or more.

    Shared tokens are counted: rows of a key meet by token, and a pair's meetings are added up, in
    part before the shuffle. Pairs carry two sizes and no sets. From a half on, rows meet by the rarest tokens of one of
    them alone (see likeness.containment_candidates) before they are compared.
    """
    sets = df.select(key, id_col, F.array_distinct(tokens).alias("__set")).where("size(__set) > 0")
    if least >= 0.5:
        rows = kept(sets.select(F.struct(key, id_col).alias("id"), F.col("__set").alias("tokens"), key))
        met = likeness.containment_candidates(rows, rows, least, [key]).where(F.col(f"left_id.{id_col}") < F.col(f"right_id.{id_col}"))
        both = likeness.with_tokens(met, rows, rows)
        return both.select(F.col(f"left_id.{key}").alias(key), F.col(f"left_id.{id_col}").alias("a"), F.col(f"right_id.{id_col}").alias("b"), text.jaccard(F.col("left_tokens"), F.col("right_tokens")).alias("likeness")).where(F.col("likeness") >= least)
    side = lambda name: sets.select(key, F.col(id_col).alias(name), F.size("__set").alias(f"__{name}"), F.explode("__set").alias("__token"))
    shared = side("a").join(side("b"), [key, "__token"]).where("a < b").groupBy(key, "a", "b", "__a", "__b").agg(F.count("*").alias("__n"))
    return shared.select(key, "a", "b", (F.col("__n") / (F.col("__a") + F.col("__b") - F.col("__n"))).alias("likeness")).where(F.col("likeness") >= least)
