"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of edges (a, b), root being the smallest node that it reaches.

    Alternates large-star and small-star steps (Kiveris et al., Connected Components in
    MapReduce and Beyond): each node hands its larger neighbours, then its smaller ones, to the
    smallest it knows. The edges become stars in about log(nodes) rounds and never grow in
    number beyond the nodes and edges at the start. Minima are aggregated before the shuffle,
    and the joins that hand them out are ones that AQE can split for a node of many edges.
    Every round is checkpointed; only a row count and a checksum reach the driver.
    """
    edges = cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())
    before = None
    while True:
        state = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a").cast("decimal(20,0)"))).first()
        if state[0] == 0 or state == before:
            break
        before = state
        both = edges.union(edges.select("b", "a")).toDF("a", "b")
        least = cut(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        large = cut(both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a < b").distinct())
        least = cut(large.groupBy("b").agg(F.min("a").alias("m")))
        small = large.join(least, "b").select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b"))
        edges = cut(small.where("a < b").distinct())
    roots = edges.select("a").distinct().select(F.col("a").alias("node"), F.col("a").alias("root"))
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).union(roots)
