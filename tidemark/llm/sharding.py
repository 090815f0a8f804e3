"""Assignment of documents to shards by a hierarchical weighted hash tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import shuffle_partitions

#: (region, rack, shard, weight) of each leaf.
Topology = list[tuple[int, int, int, float]]


def even_topology(shards: int, per_rack: int = 2, racks: int = 2) -> Topology:
    """Shards of equal weight, per_rack to a rack and racks to a region."""
    return [(s // (per_rack * racks), s // per_rack % racks, s, 1.0) for s in range(shards)]


def grow(topology: Topology, weight: float = 1.0) -> Topology:
    """One more shard, in a region of its own, so that no other subtree's weight changes.

    A region's draw depends on that region's weight alone, so a row either keeps all its draws
    or goes to the new region, whose only leaf is the new shard.
    """
    return [*topology, (max(t[0] for t in topology) + 1, 0, max(t[2] for t in topology) + 1, weight)]


def unit_draw(key: Column, node: str) -> Column:
    """A number between 0 and 1 from the first 52 bits of md5(key|node)."""
    bits = F.conv(F.substring(F.md5(F.concat(key, F.lit(f"|{node}")).cast("binary")), 1, 13), 16, 10).cast("double")
    return (bits + 0.5) / F.lit(float(2**52))


def choose(key: Column, nodes: dict[str, tuple[int, float]]) -> Column:
    """The number of the node with the smallest -ln(draw)/weight, of {path: (number, weight)}."""
    if len(nodes) == 1:
        return F.lit(next(iter(nodes.values()))[0])
    draws = [F.struct((-F.log(unit_draw(key, path)) / weight).alias("draw"), F.lit(n).alias("n")) for path, (n, weight) in nodes.items()]
    return F.array_min(F.array(*draws))["n"]


def shard_of(key: Column, topology: Topology) -> Column:
    """Descends region, rack and shard; at each level a child wins with a chance in proportion to its weight.

    The draw of a node is a function of the key and the node's path. Raising or lowering a
    weight therefore moves keys only into or out of the subtrees whose weights change.
    """
    topology = [t for t in topology if t[3] > 0]
    regions: dict[int, dict[int, list[tuple[int, float]]]] = {}
    for region, rack, shard, weight in topology:
        regions.setdefault(region, {}).setdefault(rack, []).append((shard, weight))

    def leaf(region: int, rack: int) -> Column:
        return choose(key, {f"{region}/{rack}/{s}": (s, w) for s, w in regions[region][rack]})

    def rack_of(region: int) -> Column:
        weights = {f"{region}/{k}": (k, sum(w for _, w in leaves)) for k, leaves in regions[region].items()}
        return case(choose(key, weights), {k: leaf(region, k) for k in regions[region]})

    weights = {f"{r}": (r, sum(w for leaves in racks.values() for _, w in leaves)) for r, racks in regions.items()}
    return case(choose(key, weights), {r: rack_of(r) for r in regions})


def case(of: Column, by: dict[int, Column]) -> Column:
    """by[of], with the choice made once and only the chosen branch computed."""
    if len(by) == 1:
        return next(iter(by.values()))
    picked = F.transform(F.array(of), lambda n: _branches(n, by))
    return picked[0]


def _branches(n: Column, by: dict[int, Column]) -> Column:
    out = None
    for k, value in by.items():
        out = F.when(n == k, value) if out is None else out.when(n == k, value)
    return out.cast("int")


def assign_shards(docs: DataFrame, topology: Topology, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of each row.

    The law is ``key``: the id and the topology decide, whatever the text, so any number of
    equal texts, or one source with most rows, is spread like other rows. size is the text's
    UTF-8 bytes (null: none) plus 1; the crc32 of a null text is that of the empty one. slot
    numbers a shard's rows from 0 without gaps, in the order of md5(id), then id, then the
    text's crc32. A null id is a key of its own. Repeated rows get slots of their own. Other
    columns are not read. An empty table gives an empty result.

    Numbering takes no task a whole shard: the md5 order is cut into ``buckets`` ranges per
    shard, each numbered by itself, and shifted by the rows of the ranges before. Their counts,
    shards x buckets rows at most, are all that is broadcast.
    """
    buckets = buckets or min(4096, max(64, shuffle_partitions(docs.sparkSession)))
    key = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    place = docs.withColumns({"__key": key}).withColumns({"__order": F.md5(F.col("__key").cast("binary"))})
    place = place.select(
        F.col(id_col).alias("doc_id"),
        "__order",
        F.floor(F.conv(F.substring("__order", 1, 4), 16, 10).cast("long") * buckets / 65536).cast("int").alias("__bucket"),
        shard_of(F.col("__key"), topology).alias("shard"),
        shard_of(F.col("__key"), grow(topology)).alias("grown_shard"),
        (F.coalesce(F.octet_length(text_col), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    before = Window.partitionBy("shard").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = place.groupBy("shard", "__bucket").count().select("shard", "__bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__start"))
    inside = Window.partitionBy("shard", "__bucket").orderBy("__order", "doc_id", "text_crc32")
    numbered = place.withColumn("__n", F.row_number().over(inside))
    return numbered.join(F.broadcast(starts), ["shard", "__bucket"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        "shard",
        (F.col("__start") + F.col("__n") - 1).cast("long").alias("slot"),
        "grown_shard",
    )
