"""Near copies among embeddings: collisions counted over many one-dimensional projections, then verified."""

from __future__ import annotations

from math import acos, ceil, comb, erf, log2, pi, sqrt

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bounded, cut, limit_batches, shuffle_partitions, to_batch
from tidemark.llm.components import components
from tidemark.llm.simhash import Labels

SEED = 42
#: Projections whose collisions are counted, and half a window in distances of the farthest linked pair.
PROJECTIONS, HALF = 48, 1.0
#: Chance that the farthest linked pair shares a cell, and that it reaches the least count in there.
CELL_RECALL, COUNT_RECALL = 0.999, 0.999
#: Vectors expected in a cell, vectors at which a cell is cut into tiles, collisions listed at a time, cuts of a cell at most.
CELL, MOST, STEP, DEPTH = 128, 1024, 1 << 21, 48


def least_count(least: float, projections: int = PROJECTIONS, half: float = HALF, recall: float = COUNT_RECALL) -> int:
    """The collisions that a pair of cosine ``least`` reaches with chance ``recall`` or more.

    Unit vectors of cosine c are d = sqrt(2 - 2c) apart, so their projections on a Gaussian
    direction differ by a normal number of deviation d, whatever the data: a collision has
    chance erf(half / sqrt(2)), and collisions are binomial. Nearer pairs collide more often.
    """
    p = erf(half / sqrt(2))
    tail, k = 0.0, projections + 1
    while tail < recall and k > 0:
        k -= 1
        tail += comb(projections, k) * p**k * (1 - p) ** (projections - k)
    return k


def cuts_for(count: int, cell: int = CELL) -> int:
    """Projections whose signs make up a cell, for so many vectors."""
    return min(DEPTH, max(0, ceil(log2(max(1, count) / cell))))


def tables_for(cuts: int, least: float, recall: float = CELL_RECALL) -> int:
    """Tables of cells after which a pair of cosine ``least`` shares a cell with chance ``recall``.

    A projection separates unit vectors at angle t by its sign with chance t / pi, whatever the data.
    """
    shared = (1 - acos(least) / pi) ** cuts
    return 1 if cuts == 0 else ceil(np.log(1 - recall) / np.log(1 - shared))


def directions(dim: int, count: int, stream: int) -> np.ndarray:
    return np.random.default_rng([SEED, dim, stream]).standard_normal((dim, count))


def unit(vectors: np.ndarray) -> np.ndarray:
    """Vectors over their length; powers of two are taken out first, so that no square overflows or vanishes."""
    scaled = np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1, keepdims=True))[1])
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def cell_keys(vectors: np.ndarray, cuts: int, tables: int) -> np.ndarray:
    """For each vector its cell in each table: the signs of ``cuts`` projections of the table's own."""
    powers = np.int64(1) << np.arange(cuts, dtype=np.int64)
    return np.stack([(unit(vectors) @ directions(vectors.shape[1], cuts, 1 + t) > 0) @ powers for t in range(tables)], axis=1)


def collisions(queries: np.ndarray, items: np.ndarray, half: float) -> np.ndarray:
    """For each query and item, in how many projections (columns) the item lies within ``half`` of the query.

    Each projection's items are sorted; two searches give the window around each query. All
    projections are sorted as one line, each moved by more than the whole width of the data.
    """
    n, m = items.shape
    counts = np.zeros(len(queries) * n, np.int64)
    low = min(queries.min(), items.min()) - 2 * half
    apart = max(queries.max(), items.max()) + 2 * half - low
    per = max(1, STEP // (len(queries) * n))
    for k in range(0, m, per):
        moved = (np.arange(min(per, m - k)) * apart)[None, :] - low
        order = np.argsort(items[:, k : k + per], axis=0)
        line = np.sort((np.take_along_axis(items[:, k : k + per], order, 0) + moved).T.ravel())
        centre = (queries[:, k : k + per] + moved).T.ravel()
        first, last = np.searchsorted(line, centre - half, "left"), np.searchsorted(line, centre + half, "right")
        width = last - first
        at = np.arange(width.sum()) + np.repeat(first - np.cumsum(width) + width, width)
        rows = np.repeat(np.tile(np.arange(len(queries)) * n, moved.shape[1]), width)
        counts += np.bincount(rows + order.T.ravel()[at], minlength=counts.size)
    return counts.reshape(len(queries), n)


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in double precision."""
    shift = lambda x: np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])
    a, b = shift(a), shift(b)
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def linked_pairs(vectors: np.ndarray, keys: np.ndarray, table: int, left: np.ndarray, right: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """The linked pairs of left x right (rows of vectors) whose first common cell is that of ``table``."""
    half, enough = HALF * sqrt(2 - 2 * least), least_count(least)
    on = unit(vectors) @ directions(vectors.shape[1], PROJECTIONS, 0)
    found = []
    step = max(1, STEP // (4 * len(right)))
    for k in range(0, len(left), step):
        own = left[k : k + step]
        i, j = np.nonzero(collisions(on[own], on[right], half) >= enough)
        i, j = own[i], right[j]
        if left is right:
            i, j = i[i < j], j[i < j]
        same = keys[i] == keys[j]
        new = same[:, table] & ~same[:, :table].any(axis=1)
        i, j = i[new], j[new]
        for s in range(0, len(i), STEP // 16):
            a, b = i[s : s + STEP // 16], j[s : s + STEP // 16]
            near = cosines(vectors[a], vectors[b]) >= least
            found.append((a[near], b[near]))
    none = [np.empty(0, np.int64)]
    return np.concatenate(none + [a for a, _ in found]), np.concatenate(none + [b for _, b in found])


TILE = ["kind", "table", "cell", "low", "high"]


def near_vectors(vectors: DataFrame, least: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cell: int = CELL, most: int = MOST) -> DataFrame:
    """One row per row of vectors: vec_id, n_links, component_id, kept.

    Rows of equal label whose vectors have a cosine of ``least`` or more, in double precision,
    are linked; n_links counts a row's links, component_id is the smallest id that links reach,
    kept tells whether it is the row's own. Every pair found is verified, so no link is wrong; a
    pair at ``least`` itself is found with a chance of 0.998, nearer ones with a higher one.

    Equal vectors of a label are one node, so copies cost a row each. The signs of a few
    projections deal nodes into cells, in as many tables as recall asks for; with growing labels
    cells stay as small and tables grow as a small power. In a cell, 48 projections are sorted, the
    window around each node's projection gives its collisions, and pairs with enough of them
    are verified. A pair is taken in the first table in which it shares a cell, so nothing is counted
    twice and pairs are never listed beyond a task: counts and a star for each component leave it.
    A cell of over ``most`` nodes is cut into tiles of two blocks.

    Vectors that are null, empty, zero or hold a null or non-finite number, and rows with a null
    label, link with nothing; nor do vectors of unlike length. Rows may repeat and count each.
    A null id is smallest only where a component has no other; such a row is kept only then. Other
    columns are not read; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    limit_batches(spark)
    kind = vectors.schema[vector_col].dataType.simpleString()
    vector = F.col(vector_col) if kind in ("array<float>", "array<double>") else F.col(vector_col).cast("array<double>")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    usable = F.col("label").isNotNull() & F.forall("vector", finite) & F.exists("vector", lambda x: x != 0)
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).cast("string").alias("label"), vector.alias("vector"))
    rows = rows.withColumn("usable", F.coalesce(usable, F.lit(False)))
    alone = rows.where("NOT usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    rows = rows.where("usable").drop("usable")

    nodes = rows.groupBy("label", "vector").agg(F.count("*").alias("copies"), F.min("vec_id").alias("first"))
    nodes = cut(nodes.withColumn("node", F.monotonically_increasing_id()))
    sizes = nodes.groupBy("label", F.size("vector").alias("dim")).agg(F.count("*").alias("count")).withColumn("kind", F.monotonically_increasing_id())
    sized = nodes.withColumn("dim", F.size("vector")).join(bounded(sizes), ["label", "dim"]).select("kind", "count", "dim", "node", "copies", "vector")

    def add_cells(batches):
        import pyarrow as pa

        for batch in batches:
            counts, dims = batch.column("count").to_numpy(), batch.column("dim").to_numpy()
            cuts = np.array([cuts_for(c, cell) for c in counts.tolist()], np.int64)
            keys: list = [None] * len(cuts)
            for c, d in set(zip(cuts.tolist(), dims.tolist(), strict=True)):
                at = np.flatnonzero((cuts == c) & (dims == d))
                values = batch.column("vector").take(pa.array(at)).flatten().to_numpy().astype(np.float64).reshape(len(at), d)
                for k, row in zip(at.tolist(), cell_keys(values, c, tables_for(c, least)), strict=True):
                    keys[k] = row
            yield to_batch(**{c: batch.column(c) for c in ("kind", "node", "copies", "vector")}, cells=pa.array(keys, pa.list_(pa.int64())))

    element = nodes.schema["vector"].dataType.simpleString()
    celled = cut(sized.mapInArrow(add_cells, f"kind long, node long, copies long, vector {element}, cells array<long>"))
    placed = celled.select("*", F.posexplode("cells").alias("table", "cell"))
    large = placed.groupBy("kind", "table", "cell").agg(F.count("*").alias("size")).where(F.col("size") > most)
    large = bounded(large.select("kind", "table", "cell", F.ceil(2 * F.col("size") / most).cast("int").alias("blocks")))
    placed = placed.join(large, ["kind", "table", "cell"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))
    dealt = placed.select(*TILE, "node", "copies", "block", "vector", "cells").repartition(shuffle_partitions(spark), *TILE).sortWithinPartitions(*TILE)

    def find(batches):
        import pyarrow as pa

        def tile(parts):
            rows = pa.Table.from_batches(parts).combine_chunks()
            if rows.num_rows < 2:
                return []
            column = lambda c: rows.column(c).chunk(0)
            values = column("vector").flatten().to_numpy().astype(np.float64).reshape(rows.num_rows, -1)
            keys = column("cells").flatten().to_numpy().reshape(rows.num_rows, -1)
            node, copies, block = (column(c).to_numpy() for c in ("node", "copies", "block"))
            low, high = column("low")[0].as_py(), column("high")[0].as_py()
            left = np.flatnonzero(block == low)
            right = left if low == high else np.flatnonzero(block == high)
            if not left.size or not right.size:
                return []
            i, j = linked_pairs(values, keys, column("table")[0].as_py(), left, right, least)
            links = np.zeros(rows.num_rows, np.int64)
            np.add.at(links, i, copies[j])
            np.add.at(links, j, copies[i])
            stars = Labels(rows.num_rows)
            stars.link(i, j)
            moved, some = np.flatnonzero(stars.of != np.arange(rows.num_rows)), np.flatnonzero(links)
            return [(node[some], None, links[some]), (node[stars.of[moved]], node[moved], None)]

        def batch_of(found):
            a = np.concatenate([np.empty(0, np.int64), *(x for x, _, _ in found)])
            whole = lambda k: pa.array([v for x in found for v in (x[k].tolist() if x[k] is not None else [None] * len(x[0]))], pa.int64())
            return to_batch(a=a, b=whole(1), links=whole(2))

        held, key = [], None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in TILE])
            starts = np.flatnonzero(np.append(True, (np.diff(keys, axis=1) != 0).any(axis=0))) if batch.num_rows else np.empty(0, np.int64)
            found = []
            for start, end in zip(starts.tolist(), [*starts[1:].tolist(), batch.num_rows], strict=True):
                if held and (own := keys[:, start].tolist()) != key:
                    found += tile(held)
                    held = []
                key = keys[:, start].tolist()
                held.append(batch.slice(start, end - start))
            yield batch_of(found)
        yield batch_of(tile(held) if held else [])

    found = cut(dealt.mapInArrow(find, "a long, b long, links long"))
    links = found.where("b IS NULL").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    roots = components(found.where("b IS NOT NULL").select("a", "b"))
    rooted = cut(nodes.select("node", "copies", "first").join(links, "node", "left").join(roots, "node", "left").select("node", "first", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "node").alias("root")))
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = nodes.select("node", "label", "vector").join(rooted.join(smallest, "root").select("node", "n_links", "component_id"), "node")
    joined = rows.join(named, ["label", "vector"]).select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
    return joined.unionAll(alone)
