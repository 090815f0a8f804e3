"""SimHash fingerprints and exact near-duplicate links by vantage-point trees."""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import LOWER, UPPER, as_bytes, bounded, cut, keep_ids, map_texts, shuffle_partitions, to_batch
from tidemark.llm.components import components

SEED, WORDS, BITS, LINK = 42, 3, 64, 3
TO_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())
#: Shingles hashed at a time, and fingerprints of a shard that one task compares.
STEP, SHARD = 1 << 16, 4096
#: Sets of a band, and shingles of these, that one task compares at a time.
CROWD, ELEMENTS = 1024, 1 << 21
#: Fingerprints below which a tree compares all with all.
LEAF = 192
#: The part of a shard that a further level has to keep together for the shard to count as one of near copies.
DENSE = 0.75
#: Distances in a ring, and by how much a level of rings divides a shard of 32-bit halves.
RING, PER_LEVEL = 4, 2.3
#: Bands of least hashes in which sets of shingles may meet, and hashes of a band. At a likeness of 0.8 a pair misses all bands in 0.2 % of cases.
BANDS, ROWS = 16, 5


def fingerprint(text: bytes) -> int:
    """The SimHash of a text: a bit is set if more than half of the shingles' XXH64 have it.

    Words are what ASCII white space leaves, A-Z lower-cased; a shingle is WORDS words joined by
    a space, fewer words being one shingle. No word: 0.
    """
    from xxhash import xxh64_intdigest

    words = text.translate(TO_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts = np.concatenate([[0], gaps + 1]).tolist()
    ends = np.concatenate([gaps, [len(joined)]]).tolist()[min(WORDS, len(words)) - 1 :]
    counts = np.zeros(BITS, np.int64)
    for k in range(0, len(ends), STEP):
        hashes = np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts[k : k + STEP], ends[k : k + STEP], strict=False)], np.uint64)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(ends), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, bits): the fingerprint as a signed 64-bit number; a null text is empty."""

    def work(batches):
        for batch in batches:
            bits = np.array([fingerprint(t) for t in as_bytes(batch.column(1))], np.uint64)
            yield to_batch(doc_id=batch.column(0), bits=bits.view(np.int64))

    return map_texts(docs, work, "doc_id long, bits long", F.col(id_col).cast("long"), F.col(text_col))


def shingle_set(text: bytes, width: int) -> np.ndarray:
    """The distinct XXH64 of a text's shingles of ``width`` words (see fingerprint), in order."""
    from xxhash import xxh64_intdigest

    words = text.translate(TO_LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.append(0, ends[:-1]).tolist()
    return np.unique(np.array([xxh64_intdigest(joined[a : b - 1], SEED) for a, b in zip(starts, ends.tolist()[min(width, len(words)) - 1 :], strict=False)], np.uint64))


def set_key(shingles: np.ndarray) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(shingles.tobytes(), SEED)


def least_hashes(shingles: np.ndarray) -> np.ndarray:
    """The least of a set's shingles under each of BANDS * ROWS hashes. Two sets of likeness J agree in each with chance J."""
    draw = np.random.default_rng(SEED)
    factors = draw.integers(0, 1 << 63, BANDS * ROWS, np.uint64)[:, None] * np.uint64(2) + np.uint64(1)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(shingles), 1 << 12):
        mixed = shingles[None, k : k + (1 << 12)] * factors
        mixed = (mixed ^ (mixed >> np.uint64(32))) * factors
        least = np.minimum(least, mixed.min(axis=1))
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    """A hash of each band's least hashes. Sets of likeness J share a band with chance J ** ROWS."""
    from xxhash import xxh64_intdigest

    return np.array([xxh64_intdigest(least[k * ROWS : (k + 1) * ROWS].tobytes(), k) for k in range(BANDS)], np.uint64)


def sketches(docs: DataFrame, width: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """fingerprints with ``shingles``, the key of a text's set of shingles (null without words), its size and its bands."""

    def work(batches):
        import pyarrow as pa

        for batch in batches:
            texts = as_bytes(batch.column(1))
            sets = [shingle_set(t, width) for t in texts]
            least = [least_hashes(x) if len(x) else None for x in sets]
            signed = lambda x: np.array(x, np.uint64).view(np.int64)
            yield to_batch(
                doc_id=batch.column(0), bits=signed([fingerprint(t) for t in texts]),
                shingles=pa.array([int(signed([set_key(x)])[0]) if len(x) else None for x in sets], pa.int64()),
                size=pa.array([len(x) for x in sets], pa.int64()),
                bands=pa.array([[] if x is None else band_keys(x).view(np.int64).tolist() for x in least], pa.list_(pa.int64())),
            )

    return map_texts(docs, work, "doc_id long, bits long, shingles long, size long, bands array<long>", F.col(id_col).cast("long"), F.col(text_col))


def tiles(batches, keys: list[str]):
    """The rows of each group, one table after the other, of batches in order of ``keys``."""
    import pyarrow as pa

    held, now = [], None
    for batch in batches:
        own = np.stack([batch.column(c).to_numpy() for c in keys]).astype(np.int64)
        starts = np.flatnonzero(np.append(True, (np.diff(own, axis=1) != 0).any(axis=0))) if batch.num_rows else np.empty(0, np.int64)
        for start, end in zip(starts.tolist(), [*starts[1:].tolist(), batch.num_rows], strict=True):
            if held and own[:, start].tolist() != now:
                yield pa.Table.from_batches(held)
                held = []
            now = own[:, start].tolist()
            held.append(batch.slice(start, end - start))
    if held:
        yield pa.Table.from_batches(held)


def shared_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many elements each set of left shares with each of right, through the elements that both sides have."""
    ids, at = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    rows = np.repeat(np.arange(len(left) + len(right)), [len(x) for x in (*left, *right)])
    there = np.bincount(at[rows < len(left)], minlength=len(ids)).astype(bool) & np.bincount(at[rows >= len(left)], minlength=len(ids)).astype(bool)
    place = np.cumsum(there) - 1
    rows, at = rows[there[at]], place[at[there[at]]]
    order = np.argsort(at, kind="stable")
    rows, at = rows[order], at[order]
    out = np.zeros((len(left), len(right)), np.int64)
    for k in range(0, int(there.sum()), 4096):
        part = slice(*np.searchsorted(at, (k, k + 4096)))
        has = np.zeros((len(left) + len(right), 4096), np.float32)
        has[rows[part], at[part] - k] = 1
        out += (has[: len(left)] @ has[len(left) :].T).astype(np.int64)
    return out


def crossing(members: DataFrame, similarity: float, most: int = CROWD, elements: int = ELEMENTS) -> DataFrame:
    """Edges (a, b) that connect the sets of a band (band, shingles, root, size, members) which have different roots and a Jaccard likeness of ``similarity`` or more.

    All such pairs of a band are compared, by matrix products over the shingles that they share;
    a star for each component leaves the task, not its pairs. Bands of over ``most`` sets or ``elements`` shingles
    are cut into tiles of two blocks.
    """
    n = F.ceil(2 * F.greatest(F.count("*") / most, F.sum("size") / elements)).cast("int")
    large = bounded(members.groupBy("band").agg(n.alias("blocks")).where("blocks > 2"))
    placed = members.join(large, "band", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("shingles"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other")).drop("blocks", "other")
    key = ["band", "low", "high"]
    dealt = placed.repartition(shuffle_partitions(members.sparkSession), *key).sortWithinPartitions(*key)

    def work(batches):
        for group in tiles(batches, key):
            names, roots, block = (group.column(c).to_numpy() for c in ("shingles", "root", "block"))
            sets = [x.values.to_numpy() for x in group.column("members")]
            sizes = np.array([len(x) for x in sets])
            left, right = np.flatnonzero(block == group.column("low")[0].as_py()), np.flatnonzero(block == group.column("high")[0].as_py())
            if not left.size or not right.size:
                continue
            both = shared_counts([sets[k] for k in left], [sets[k] for k in right])
            i, j = np.nonzero((both >= similarity * (sizes[left][:, None] + sizes[right] - both)) & (roots[left][:, None] != roots[right]))
            stars = Labels(len(names))
            stars.link(left[i], right[j])
            moved = np.flatnonzero(stars.of != np.arange(len(names)))
            yield to_batch(a=names[stars.of[moved]], b=names[moved])

    return dealt.mapInArrow(work, "a long, b long").distinct()


def alike(rows: DataFrame, docs: DataFrame, width: int, similarity: float, text_col: str = "text", most: int = 1_000_000) -> DataFrame:
    """Edges (a, b) between fingerprints of rows (see sketches) that connect all whose sets of shingles are equal,
    or share a band and have a Jaccard likeness of ``similarity`` or more, which is computed from the whole sets.

    First a band's sets meet those with its smallest and its largest key, which connects nearly
    all of a group of near copies by as many pairs as it has members. Then, in bands whose sets
    aren't all linked to the smallest one, all that aren't so both are compared (see crossing), so
    no link of a crowded band is lost. Ids meet first; pairs whose sizes can't be alike are
    dropped, and sets come to what is left. Sets without a candidate are never shuffled.
    """
    import pyarrow as pa

    own = cut(rows.where("shingles IS NOT NULL").groupBy("shingles").agg(F.min("bits").alias("first"), F.first("size").alias("size"), F.first("bands").alias("bands")))
    banded = cut(own.select("shingles", "size", F.explode("bands").alias("band")))
    ends = banded.groupBy("band").agg(F.min(F.struct("shingles", "size")).alias("low"), F.max(F.struct("shingles", "size")).alias("high"), F.count("*").alias("n")).where("low.shingles < high.shingles")
    met = banded.join(ends, "band").select("band", "shingles", "size", F.explode(F.array("low", "high")).alias("end")).where("shingles != end.shingles")
    met = met.where(F.least("size", "end.size") >= F.greatest("size", "end.size") * F.lit(similarity))
    pairs = cut(met.select(F.least("shingles", "end.shingles").alias("a"), F.greatest("shingles", "end.shingles").alias("b")).distinct())

    def work(batches):
        for batch in batches:
            sets = [shingle_set(t, width) for t in as_bytes(batch.column(0))]
            yield to_batch(shingles=np.array([set_key(x) for x in sets], np.uint64).view(np.int64), members=pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64())))

    def sets_of(wanted: DataFrame) -> DataFrame:
        wanted = cut(wanted.distinct())
        sets = map_texts(docs, work, "shingles long, members array<long>", F.col(text_col))
        return cut(sets.join(F.broadcast(wanted) if wanted.count() <= most else wanted, "shingles", "left_semi").dropDuplicates(["shingles"]))

    sets = sets_of(pairs.select(F.explode(F.array("a", "b")).alias("shingles")))
    both = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b")
    shared = F.size(F.array_intersect("x", "y"))
    linked = cut(both.where(shared >= similarity * (F.size("x") + F.size("y") - shared)).select("a", "b"))
    # In a band, those that are linked to its smallest set go by that one's name.
    sure = met.withColumn("a", F.least("shingles", "end.shingles")).withColumn("b", F.greatest("shingles", "end.shingles")).join(linked, ["a", "b"], "left_semi")
    named = sure.groupBy("band", "shingles").agg(F.min("end.shingles").alias("root"))
    placed = cut(banded.join(named, ["band", "shingles"], "left").select("band", "shingles", "size", F.least("shingles", F.coalesce("root", "shingles")).alias("root")))
    # In a band of three, all pairs have met an end.
    mixed = placed.groupBy("band").agg(F.min("root").alias("r"), F.max("root").alias("s"), F.count("*").alias("n")).where("r <> s AND n > 3").select("band")
    crowd = cut(placed.join(mixed, "band", "left_semi"))
    if not crowd.isEmpty():
        members = crowd.join(sets_of(crowd.select("shingles")), "shingles")
        linked = linked.unionAll(cut(crossing(members, similarity)))
    firsts = own.select("shingles", "first")
    links = linked.join(firsts.toDF("a", "p"), "a").join(firsts.toDF("b", "q"), "b").select(F.col("p").alias("a"), F.col("q").alias("b"))
    equal = rows.join(firsts, "shingles").where("bits != first").select(F.col("bits").alias("a"), F.col("first").alias("b"))
    return links.unionAll(equal).where("a != b").distinct()


def distance(a: np.ndarray, b) -> np.ndarray:
    return np.bitwise_count(a ^ b)


class Labels:
    """Components of n items, merged by arrays of pairs."""

    def __init__(self, n: int):
        self.of = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.of[a], self.of[b]
            new = x != y
            if not new.any():
                return
            low, high = np.minimum(x[new], y[new]), np.maximum(x[new], y[new])
            parent = np.arange(len(self.of))
            np.minimum.at(parent, high, low)
            while (up := parent[parent]).tobytes() != parent.tobytes():
                parent = up
            self.of = parent[self.of]
            a, b = a[new], b[new]


def link_within(bits: np.ndarray, radius: int = LINK, leaf: int = LEAF) -> np.ndarray:
    """For distinct fingerprints, the index of the first in each one's component of links.

    A vantage-point tree joined with itself: a node takes a vantage point and splits the rest
    at the median distance. A pair across the split, at distances p and q from the vantage
    point, is at least |p - q| apart, so only fingerprints in the rings within ``radius`` of
    the boundary are compared across it; all other pairs meet in a child.
    """
    labels = Labels(len(bits))

    def compare(a: np.ndarray, b: np.ndarray) -> None:
        step = max(1, (1 << 20) // max(1, len(b)))
        for k in range(0, len(a), step):
            i, j = np.nonzero(distance(bits[a[k : k + step]][:, None], bits[b][None, :]) <= radius)
            labels.link(a[k : k + step][i], b[j])

    todo = [np.arange(len(bits))]
    while todo:
        node = todo.pop()
        if len(node) <= leaf:
            compare(node, node)
            continue
        far = distance(bits[node], bits[node[len(node) // 2]]).astype(np.int16)
        split = int(np.median(far))
        if not (far > split).any():
            split -= 1
        if not (far <= split).any():  # all at one distance
            compare(node, node)
            continue
        inner, outer = far <= split, far > split
        todo += [node[inner], node[outer]]
        for ring in range(split - radius + 1, split + 1):
            if (a := node[far == ring]).size and (b := node[outer & (far <= ring + radius)]).size:
                compare(a, b)
    return labels.of


def levels_for(count: int, most: int) -> int:
    """Levels of vantage points after which a shard is expected to have well under ``most`` of count fingerprints."""
    return max(1, round(np.log(max(1, 8 * count / most)) / np.log(PER_LEVEL)))


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def one_level(rows: DataFrame, halves: int, radius: int) -> DataFrame:
    """rows (tree, shard, bits) a level further down, with ``above``, the shard that each comes from (see vantage_shards)."""
    edges = [round(k * BITS / halves) for k in range(halves + 1)]
    masks = F.array(*(F.lit(signed(sum(1 << b for b in range(edges[t], edges[t + 1])))) for t in range(halves)))
    near = radius // halves
    far = F.bit_count(F.col("bits").bitwiseXOR(F.xxhash64("shard", F.lit("vantage"))).bitwiseAND(F.get(masks, F.col("tree"))))
    rings = F.array_distinct(F.array(F.floor(far / RING), F.floor(F.greatest(far - near, F.lit(0)) / RING)))
    return rows.select("tree", "shard", "bits", F.explode(rings).alias("ring")).select("tree", F.xxhash64("shard", "ring").alias("shard"), "bits", F.col("shard").alias("above"))


def vantage_shards(nodes: DataFrame, levels: int, halves: int = 2, radius: int = LINK) -> DataFrame:
    """(tree, shard, bits): each fingerprint in every shard of the trees in which it may meet a link.

    The bits are cut into ``halves`` parts, each with a tree of its own: fingerprints within
    radius differ by at most near = radius // halves in one of the parts, so they are near
    neighbours there. A node of a tree has a vantage point (a hash of the node's number), and a
    branch for each ring of RING distances to it. By the triangle inequality, distances of near
    neighbours to a vantage point differ by near at most: a fingerprint goes to the ring of its
    own distance and, if the distance less near lies in the ring before, to that one as well.
    The farther of two neighbours so always comes along to the ring of the nearer, at every node
    on the way down, and both end in a common shard.
    """
    rows = nodes.select(F.explode(F.array(*map(F.lit, range(halves)))).alias("tree"), "bits").select("tree", F.xxhash64("tree").alias("shard"), "bits")
    for _ in range(levels):
        rows = one_level(rows, halves, radius).drop("above")
    return rows


def split_large(shards: DataFrame, most: int = SHARD, radius: int = LINK, halves: int = 2) -> DataFrame:
    """(shard, bits): shards of vantage_shards of which those of over ``most`` fingerprints go on down their tree, each as deep as it needs; no link is lost.

    Only these shards are counted again and split, a level a round. A shard most of which (DENSE)
    stays together under a vantage point of its own holds near copies, which rings can't part; it
    is dealt by blocks of bits instead.
    """
    done, todo, dense = None, shards, None
    while True:
        large = cut(todo.groupBy("shard").agg(F.count("*").alias("n")).where(F.col("n") > most))
        if large.isEmpty():
            break
        small = todo.join(large, "shard", "left_anti")
        done = small if done is None else done.unionByName(small)
        above = cut(todo.join(large, "shard", "left_semi"))
        below = cut(one_level(above, halves, radius))
        parts = below.groupBy("above", "shard").agg(F.count("*").alias("part")).groupBy("above").agg(F.max("part").alias("part"))
        stuck = cut(parts.join(large.withColumnRenamed("shard", "above"), "above").where(F.col("part") > F.col("n") * F.lit(DENSE)).select(F.col("above").alias("shard")))
        if not stuck.isEmpty():
            held = above.join(stuck, "shard", "left_semi").select("shard", "bits")
            dense = held if dense is None else dense.unionByName(held)
        todo = below.join(stuck.withColumnRenamed("shard", "above"), "above", "left_anti").select("tree", "shard", "bits")
    rest = todo if done is None else done.unionByName(todo)
    rest = rest.select("shard", "bits")
    return rest if dense is None else rest.unionByName(split_dense(cut(dense), most, radius))


def split_dense(shards: DataFrame, most: int, radius: int) -> DataFrame:
    """(shard, bits): shards of near copies in smaller ones; no link is lost.

    Fingerprints within radius agree on all bits of b - radius of b blocks. So a shard is dealt
    anew by the bits of each such choice, for growing b until it is small: with b = 4 on 16
    bits in 4 copies, with 6 on 32 in 20, with 8 on 40 in 56. If even that leaves large ones,
    these are cut by a hash and each pair of cuts compared.
    """
    done, todo = None, shards
    for blocks in (radius + 1, radius + 3, radius + 5, None):
        if blocks:
            edges = [round(k * BITS / blocks) for k in range(blocks + 1)]
            masks = [sum(1 << b for b in range(edges[k], edges[k + 1])) for k in range(blocks)]
            views = F.explode(F.array(*(F.lit(signed(sum(x))) for x in combinations(masks, blocks - radius))))
            dealt = todo.select("shard", "bits", views.alias("view")).select("shard", "bits", F.xxhash64("shard", "view", F.col("bits").bitwiseAND(F.col("view"))).alias("part"))
        else:
            sizes = cut(todo.groupBy("shard").agg(F.ceil(F.count("*") * 2 / most).cast("int").alias("n")))
            block = F.pmod(F.xxhash64("bits", "shard"), F.col("n")).cast("int")
            each = todo.join(sizes, "shard").withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
            dealt = each.select("shard", "bits", F.xxhash64("shard", F.least("block", "other"), F.greatest("block", "other")).alias("part"))
            return done.unionAll(dealt.select(F.col("part").alias("shard"), "bits"))
        # Sizes are of a choice of bits within a shard; a shard is dealt anew if any of its parts is large.
        large = cut(dealt.groupBy("part", "shard").count().where(F.col("count") > most).select("shard").distinct())
        few = large.isEmpty()
        kept = (dealt if few else dealt.join(large, "shard", "left_anti")).select(F.col("part").alias("shard"), "bits")
        done = kept if done is None else done.unionAll(kept)
        if few:
            return done
        todo = cut(todo.join(large, "shard", "left_semi").select("shard", "bits"))
    return done


def near_links(nodes: DataFrame, radius: int = LINK, halves: int = 2, most: int = SHARD) -> DataFrame:
    """Edges (a, b) that connect exactly the fingerprints which links within ``radius`` connect.

    nodes has distinct ``bits``. A shard yields a star for each component in it, not its pairs.
    """
    shards = split_large(cut(vantage_shards(nodes, levels_for(nodes.count(), most), halves, radius)), most, radius, halves)
    dealt = shards.repartition(shuffle_partitions(nodes.sparkSession), "shard").sortWithinPartitions("shard", "bits")

    def work(batches):
        held: list[np.ndarray] = [np.empty((2, 0), np.int64)]
        for batch in batches:
            rows = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()])
            if rows.shape[1] and rows[0, -1] != (held[-1][0, -1] if held[-1].size else None):
                last = int(np.searchsorted(rows[0], rows[0, -1]))
                yield stars(np.concatenate([*held, rows[:, :last]], axis=1))
                held = [rows[:, last:]]
            else:
                held.append(rows)
        yield stars(np.concatenate(held, axis=1))

    def stars(rows: np.ndarray):
        a, b = [], []
        starts = np.flatnonzero(np.diff(rows[0], prepend=rows[0, :1] - 1)) if rows.size else np.empty(0, int)
        sizes = np.diff(np.append(starts, rows.shape[1]))
        bits = rows[1].view(np.uint64) if rows.size else np.empty(0, np.uint64)
        for start, size in zip(starts[sizes > 1].tolist(), sizes[sizes > 1].tolist(), strict=True):
            own = np.unique(bits[start : start + size])
            first = link_within(own, radius)
            if (moved := first != np.arange(len(own))).any():
                a.append(own[first[moved]])
                b.append(own[moved])
        pick = lambda x: (np.concatenate(x) if x else np.empty(0, np.uint64)).view(np.int64)
        return to_batch(a=pick(a), b=pick(b))

    return dealt.mapInArrow(work, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = LINK, halves: int = 2, most: int = SHARD, similarity: float | None = None, width: int = 5) -> DataFrame:
    """One row per row of docs: doc_id, bits (signed), component_id.

    Rows link when their fingerprints differ in at most ``radius`` bits; component_id is the
    smallest doc_id that a row reaches by links. Rows of equal fingerprint are one node, so
    copies, however many, cost a row each and nothing more. A text without words (null, empty,
    white space) has the fingerprint 0 and links like any other. Rows may repeat; a null id is
    never the smallest unless all of its component are null. Other columns are not read; an
    empty table gives an empty result. With similarity, rows also link when the Jaccard likeness
    of their shingles of ``width`` words is that or more (see alike).
    """
    rows = cut(sketches(docs, width, id_col, text_col) if similarity else fingerprints(docs, id_col, text_col))
    nodes = cut(rows.groupBy("bits").agg(F.min("doc_id").alias("first")))
    links = near_links(nodes.select("bits"), radius, halves, most)
    if similarity:
        links = links.unionAll(alike(rows, docs, width, similarity, text_col))
    roots = cut(components(links))
    rooted = nodes.join(roots, nodes.bits == roots.node, "left").select("bits", "first", F.coalesce("root", "bits").alias("root"))
    smallest = cut(rooted.groupBy("root").agg(F.min("first").alias("component_id")))
    named = cut(rooted.join(smallest, "root").select("bits", "component_id"))
    return rows.join(named, "bits").select("doc_id", "bits", "component_id")


def drop_near_duplicates(docs: DataFrame, text_col: str = "text", radius: int = LINK, similarity: float | None = None, width: int = 5) -> DataFrame:
    """The rows of docs, as they are, whose id is the smallest of their component.

    Rows that share an id stay together if any of them stays. Rows without an id stay.
    """
    found = near_duplicates(docs, text_col=text_col, radius=radius, similarity=similarity, width=width).select("doc_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))
    ids = found.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.bool_or("kept").alias("kept"))
    return keep_ids(docs, ids.where("NOT kept"), drop=True)
