"""How far the sources of a language are apart in the words they use, by tiles of groups and vocabulary."""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import as_bytes, bounded, cut, map_texts, shuffle_partitions, to_batch

#: A term's share is counted in units of 1 / SCALE, after SMOOTH is added to each count.
SCALE, SMOOTH = 1_000_000_000, 5
#: Every byte that no term has becomes a space, A-Z become a-z.
TO_TERMS = bytes(b if b > 0x7F or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 32 for b in range(256))
#: Terms of a vocabulary chunk; successive chunks that one task goes through; groups of a block.
CHUNK, SLAB, BLOCK = 512, 4, 48
#: Bytes of a text split at a time, and counts that a task holds before it hands them on.
STEP, HELD = 1 << 20, 300_000


def term_counts(docs: DataFrame, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term and documents with it. A row with a null term counts the documents of every group."""

    def pieces(text: bytes):
        at = 0
        while len(text) - at > STEP:
            end = text.find(b" ", at + STEP)
            if end < 0:
                break
            yield text[at:end].split()
            at = end
        yield text[at:].split()

    def work(batches):
        occurring, having = {}, {}

        def counted():
            import pyarrow as pa

            for (lang, source), words in occurring.items():
                documents = having[lang, source]
                terms = list(documents)
                n = [words[t] for t in terms]
                terms = pa.array([t or None for t in terms], pa.binary()).cast(pa.string())
                yield to_batch(lang=pa.array([lang] * len(n), pa.string()), source=pa.array([source] * len(n), pa.string()), term=terms, n=pa.array(n, pa.int64()), docs=pa.array(documents.values(), pa.int64()))

        for batch in batches:
            for text, lang, source in zip(as_bytes(batch.column(0)), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words, seen = occurring.setdefault((lang, source), Counter()), {b""}
                for piece in pieces(text.translate(TO_TERMS)):
                    words.update(piece)
                    seen.update(piece)
                having.setdefault((lang, source), Counter()).update(seen)
            if sum(map(len, having.values())) > HELD:
                yield from counted()
                occurring, having = {}, {}
        yield from counted()

    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    counts = map_texts(docs, work, "lang string, source string, term string, n long, docs long", F.col(text_col), empty(lang_col), empty(source_col))
    return counts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: str, total: str, terms: str) -> Column:
    """1 + floor(SCALE * (n + SMOOTH) / (total + SMOOTH * terms)), exactly."""
    return F.expr(f"1 + (CAST({n} + {SMOOTH} AS DECIMAL(20, 0)) * {SCALE}BD) div CAST({total} + {SMOOTH} * {terms} AS DECIMAL(20, 0))")


def shares(n: np.ndarray, total: np.ndarray, terms: int) -> np.ndarray:
    """The same on arrays: the quotient's nine digits in three steps, so that 64 bits hold counts up to 9e15."""
    over = total + SMOOTH * terms
    left, out = n + SMOOTH, np.int64(0)
    for _ in range(3):
        digits, left = np.divmod(left * 1000, over)
        out = out * 1000 + digits
    return out + 1


class Tile:
    """The pairs between two blocks of groups over a run of vocabulary chunks, which are added one after the other.

    A term that neither group has counts |base - base|; the first slab adds that for the whole
    vocabulary, and chunks add what differs from it.
    """

    def __init__(self, key: tuple):
        self.lang, self.slab, self.low, self.high = key
        self.groups: dict[tuple, int] = {}
        self.totals: list[int] = []
        self.terms, self.chunk, self.waiting = 0, None, []

    def add_group(self, block: int, source: str, total: int, terms: int) -> None:
        self.groups[block, source] = len(self.totals)
        self.totals.append(total)
        self.terms = terms

    def settle(self) -> None:
        """Fixes the groups once all are known."""
        total = np.array(self.totals, np.int64)[:, None]
        self.total, blocks = total, np.array([block for block, _ in self.groups])
        self.rows, self.cols = np.flatnonzero(blocks == self.low), np.flatnonzero(blocks == self.high)
        self.base = shares(np.zeros_like(total), total, self.terms) if self.terms else np.zeros_like(total)
        self.sums = np.abs(self.base[self.rows] - self.base[self.cols].T) * (self.terms if self.slab == 0 else 0)

    def add_counts(self, chunk: int, width: int, block: int, source: str, at: np.ndarray, n: np.ndarray) -> None:
        if chunk != self.chunk:
            self.fold()
            self.chunk, self.width = chunk, width
        self.waiting.append((self.groups[block, source], at, n))

    def fold(self) -> None:
        """Adds the chunk that has been read."""
        if not self.waiting:
            return
        counts = np.zeros((len(self.total), self.width), np.int64)
        for group, at, n in self.waiting:
            counts[group, at] = n
        p = shares(counts, self.total, self.terms) - self.base
        base, right = self.base[:, 0], p[self.cols]
        for k, row in enumerate(self.rows):
            gap = base[row] - base[self.cols]
            self.sums[k] += np.abs(p[row] - right + gap[:, None]).sum(axis=1) - np.abs(gap) * self.width
        self.waiting = []

    def pairs(self):
        self.fold()
        names = [source for _, source in self.groups]
        for k, row in enumerate(self.rows):
            for j, col in enumerate(self.cols):
                if row != col:
                    yield names[row], names[col], int(self.sums[k, j])
                    if self.low != self.high:
                        yield names[col], names[row], int(self.sums[k, j])


def tile_sums(batches):
    """Rows in order of tile and chunk (groups first, as chunk -1) to (lang, source, item, value), a part of each pair's sum."""
    tile, settled = None, False

    def done(tile):
        import pyarrow as pa

        found = list(tile.pairs())
        left, right, value = zip(*found, strict=True) if found else ((), (), ())
        text = pa.string()
        return to_batch(lang=pa.array([tile.lang] * len(found), text), source=pa.array(left, text), item=pa.array(right, text), value=pa.array(value, pa.int64()))

    for batch in batches:
        lists, counts = batch.column("at"), batch.column("n")
        scalars = zip(*(batch.column(c).to_pylist() for c in ("lang", "slab", "low", "high", "chunk", "block", "source", "total", "terms", "width")), strict=True)
        for k, (lang, slab, low, high, chunk, block, source, total, terms, width) in enumerate(scalars):
            key = (lang, slab, low, high)
            if tile is None or key != (tile.lang, tile.slab, tile.low, tile.high):
                if tile is not None:
                    if not settled:
                        tile.settle()
                    yield done(tile)
                tile, settled = Tile(key), False
            if chunk < 0:
                tile.add_group(block, source, total, terms)
                continue
            if not settled:
                tile.settle()
                settled = True
            tile.add_counts(chunk, width, block, source, lists[k].values.to_numpy(), counts[k].values.to_numpy())
    if tile is not None:
        if not settled:
            tile.settle()
        yield done(tile)


def source_divergence(docs: DataFrame, least_docs: int = 30, most_terms: int = 50, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", chunk: int = CHUNK, slab: int = SLAB, block: int = BLOCK) -> DataFrame:
    """How the groups (lang, source) differ: lang, source, part, item, value, rank.

    Terms are runs of ASCII letters and of all characters beyond ASCII, A-Z lower-cased. A
    language keeps the terms that at least ``least_docs`` of its documents have. A group gives
    each kept term the share p = 1 + floor(1e9 * (count + 5) / (N + 5 V)): V terms, N their
    occurrences in the group. Part ``pair``: every other source of the language, by the sum
    over all kept terms of |p - its p|. Part ``term``: the kept terms whose share in the group
    is over the language's, by the difference, the ``most_terms`` largest. Ties go by item.
    All is exact for counts up to 9e15.

    Count vectors are packed by group and vocabulary chunk. Groups are dealt into blocks, and
    the vectors of a block go to each tile that pairs it with a block; a tile takes ``slab``
    successive chunks, one at a time, so its memory depends on ``block`` and ``chunk`` alone. A
    language of one hot source or of a few sources is still many tasks.

    Null texts, languages and sources are empty; repeated rows count each; a group without
    terms has all its pairs; with no kept term they are 0. Texts of any length count whole. Other
    columns are not read; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    counts = cut(term_counts(docs, text_col, lang_col, source_col))
    vocabulary = cut(counts.where("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("n").alias("all_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs).drop("docs"))
    kinds = counts.where("term IS NULL").groupBy("lang").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    sizes = vocabulary.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("all_n").alias("lang_total"))
    langs = kinds.join(sizes, "lang", "left").fillna(0, ["terms", "lang_total"]).withColumn("chunks", F.ceil(F.col("terms") / chunk).cast("int"))
    langs = bounded(langs)
    numbered = vocabulary.join(langs.select("lang", "chunks"), "lang").withColumn("chunk", F.pmod(F.xxhash64("term"), F.col("chunks")).cast("int")).drop("chunks")
    own = Window.partitionBy("lang", "chunk")
    numbered = numbered.withColumn("at", F.row_number().over(own.orderBy("term")) - 1).withColumn("width", F.count("*").over(own).cast("int"))
    kept = cut(counts.where("n > 0").select("lang", "source", "term", "n").join(numbered, ["lang", "term"]))

    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = counts.where("term IS NULL").select("lang", "source").join(totals, ["lang", "source"], "left").fillna(0, ["total"])
    groups = bounded(groups.join(langs, "lang").withColumn("block", F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int")))

    packed = kept.groupBy("lang", "source", "chunk", "width").agg(F.collect_list(F.struct("at", "n")).alias("vector"))
    vectors = packed.select("lang", "source", "chunk", "width", F.col("vector.at").alias("at"), F.col("vector.n").alias("n"))
    vectors = vectors.join(groups.select("lang", "source", "block", "blocks"), ["lang", "source"]).withColumn("slab", (F.col("chunk") / slab).cast("int"))
    nothing = [F.lit(None).cast("int").alias("width"), F.array().cast("array<int>").alias("at"), F.array().cast("array<long>").alias("n")]
    slabs = F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("chunks") / slab).cast("int") - 1, F.lit(0))))
    heads = groups.select("lang", "source", "block", "blocks", "total", "terms", slabs.alias("slab"), F.lit(-1).alias("chunk"), *nothing)
    rows = heads.unionByName(vectors, allowMissingColumns=True).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other")).drop("other", "blocks")
    tile = ["lang", "slab", "low", "high"]
    dealt = rows.repartition(shuffle_partitions(spark), *tile).sortWithinPartitions(*tile, "chunk")
    values = dealt.mapInArrow(tile_sums, "lang string, source string, item string, value long").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    order = [F.col("value").desc(), F.col("item")]
    pairs = values.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(*order)))

    terms = kept.join(groups.select("lang", "source", "total", "terms", "lang_total"), ["lang", "source"])
    terms = terms.select("lang", "source", F.col("term").alias("item"), (share("n", "total", "terms") - share("all_n", "lang_total", "terms")).alias("value")).where("value > 0")
    # The best of each of sixteen parts of a group, then the best of these.
    part = terms.withColumn("salt", F.pmod(F.xxhash64("item"), F.lit(16)))
    first = part.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source", "salt").orderBy(*order))).where(F.col("rank") <= most_terms)
    best = first.drop("rank", "salt").withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(*order))).where(F.col("rank") <= most_terms)
    out = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return out(pairs, "pair").unionAll(out(best, "term"))
