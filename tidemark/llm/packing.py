"""Best-fit packing of tokenised documents by the sum of squares of open bins per gap."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.bpe import encoder
from tidemark.llm.common import as_bytes, cut, map_texts, to_batch

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Pieces that one group packs, about, and the gap from which a group's bin is packed once more.
GROUP, REOPEN = 40_000, 32
#: A round that leaves more than this share of its pieces loose is followed by the last one.
SHRINK = 0.75


def pieces(docs: DataFrame, path: str, capacity: int, end: int | None, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """The pieces of every whole text: its ids, then ``end``, cut only if there are over capacity.

    Of a text that is cut, the first piece takes what capacity leaves over, the others are full.
    A null text is empty: the end id alone. With with_ids each row also has its ids.
    """
    tail = b"" if end is None else np.array([end], "<u4").tobytes()

    def work(batches):
        own = encoder(path, "byte")
        for batch in batches:
            rows: list[list] = [[], [], [], [], [], []]
            for doc, ids in zip(batch.column(0).to_pylist(), own.encode_named(as_bytes(batch.column(1)), named=False), strict=True):
                ids = ids[0] + tail
                n = len(ids) // 4
                cuts = [0, *range(n % capacity or min(capacity, n), n + 1, capacity)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:])):  # noqa: B905, RUF007
                    part = ids[4 * a : 4 * b]
                    for column, value in zip(rows, (doc, k, a, b - a, zlib.crc32(part), part if with_ids else None), strict=True):
                        column.append(value)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            yield to_batch(**{k: pa.array(v, t) for k, v, t in zip(names[: 5 + with_ids], rows, kinds, strict=False)})

    return map_texts(docs, work, PIECES + ", ids binary" * with_ids, F.col(id_col).cast("long"), F.col(text_col))


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset) of each piece, in the order given, and the gap that each bin is left with.

    open_[g] is the number of open bins with gap g. A piece of length s goes where the sum of
    the squares of open_[1:] grows least: into a bin of some gap g >= s, or into a new one.
    Full bins don't count. Ties: the smallest gap.
    """
    open_ = np.zeros(capacity + 1, np.int64)
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    gaps: list[int] = []
    for k, s in enumerate(lengths.tolist()):
        # Growth when a bin goes from gap g to gap g - s: 2 (open[g - s] - open[g]) + 2; gap 0 isn't counted.
        grow = 2 * (open_[: capacity + 1 - s] - open_[s:]) + 2
        grow[0] = 1 - 2 * open_[s]
        grow[open_[s:] == 0] = np.iinfo(np.int64).max
        best = int(grow.argmin()) + s
        fresh = 2 * open_[capacity - s] + 1 if s < capacity else 0
        if open_[best] == 0 or grow[best - s] > fresh:
            b, gap = len(gaps), capacity
            gaps.append(capacity)
        else:
            b, gap = stacks[best].pop(), best
            open_[best] -= 1
        bins[k], offsets[k] = b, capacity - gap
        gaps[b] = gap - s
        if gaps[b]:
            open_[gaps[b]] += 1
            stacks[gaps[b]].append(b)
    return bins, offsets, np.array(gaps, np.int64)


def pack_group(lengths: np.ndarray, capacity: int, last: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """sum_of_squares over pieces in the order given; in the last round, its bins of gap REOPEN or more are
    packed once more, longest piece first, and kept if that takes fewer bins."""
    bins, offsets, gaps = sum_of_squares(lengths, capacity)
    if last and (loose := gaps >= REOPEN).any():
        own = np.flatnonzero(loose[bins])
        own = own[np.argsort(-lengths[own], kind="stable")]
        again, at, left = sum_of_squares(lengths[own], capacity)
        if len(left) < loose.sum():
            renumber = np.cumsum(~loose) - 1
            bins = renumber[bins]
            bins[own], offsets[own] = (~loose).sum() + again, at
            gaps = np.concatenate([gaps[~loose], left])
    return bins, offsets, gaps


def packer(capacity: int, turn: int, last: bool):
    """The function that packs one group's rows in a round."""

    def work(rows):
        rows = rows.sort_values(["order", "salt"], kind="stable").reset_index(drop=True)
        bins, offsets, gaps = pack_group(rows["length"].to_numpy(), capacity, last)
        rows["sequence_id"] = (turn << 56) + rows["group"] * (1 << 24) + bins
        rows["offset"] = offsets
        rows["loose"] = (gaps >= REOPEN)[bins] & (not last)
        return rows.drop(columns=["order", "group"])

    return work


def pack(items: DataFrame, capacity: int, group: int = GROUP) -> DataFrame:
    """items (doc_id, piece, start, length, ids_crc32) with sequence_id and offset.

    Pieces are dealt into groups of about ``group`` by a hash of doc_id, piece and the row's
    number, which is checkpointed with it, so rows that share an id (or have none) spread like
    any others. In the hash's order each group packs its own. What a group leaves loosely filled
    is taken out and packed with that of other groups in a next round, until a round has one group. Where lengths tile
    capacity well, that is a few hundred bins a group, and the waste is that of one group. Where
    they don't (most pieces over half of capacity), the loose bins are the lengths' own and other
    groups can't fill them: after a round that leaves more than SHRINK of its pieces loose, the
    next is the last, in which each group keeps what it packs. So no task has more than a group,
    all rounds together pack at most 1 / (1 - SHRINK) + 1 times the pieces, and rounds are fewer
    than the 128 that sequence_id, which holds round, group and bin, has room for. Every round is
    checkpointed. Repeated rows are pieces of their own.
    """
    schema = f"{PIECES}, salt long, sequence_id long, offset long, loose boolean"
    done, todo, turn, before = None, cut(items.withColumn("salt", F.monotonically_increasing_id())), 0, None
    while True:
        count = todo.count()
        groups = max(1, -(-count // group))
        order = F.xxhash64("doc_id", "piece", "salt", F.lit(turn))
        dealt = todo.withColumn("order", order).withColumn("group", F.pmod(F.xxhash64("order"), F.lit(groups)))
        last = groups == 1 or (before is not None and count > SHRINK * before)
        packed = cut(dealt.groupBy("group").applyInPandas(packer(capacity, turn, last), schema))
        kept = packed.where("NOT loose").drop("loose", "salt")
        done = kept if done is None else done.unionByName(kept)
        if last:
            return done
        todo, turn, before = packed.where("loose").drop("loose", "sequence_id", "offset"), turn + 1, count


def pack_documents(docs: DataFrame, path: str, capacity: int = 1024, end: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Packs all documents' pieces (see pieces) into sequences of at most capacity tokens (see pack).

    path names a tokenizer file that every executor has; end is the id put after each text. A null
    text is empty. Without end, an empty text has one piece of no length. An empty table gives an
    empty result. Ids of rows may repeat or be null; other columns are not read.
    """
    return pack(pieces(docs, path, capacity, end, id_col, text_col), capacity)
