"""Document quality by a byte-level convolutional network in numpy."""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import as_bytes, cut, keep_ids, limit_batches, map_texts, to_batch

#: Filters of a member net, members, bytes under a filter, bytes of a block, and blocks of a chunk; chunks overlap by a block.
FILTERS, MEMBERS, WIDTH, BLOCK, CHUNK = 8, 4, 5, 64, 8
#: Labelled rows to learn from at most, and bytes of each (longer texts aren't learned from); training steps, rows of a step, and step size.
SAMPLE_ROWS, LONGEST, STEPS, STEP_ROWS, RATE = 2000, 1 << 20, 480, 32, 0.01
#: Bytes of all texts to learn from at most.
SAMPLE_BYTES = 32 << 20
#: Bytes through the filters at a time.
SPAN = 1 << 18


@dataclass
class Net:
    """filters: for each offset and byte what it adds to each filter; then a linear layer."""

    filters: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: float


def bytes_of(text: bytes) -> np.ndarray:
    """The bytes of a text; short ones are padded with zeros."""
    return np.frombuffer(text + b"\0" * max(0, BLOCK + WIDTH - len(text)), np.uint8)


def responses(net: Net, b: np.ndarray) -> np.ndarray:
    """Each filter's response at each place, not below 0."""
    n = len(b) - WIDTH + 1
    r = net.filters[0][b[:n]] + net.bias
    for k in range(1, WIDTH):
        r += net.filters[k][b[k : n + k]]
    return np.maximum(r, 0, out=r)


def chunk_bounds(blocks: int) -> tuple[np.ndarray, np.ndarray]:
    starts = np.arange(0, max(1, blocks - 1), CHUNK - 1)
    return starts, np.minimum(starts + CHUNK, blocks)


def pool(peak: np.ndarray) -> np.ndarray:
    """A text's features: the peaks of its chunks, averaged and at their highest.

    peak is each block's; every chunk spans CHUNK blocks and shares one with the next.
    """
    starts, ends = chunk_bounds(len(peak))
    chunks = np.stack([peak[a:b].max(axis=0) for a, b in zip(starts, ends, strict=True)])
    return np.concatenate([chunks.mean(axis=0), chunks.max(axis=0)])


def features(net: Net, text: bytes) -> np.ndarray:
    """Features of a whole text, SPAN bytes at a time, so that memory doesn't grow with it."""
    b = bytes_of(text)
    n = len(b) - WIDTH + 1
    peaks = []
    for at in range(0, n, SPAN):
        r = responses(net, b[at : min(at + SPAN, n) + WIDTH - 1])
        peaks.append(np.maximum.reduceat(r, np.arange(0, len(r), BLOCK)))
    return pool(np.concatenate(peaks))


def probability(net: Net, feats: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(feats @ net.out + net.out_bias, -60, 60)))


def train_member(texts: list[bytes], labels: list[int], seed: int) -> Net:
    """Fits the filters and the linear layer together by Adam on the logistic loss.

    Rows of the rarer label weigh as much in all as half of the others. Without rows of both labels
    the net answers the share of label 1 (or 1/2).
    """
    rng = np.random.default_rng(seed)
    net = Net(rng.normal(0, 0.15, (WIDTH, 256, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32), np.zeros(2 * FILTERS), 0.0)
    y = np.asarray(labels, float)
    if len(set(labels)) < 2:
        share = (y.sum() + 1) / (len(y) + 2) if len(y) else 0.5
        net.out_bias = float(np.log(share / (1 - share)))
        return net
    rare = float(y.mean() < 0.5)
    weight = np.where(y == rare, max(1.0, 0.5 * (y != rare).sum() / (y == rare).sum()), 1.0)
    net.out = rng.normal(0, 0.1, 2 * FILTERS)
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (net.filters, net.bias, net.out)] + [[0.0, 0.0]]
    order = np.concatenate([rng.permutation(len(y)) for _ in range(-(-STEPS * STEP_ROWS // len(y)))])
    for step in range(1, STEPS + 1):
        grads = [np.zeros_like(net.filters), np.zeros_like(net.bias), np.zeros_like(net.out), 0.0]
        for k in order[(step - 1) * STEP_ROWS : step * STEP_ROWS]:
            _backward(net, bytes_of(texts[k]), y[k], weight[k] / STEP_ROWS, grads)
        rate = RATE * (1 - (step - 1) / STEPS)
        moves = []
        for g, m in zip(grads, moments, strict=True):
            m[0] = 0.9 * m[0] + 0.1 * g
            m[1] = 0.99 * m[1] + 0.01 * g * g
            moves.append(rate * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.99**step)) + 1e-6))
        net.filters -= moves[0].astype(np.float32)
        net.bias -= moves[1].astype(np.float32)
        net.out -= moves[2]
        net.out_bias -= float(moves[3])
    return net


def _backward(net: Net, b: np.ndarray, y: float, weight: float, grads: list) -> None:
    """Adds one text's gradient. Peaks pass it to the place that they came from."""
    r = responses(net, b)
    n = len(r)
    cuts = np.arange(0, n, BLOCK)
    peak = np.maximum.reduceat(r, cuts)
    feats = pool(peak)
    slope = weight * (probability(net, feats) - y)
    grads[2] += slope * feats
    grads[3] += slope
    back = slope * net.out
    starts, ends = chunk_bounds(len(peak))
    to_block = np.zeros_like(peak, dtype=float)
    each = np.arange(FILTERS)
    tops = np.stack([a + peak[a:z].argmax(axis=0) for a, z in zip(starts, ends, strict=True)])
    np.add.at(to_block, (tops, each[None, :]), back[:FILTERS] / len(tops))
    to_block[peak.argmax(axis=0), each] += back[FILTERS:]
    full = np.full((len(cuts) * BLOCK, FILTERS), -1, np.float32)
    full[:n] = r
    place = full.reshape(len(cuts), BLOCK, FILTERS).argmax(axis=1) + cuts[:, None]
    block, which = np.nonzero((to_block != 0) & (peak > 0))
    at, g = place[block, which], to_block[block, which]
    grads[1] += np.bincount(which, g, FILTERS).astype(np.float32)
    for k in range(WIDTH):
        np.add.at(grads[0][k], (b[at + k], which), g.astype(np.float32))


def join_members(nets: list[Net]) -> Net:
    """One net with the filters of all: its logit is the mean of theirs."""
    halves = [np.concatenate([n.out[k * FILTERS : (k + 1) * FILTERS] for n in nets]) for k in (0, 1)]
    return Net(np.concatenate([n.filters for n in nets], axis=2), np.concatenate([n.bias for n in nets]), np.concatenate(halves) / len(nets), float(np.mean([n.out_bias for n in nets])))


def train(texts: list[bytes], labels: list[int], seed: int = 7) -> Net:
    """MEMBERS small nets, each fitted in a task of its own from the same rows and another start, joined."""
    spark = SparkSession.active()
    sample = spark.sparkContext.broadcast((texts, labels))

    def fit(batches):
        for ids in batches:
            yield pd.DataFrame({"id": ids["id"], "net": [pickle.dumps(train_member(*sample.value, seed + int(k))) for k in ids["id"]]})

    found = spark.range(0, MEMBERS, 1, MEMBERS).mapInPandas(fit, "id long, net binary").collect()
    return join_members([pickle.loads(r["net"]) for r in sorted(found, key=lambda r: r["id"])])


def labelled_sample(docs: DataFrame, labels: DataFrame, learn_from: Column, rows: int = SAMPLE_ROWS, most_bytes: int = SAMPLE_BYTES) -> tuple[list[bytes], list[int]]:
    """At most ``rows`` whole texts with their labels, of most_bytes bytes together, of the rows of labels that learn_from picks.

    A row is drawn by a hash of its id with a chance that gives 1.2 times ``rows``; the ids
    drawn, bounded so, fetch their texts, one an id (the smallest, where rows share it). Of these
    the first by the draw are learned from, up to both bounds, which hold in the plan, before
    anything reaches the driver. Null labels, null ids and texts of over LONGEST bytes are left
    out, a null text is empty. Without a labelled row the sample is empty.
    """
    usable = labels.where(learn_from & F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "quality")
    draw = F.pmod(F.xxhash64("doc_id", F.lit("quality")), F.lit(1 << 30)) / float(1 << 30)
    count = usable.count()
    drawn = usable.where(draw < min(1.0, 1.2 * rows / max(1, count))).withColumn("draw", draw)
    texts = keep_ids(docs.select("doc_id", "text").where(F.coalesce(F.octet_length("text"), F.lit(0)) <= LONGEST), drawn, drop=False)
    texts = texts.groupBy("doc_id").agg(F.coalesce(F.min("text"), F.lit("")).alias("text"))
    found = cut(drawn.join(texts, "doc_id").select("draw", "doc_id", "text", "quality"))
    order = Window.orderBy("draw", "doc_id", "quality").rowsBetween(Window.unboundedPreceding, 0)  # about 1.2 times ``rows``, without their texts
    sizes = found.select("draw", "doc_id", "quality", F.octet_length("text").cast("long").alias("size"))
    first = sizes.withColumn("bytes", F.sum("size").over(order)).withColumn("k", F.count("*").over(order)).where((F.col("bytes") <= most_bytes) & (F.col("k") <= rows))
    picked = found.join(F.broadcast(first.select("doc_id", "quality").distinct()), ["doc_id", "quality"]).collect()
    picked = sorted(picked, key=lambda r: (r["draw"], r["doc_id"], r["quality"]))
    return [r["text"].encode() for r in picked], [int(r["quality"]) for r in picked]


def score(docs: DataFrame, net: Net, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of each row: the probability that its whole text has label 1.

    Null counts as the empty text, which is scored like a text of zero bytes. The text is all
    that is read; ids may repeat or be null. An empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def work(batches):
        net = shared.value
        for batch in batches:
            feats = [features(net, t) for t in as_bytes(batch.column(1))]
            yield to_batch(doc_id=batch.column(0), score=probability(net, np.array(feats).reshape(len(feats), -1)))

    return map_texts(docs, work, "doc_id long, score double", F.col(id_col).cast("long"), F.col(text_col))


def of_quality(docs: DataFrame, net: Net, least: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows of docs, as they are, that score ``least`` or more. Null counts as the empty text; rows that repeat stay or go together; an empty table stays empty."""
    limit_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(net)

    @F.pandas_udf("boolean")
    def good(texts: pd.Series) -> pd.Series:
        feats = [features(shared.value, (t or "").encode()) for t in texts.tolist()]
        return pd.Series(probability(shared.value, np.array(feats).reshape(len(feats), -1)) >= least)

    return docs.where(good(text_col))
