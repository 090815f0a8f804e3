"""Order MinHash fingerprints of documents: signatures that are sensitive to edit distance."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import map_texts, shuffle_partitions, to_batch

#: Buckets of ids at most; their bounds and first ids are what reaches the driver.
MOST_BUCKETS = 20_000
#: Bytes of a k-mer, k-mers of a tuple, and tuples (bins) of a fingerprint.
K, TUPLE, BINS = 8, 2, 64
ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]  # fixed: splitmix64's constants


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * ODD[1]
    x = (x ^ (x >> np.uint64(27))) * ODD[2]
    return x ^ (x >> np.uint64(31))


def fingerprint(text: bytes) -> np.ndarray:
    """BINS 16-bit numbers, none of them 0; of an empty text all are 0.

    The k-mers of the UTF-8 text are numbered by occurrence: the second "abcdefgh" is another
    item than the first. A hash of k-mer and number sends an item to a bin. Of a bin, the TUPLE
    items of the smallest hashes are put back in their order in the text, and the bin's number
    is a hash of their k-mers in that order: it stays only if the items and their order stay. A
    bin of fewer items borrows the smallest ones of the bins after it (after the last: of the
    first), so that every tuple has an order to lose, in short texts as well. A text shorter than
    a k-mer is one item, which is all its tuples; an empty one has none.
    """
    if not text:
        return np.zeros(BINS, np.uint16)
    if len(text) < K:
        text += b"\0" * (K - len(text))
    n = len(text) - K + 1
    code = mix(np.ndarray((n,), "<u8", text, strides=(1,)).astype(np.uint64) + ODD[0])
    low = np.uint64(max(20, n.bit_length()))  # bits for the place
    place = np.uint64((1 << int(low)) - 1)
    key = (code & ~place) | np.arange(n, dtype=np.uint64)
    key.sort()
    at = key & place
    kind = key >> low
    first = np.empty(n, bool)
    first[0] = True
    np.not_equal(kind[1:], kind[:-1], out=first[1:])
    index = np.arange(n)
    number = (index - np.maximum.accumulate(np.where(first, index, 0))).astype(np.uint64)
    item = mix(code[at] + number * ODD[0])
    key = (item & ~place) | at
    key.sort()
    at = (key & place).astype(np.int64)
    bins = key >> np.uint64(64 - BINS.bit_length() + 1)
    edges = np.searchsorted(bins, np.arange(BINS + 1, dtype=np.uint64))
    chosen = at[(edges[:-1, None] + np.arange(TUPLE)) % n]
    chosen.sort(axis=1)
    value = np.zeros(BINS, np.uint64)
    for k in range(TUPLE):
        value = mix(value * ODD[0] + code[chosen[:, k]] + ODD[1])
    return np.maximum(value >> np.uint64(48), 1).astype(np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The share of bins with the same number, of those that either text has; 1 if neither has any."""
    used = (a | b) != 0
    return float(np.count_nonzero((a == b) & used)) / max(1, np.count_nonzero(used)) if used.any() else 1.0


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by as many code points from the start of the following one, or all of it."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprint_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint) of each row: 4 hex digits a bin; a null text is empty."""

    def work(batches):
        for batch in batches:
            yield to_batch(doc_id=batch.column(0), fingerprint=[fingerprint((t or "").encode()).astype(">u2").tobytes().hex() for t in batch.column(1).to_pylist()])

    return map_texts(docs, work, "doc_id long, fingerprint string", F.col(id_col).cast("long"), F.col(text_col))


def with_following(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (doc_id, text, bucket, guest), dealt and sorted so that a row's next one follows it.

    Order: descending doc_id (null last), then a hash of the text. Quantiles of the ids cut it
    into buckets, eight for each shuffle partition. A bucket's rows are in one partition, and
    after its last one stands a guest: the first row of the next bucket (after the last bucket:
    of the first), from which no result comes. So each text is shuffled once, and nothing has to
    be put together across partitions.
    """
    spark = docs.sparkSession
    partitions = shuffle_partitions(spark)
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("key"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    count = min(8 * partitions, MOST_BUCKETS)
    quantiles = F.percentile_approx("key", F.array(*(F.lit(k / count) for k in range(1, count))), F.lit(20 * count))
    bounds = np.array(rows.agg(quantiles.alias("q")).first()["q"] or [], np.int64)

    @F.pandas_udf("int")
    def bucket(key: pd.Series) -> pd.Series:
        return pd.Series((len(bounds) - np.searchsorted(bounds, key)).astype(np.int32))

    rows = rows.withColumn("bucket", bucket("key"))
    heads = sorted((r["bucket"], r["head"]) for r in rows.groupBy("bucket").agg(F.max("key").alias("head")).collect())  # one for each bucket
    guests = [(head, heads[k - 1][0]) for k, (_, head) in enumerate(heads)]
    guest = spark.createDataFrame(guests, "key long, bucket int")
    visiting = rows.drop("bucket").join(F.broadcast(guest), "key").select("key", "doc_id", "text", "bucket", F.lit(True).alias("guest"))
    both = rows.withColumn("guest", F.lit(False)).unionByName(visiting)
    return both.repartition(partitions, "bucket").sortWithinPartitions("bucket", "guest", F.desc("key"), F.xxhash64("text"))


def compare_with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each whole text and of its edited text, which borrows from the next document.

    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint (hex), near_edited and
    near_next: likeness to the edited text and to the next document in descending doc_id (after
    the last: the first; a table of one row follows itself). A null text is empty. Rows that
    repeat an id follow each other in the order of a hash of their texts; null ids come last.
    Other columns are not read; an empty table gives an empty result.
    """
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def work(batches):
        held = None
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text, bucket, guest in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                text = text or ""
                if held is not None and held[2] == bucket and not held[3]:
                    own = (doc_id, text, bucket, guest, fingerprint(text.encode()))
                    changed = edited(held[1], text).encode()
                    changed_print = fingerprint(changed)
                    digits = [x.astype(">u2").tobytes().hex() for x in (held[4], changed_print)]
                    out.append((held[0], len(held[1]), hashlib.sha256(changed).hexdigest(), *digits, likeness(held[4], changed_print), likeness(held[4], own[4])))
                    held = own
                elif held is None or held[2] != bucket:
                    held = (doc_id, text, bucket, guest, fingerprint(text.encode()))
            yield pd_batch(out)

    def pd_batch(rows):
        import pyarrow as pa

        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        columns = list(zip(*rows, strict=True)) or [()] * 7
        return to_batch(**{n.split()[0]: pa.array(c, k) for n, c, k in zip(schema.split(", "), columns, kinds, strict=True)})

    return map_texts(with_following(docs, id_col, text_col), work, schema, "doc_id", "text", "bucket", "guest")
