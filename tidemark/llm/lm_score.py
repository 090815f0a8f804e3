"""Language-model scores of whole documents: counts of all words, and a recurrent net over the frequent ones."""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass, field
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import gru
from tidemark.llm.common import LOWER, UPPER, as_bytes, cut, map_texts, shuffle_partitions, to_batch

TO_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())
#: Words of the net with the end, and words whose counts every task gets, at most.
NET_WORDS, HEAD_WORDS = 1024, 200_000
#: Tail classes of the words that the net doesn't tell apart, and the bytes at a word's end that decide its class.
TAILS, ENDING = 64, 3
#: Rounds of training; each training document is in one of them.
ROUNDS = 2
#: Words that a task counts before it hands them on, and weights in a row when nets are averaged.
COUNTED, BLOCK = 250_000, 1024


def words_of(text: bytes) -> list[bytes]:
    return text.translate(TO_LOWER).split()


def tail_of(word: bytes) -> int:
    return zlib.crc32(word[-ENDING:]) % TAILS


def count_words(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n) over all whole texts. A task adds up its own before the shuffle, COUNTED words at a time."""

    def work(batches):
        counts: Counter = Counter()
        for batch in batches:
            for text in as_bytes(batch.column(0)):
                counts.update(words_of(text))
                if len(counts) > COUNTED:
                    yield out(counts)
                    counts = Counter()
        yield out(counts)

    def out(counts):
        return to_batch(word=pa.array(list(counts), pa.binary()), n=pa.array(list(counts.values()), pa.int64()))

    return map_texts(docs, work, "word binary, n long", F.col(text_col)).groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """What all tasks know: the most frequent words with their counts, falling, and the corpus's totals.

    Words are those with a count of ``least`` or more, so that the others are told apart by their
    count. The end token is among the net's ids. tokens and kinds count it, too. The net has an
    id for each of the NET_WORDS - 1 most frequent words; any other word has the id of its tail
    class, which its last letters decide, so words of like form and language share one.
    tail_tokens and tail_kinds are what each tail class has of such words.
    """

    words: list[bytes]
    counts: np.ndarray
    least: int
    ends: int
    tokens: int
    kinds: int
    tail_tokens: np.ndarray
    tail_kinds: np.ndarray
    head: pa.Array | None = field(default=None, repr=False)

    def __post_init__(self):
        inside = min(len(self.words), NET_WORDS - 1)
        own = np.append(self.counts[:inside], self.ends)
        order = np.argsort(-own, kind="stable")
        rank = np.empty(len(own), np.int64)
        rank[order] = np.arange(len(own))
        classes, members = gru.shape_of(len(own))
        self.end, self.net_counts, self.first_tail = int(rank[-1]), own[order], classes * members
        tails = np.array([tail_of(w) for w in self.words], np.int64)
        self.tail_tokens = self.tail_tokens - np.bincount(tails[:inside], self.counts[:inside], TAILS).astype(np.int64)
        self.tail_kinds = self.tail_kinds - np.bincount(tails[:inside], minlength=TAILS)
        #: The net's id of each head word.
        self.ids = np.append(rank[:-1], self.first_tail + tails[inside:])

    def look_up(self, words: list[bytes]) -> np.ndarray:
        """Each word's place among the head words, or -1."""
        if self.head is None:
            self.head = pa.array(self.words, pa.binary())
        return pc.fill_null(pc.index_in(pa.array(words, pa.binary()), value_set=self.head), -1).to_numpy()

    def net_ids(self, words: list[bytes], places: np.ndarray) -> np.ndarray:
        """The net's ids of words, of which look_up gave the places."""
        ids, inside = np.empty(len(words), np.int32), places >= 0
        ids[inside] = self.ids[places[inside]]
        lacking = np.flatnonzero(~inside)
        ids[lacking] = [self.first_tail + tail_of(words[k]) for k in lacking.tolist()]
        return ids

    def with_ends(self, ids: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
        """The ids of texts of so many words each, which lie one after the other, with the end after each."""
        ends = np.cumsum(sizes)
        ids = np.insert(ids, ends, self.end)
        return [ids[a:b] for a, b in pairwise([0, *(ends + np.arange(1, len(ends) + 1)).tolist()])]


def in_a_row(words: list[list[bytes]]) -> tuple[list[bytes], np.ndarray]:
    """All texts' words, one after the other, and how many each has."""
    return list(chain.from_iterable(words)), np.array([len(w) for w in words], np.int64)


def vocabulary(counts: DataFrame, ends: int, most: int = HEAD_WORDS) -> Vocabulary:
    """Head words: all with counts from the least one on that leaves ``most`` words at most.

    Counts are tabulated by eighths of octaves (a few hundred rows); the step in which ``most``
    is passed is tabulated again by count, so head words end at a count and not at a step.
    """
    step = F.floor(F.log2("n") * 8)
    sizes = lambda rows, key: sorted(((r["key"], r["kinds"], r["least"]) for r in rows.groupBy(key.alias("key")).agg(F.count("*").alias("kinds"), F.min("n").alias("least")).collect()), reverse=True)
    taken, least = 0, 2**62
    for key, n, low in sizes(counts, step):
        if taken + n > most:
            for _, n, low in sizes(counts.where(step == key), F.floor("n" if key < 100 else F.col("n") / 2 ** (key // 8 - 10))):
                if taken + n > most:
                    break
                taken, least = taken + n, low
            break
        taken, least = taken + n, low
    head = sorted(((-r["n"], bytes(r["word"])) for r in counts.where(F.col("n") >= least).collect())) if taken else []
    tails = np.zeros((2, TAILS), np.int64)
    tail = F.crc32(F.substring("word", -ENDING, ENDING)) % TAILS
    for r in counts.groupBy(tail.alias("tail")).agg(F.sum("n").alias("tokens"), F.count("*").alias("kinds")).collect():
        tails[:, r["tail"]] = r["tokens"], r["kinds"]
    tokens, kinds = int(tails[0].sum()) + ends, int(tails[1].sum()) + (ends > 0)
    return Vocabulary([w for _, w in head], np.array([-n for n, _ in head], np.int64), least, ends, tokens, kinds, *tails)


def train(docs: DataFrame, vocab: Vocabulary, text_col: str = "text", id_col: str = "doc_id") -> gru.Gru:
    """The net after one pass over all documents, whole texts, in ROUNDS rounds.

    A hash of id and text gives each document its round, so the rounds are disjoint and together
    have every document, whatever the corpus's size. In a round every partition starts from the
    same net and trains on its own texts; the nets are averaged, weighted by tokens, block by
    block. Documents are dealt over partitions by id and row number, so those that share an id
    (or have none) spread like any others.
    """
    net = gru.start(vocab.net_counts, vocab.tail_tokens)
    if not vocab.tokens:
        return net
    spark = docs.sparkSession
    parts = shuffle_partitions(spark)
    rounds = F.pmod(F.xxhash64(F.col(id_col), F.col(text_col), F.lit("gru")), F.lit(ROUNDS))
    known = spark.sparkContext.broadcast(vocab)
    for turn in range(ROUNDS):
        drawn = docs.where(rounds == turn).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("salt"))
        dealt = drawn.repartition(parts, F.xxhash64("id", "salt"))
        shared = spark.sparkContext.broadcast(net)

        def work(batches, known=known, shared=shared):
            vocab = known.value
            trainer, tokens = gru.Trainer(shared.value), 0
            for batch in batches:
                words, sizes = in_a_row([words_of(t) for t in as_bytes(batch.column(0))])
                texts = vocab.with_ends(vocab.net_ids(words, vocab.look_up(words)), sizes)
                trainer.fit(texts, vocab.end)
                tokens += sum(map(len, texts))
            if tokens:
                weights = trainer.net.vector().astype(np.float32)
                blocks = [weights[k : k + BLOCK] for k in range(0, len(weights), BLOCK)]
                yield to_batch(block=np.arange(len(blocks), dtype=np.int32), tokens=np.full(len(blocks), tokens, np.int64), weights=[b.tobytes() for b in blocks])

        nets = map_texts(dealt, work, "block int, tokens long, weights binary", F.col("text"))
        mean = nets.groupBy("block").applyInPandas(average, "block int, weights binary").collect()
        if mean:
            net = gru.start(vocab.net_counts, vocab.tail_tokens).load(np.concatenate([np.frombuffer(r["weights"], np.float32) for r in sorted(mean, key=lambda r: r["block"])]))
    return net


def average(rows):
    """One block of all nets, averaged by their tokens."""
    import pandas as pd

    each = np.stack([np.frombuffer(w, np.float32) for w in rows["weights"]]).astype(float)
    mean = np.average(each, axis=0, weights=rows["tokens"]).astype(np.float32)
    return pd.DataFrame({"block": rows["block"].iloc[:1], "weights": [mean.tobytes()]})


def score(docs: DataFrame, learn_from: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of every row.

    Words are what ASCII white space leaves, A-Z lower-cased; an end token follows. A null text
    is empty: the end alone. Counts and net learn from the rows that learn_from picks; null there
    picks none. base_score is the log10 likelihood under add-one-half unigram counts. score is
    the net's: log10 of P(class | words before) P(word | class, words before) for each of its
    words. A rarer word's class is a tail class, in which it has the probability
    (c + 1/2) / (the class's tokens + (its kinds + 1) / 2), so that rare and unknown words count
    as well. Ids may repeat or be null; other columns are not read; an empty table gives an empty result.

    A document's score needs counts of words that are too many for one task. The HEAD_WORDS most
    frequent go to all tasks; what a document has besides is joined by word, after which sums
    are added up for each document.
    """
    taught = docs.where(F.coalesce(learn_from, F.lit(False)))
    counts = cut(count_words(taught, text_col))
    vocab = vocabulary(counts, taught.count())
    net = train(taught, vocab, text_col, id_col)
    known, shared = docs.sparkSession.sparkContext.broadcast(vocab), docs.sparkSession.sparkContext.broadcast(net)
    schema = "row long, doc_id long, n_tokens long, n_known long, head double, rare_head double, net double, tail array<binary>"

    def work(batches):
        vocab, net = known.value, shared.value
        log_count = np.append(np.log10(vocab.counts + 0.5), 0)  # nothing for the place -1
        log_end = np.log10(vocab.ends + 0.5)
        log_tail = np.log10(vocab.tail_tokens + 0.5 * (vocab.tail_kinds + 1))
        for batch in batches:
            words, sizes = in_a_row([words_of(t) for t in as_bytes(batch.column(2))])
            places = vocab.look_up(words)
            ids, own, shares = vocab.net_ids(words, places), np.repeat(np.arange(len(sizes)), sizes), log_count[places]
            rare, lacking = ids >= vocab.first_tail, np.flatnonzero(places < 0)
            n_lacking = np.bincount(own[lacking], minlength=len(sizes))
            tails = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n_lacking)), pa.int32()), pa.array([words[k] for k in lacking.tolist()], pa.binary()))
            yield to_batch(
                row=batch.column(0), doc_id=batch.column(1), n_tokens=sizes + 1, n_known=sizes - n_lacking + int(vocab.ends > 0), head=np.bincount(own, shares, len(sizes)) + log_end,
                rare_head=np.bincount(own[rare], shares[rare] - log_tail[ids[rare] - vocab.first_tail], len(sizes)), net=gru.score(net, vocab.with_ends(ids, sizes), vocab.end), tail=tails,
            )

    rows = cut(map_texts(docs.withColumn("__row", F.monotonically_increasing_id()), work, schema, "__row", F.col(id_col).cast("long"), F.col(text_col)))
    tails = rows.select("row", F.explode("tail").alias("word")).join(counts.where(F.col("n") < vocab.least), "word", "left")
    c = F.coalesce(F.col("n"), F.lit(0))
    sums = tails.groupBy("row").agg(F.sum(F.log10(c + 0.5)).alias("tail_sum"), F.count_if(c > 0).alias("tail_known"))
    tail_sum, tail_known = F.coalesce("tail_sum", F.lit(0.0)), F.coalesce("tail_known", F.lit(0))
    total = float(np.log10(vocab.tokens + 0.5 * (vocab.kinds + 1)))
    return rows.join(sums, "row", "left").select(
        "doc_id",
        "n_tokens",
        (F.col("n_known") + tail_known).alias("n_known"),
        F.lit(vocab.tokens).cast("long").alias("train_tokens"),
        (F.col("head") + tail_sum - F.col("n_tokens") * total).alias("base_score"),
        (F.col("net") + F.col("rare_head") + tail_sum).alias("score"),
    )
