"""Language identification by prediction by partial matching (PPM) over bytes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import limit_batches, map_texts, to_batch

ORDER = 3
#: Training rows of a language, and their bytes, at most; longer texts than LONGEST aren't learned from. Whole rows, drawn by a hash of the id.
SAMPLE_ROWS, SAMPLE_BYTES, LONGEST = 400, 2_000_000, 1 << 18
#: A text is foreign if its best tree needs more than FOREIGN times the bits a byte that QUANTILE of its own language's
#: training texts of SETTLED bytes or more need, and SLACK bits more than that (short texts tell little).
FOREIGN, QUANTILE, SETTLED, SLACK = 1.5, 0.99, 100, 256
UNKNOWN = "und"


@dataclass
class Model:
    """Code lengths under the frozen trees of all languages.

    symbols maps a byte to its symbol: 0 is the padding before a text, the last one any byte
    that training didn't have. rows maps a context of ORDER symbols to its row in bits, which has
    the bits that each language's tree needs for each next symbol. limits are the bits a byte
    from which a text is foreign to its best language.
    """

    langs: list[str]
    symbols: np.ndarray
    rows: np.ndarray
    bits: np.ndarray
    limits: np.ndarray | None = None


def normalised(text: str | None) -> bytes:
    return (text or "").lower().encode()


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def train(samples: dict[str, list[str]]) -> Model:
    """Counts each language's contexts of 0 to ORDER bytes and works out all code lengths.

    Escape method C: a context seen n times with d different next symbols gives a seen symbol
    count / (n + d); the rest, d / (n + d), goes to the unseen ones in proportion to what the
    context without its first byte gives them, those seen being excluded. Below order 0 all
    symbols are alike. Each context's chances sum to 1, and statistics never change while
    scoring, so the code length of a byte is a number looked up by its context.
    """
    langs = sorted(samples)
    texts = {k: [np.frombuffer(normalised(t), np.uint8) for t in samples[k]] for k in langs}
    seen = np.zeros(256, bool)
    for own in texts.values():
        for t in own:
            seen[t] = True
    n = int(seen.sum()) + 2
    symbols = np.full(256, n - 1, np.int32)
    symbols[seen] = np.arange(1, n - 1)
    grams: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for k in langs:
        parts = [np.concatenate([np.zeros(ORDER, np.int64), symbols[t].astype(np.int64)]) for t in texts[k]]
        codes = [((p[:-3] * n + p[1:-2]) * n + p[2:-1]) * n + p[3:] for p in parts]
        grams[k] = np.unique(np.concatenate([*codes, np.empty(0, np.int64)]), return_counts=True)
    long = np.unique(np.concatenate([*(g[0] // n for g in grams.values()), np.empty(0, np.int64)]))
    rows = np.tile(np.arange(n * n, dtype=np.int32), n)  # a context that nobody saw: the row of its last two symbols
    rows[long] = n * n + np.arange(len(long), dtype=np.int32)
    bits = np.empty((n * n + len(long), n, max(1, len(langs))), np.float32)
    for k, lang in enumerate(langs):
        codes, counts = grams[lang]
        p = np.full(n, 1 / n)
        for order in range(ORDER + 1):
            width = n**order
            short, back = np.unique(codes % (width * n), return_inverse=True)
            count = np.bincount(back, counts, len(short))
            context, symbol = short // n, short % n
            if order < ORDER:
                place, size, shorter = context, width, np.arange(width) % max(1, width // n)
            else:
                place, size, shorter = np.searchsorted(long, context), len(long), long % (n * n)
            total, kinds = np.bincount(place, count, size), np.bincount(place, minlength=size)
            p = np.atleast_2d(p)[shorter]
            left = 1 - np.bincount(place, p[place, symbol], size)  # what the shorter context gives to symbols not seen here
            p *= np.where(total > 0, kinds / np.maximum(total + kinds, 1) / np.maximum(left, 1e-12), 1)[:, None]
            p[place, symbol] = count / (total + kinds)[place]
            if order == ORDER - 1:
                bits[: n * n, :, k] = -np.log2(p)
        bits[n * n :, :, k] = -np.log2(p)
    model = Model(langs, symbols, rows, bits, np.full(len(langs), np.inf))
    for k, lang in enumerate(langs):
        own = [normalised(t) for t in samples[lang]]
        own = [t for t in own if len(t) >= SETTLED]
        if own:
            model.limits[k] = FOREIGN * np.quantile(code_lengths(model, own)[:, k] / np.array([len(t) for t in own]), QUANTILE)
    return model


def code_lengths(model: Model, texts: list[bytes], step: int = 1 << 20) -> np.ndarray:
    """The bits that each text needs in each language, whole texts, ``step`` bytes at a time."""
    n = int(model.symbols.max()) + 1
    out = np.zeros((len(texts), len(model.langs)))
    table = model.bits.reshape(-1, model.bits.shape[2])
    lengths = np.array([len(t) for t in texts], np.int64) + ORDER
    pads = np.zeros(ORDER, np.int64)

    def score(parts: list[tuple[int, np.ndarray]]) -> None:
        """parts: of a text's symbols, each after the ORDER symbols before it."""
        s = np.concatenate([p for _, p in parts])
        row = model.rows[(s[:-3] * n + s[1:-2]) * n + s[2:-1]]
        cost = table[row.astype(np.int64) * n + s[3:]]
        starts = np.cumsum([0, *(len(p) for _, p in parts)])
        for (k, p), at in zip(parts, starts, strict=False):
            out[k] += cost[at : at + len(p) - ORDER].sum(axis=0, dtype=np.float64)

    held, size = [], 0
    for k, t in enumerate(texts):
        s = np.concatenate([pads, model.symbols[np.frombuffer(t, np.uint8)]])
        for at in range(0, max(1, lengths[k] - ORDER), step):
            held.append((k, s[at : at + step + ORDER]))
            size += len(held[-1][1])
            if size >= step:
                score(held)
                held, size = [], 0
    if held:
        score(held)
    return out


def sample_by_language(docs: DataFrame, train_on: Column, rows: int = SAMPLE_ROWS, most_bytes: int = SAMPLE_BYTES) -> dict[str, list[str]]:
    """For each language, up to ``rows`` whole texts of the rows that train_on picks, and most_bytes bytes at most.

    Languages are counted first; then a row is drawn by a hash of its id with the chance that
    gives a language 1.3 times ``rows`` or most_bytes, whichever is less. So no language, however
    common, is gathered in one task, and what reaches the driver is bounded by the languages.
    """
    size = F.octet_length("text")
    usable = docs.where(train_on & F.col("lang").isNotNull() & F.col("text").isNotNull() & (size <= LONGEST))
    counts = {r["lang"]: (r["n"], r["bytes"]) for r in usable.groupBy("lang").agg(F.count("*").alias("n"), F.sum(size).alias("bytes")).collect()}
    if not counts:
        return {}
    chance = F.create_map(*(F.lit(x) for k, (n, b) in counts.items() for x in (k, min(1.0, 1.3 * rows / n, 1.3 * most_bytes / max(1, b)))))
    draw = F.pmod(F.xxhash64("doc_id", F.lit("langid")), F.lit(1 << 30)) / float(1 << 30)
    drawn = usable.withColumn("draw", draw).where(F.col("draw") < chance[F.col("lang")]).select("lang", "text", "draw").collect()
    out: dict[str, list[str]] = {}
    taken: dict[str, int] = {}
    for r in sorted(drawn, key=lambda r: (r["draw"], r["text"])):
        own, after = out.setdefault(r["lang"], []), taken.get(r["lang"], 0) + len(r["text"].encode())
        if len(own) < rows and after <= most_bytes:
            own.append(r["text"])
            taken[r["lang"]] = after
    return out


def predict(model: Model, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Each text's language and score (see identify), and whether its best tree codes it like text of its language."""
    named = [bool(model.langs) and has_letter(t) for t in texts]
    pred, score, fits = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
    where = [k for k, x in enumerate(named) if x]
    if where:
        own = [normalised(texts[k]) for k in where]
        bits = code_lengths(model, own)
        best = bits.argmin(axis=1)
        score[where] = 1 / np.exp2(np.maximum(bits.min(axis=1, keepdims=True) - bits, -1000)).sum(axis=1)
        fits[where] = bits.min(axis=1) <= model.limits[best] * np.array([len(t) for t in own]) + SLACK
        for k, b in zip(where, best.tolist(), strict=True):
            pred[k] = model.langs[b]
    return pred, score, fits


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of each row, from its text alone.

    lang_pred is the language whose tree codes the whole text in the fewest bits (ties: the
    first by name), score its share of 2^-bits over all languages. A text that is null or has
    no letter is UNKNOWN with score 0, as is any text if training had no language. Ids may
    repeat or be null; other columns are not read. An empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches):
        for batch in batches:
            pred, score, _ = predict(shared.value, batch.column(1).to_pylist())
            yield to_batch(doc_id=batch.column(0), lang_pred=pa.array(pred, pa.string()), score=score)

    return map_texts(docs, work, "doc_id long, lang_pred string, score double", F.col(id_col).cast("long"), F.col(text_col))


def identified(docs: DataFrame, model: Model, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of docs, as they are, that have a language, a score of ``least`` or more, and aren't foreign to it.

    Null texts, texts without a letter, ties between languages, texts in a language that nobody
    taught and strings of random letters go.
    """
    limit_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def named(texts: pd.Series) -> pd.Series:
        pred, score, fits = predict(shared.value, texts.tolist())
        return pd.Series([p != UNKNOWN for p in pred], dtype=bool) & (score >= least) & fits

    return docs.where(named(text_col))
