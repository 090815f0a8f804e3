import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm.conftest import odd_rows
from tidemark.llm import bpe, order_minhash, packing
from tidemark.llm.common import cut

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
ENCODERS = {kind: bpe.Encoder(path, kind) for kind, path in (("word", WORD), ("byte", BYTE))}
PIECES = ["the", "ing", "A", "é", "ß", "Σ", "Ω", "한", "日", "1", "9", ".", ",", "'s", "'ll", " ", "  ", "\n", "\t", " ", "　", "́", "\x1c", "\x85", "<|endoftext|>", "<|startoftext|>", "|", "!!"]


def agrees(kind: str, texts: list[str]) -> None:
    own = ENCODERS[kind]
    for text, (ids, decoded) in zip(texts, own.encode_named([t.encode() for t in texts]), strict=True):
        want = own.whole.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want, text[:80]
        assert decoded.decode() == own.whole.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("kind", ["word", "byte"])
@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=40).map("".join))
def test_encoding_of_odd_texts(kind, text):
    agrees(kind, [text])


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=60))
def test_encoding_of_any_text(text):
    text = text.encode("utf-8", "replace").decode()
    agrees("word", [text])
    agrees("byte", [text])


@pytest.mark.parametrize("parts", [list("etaoinshrdlucmfwypvbgkjqxz"), ["the", "ing", "tion", "a", "q"], ["é", "ß", "한", "the"], ["a"], ["x", "!"]])
def test_long_unsplit_runs_by_tree_concatenation(parts):
    rng = random.Random(4)
    agrees("word", ["".join(rng.choice(parts) for _ in range(n)) for n in (1023, 1024, 1025, 3000, 7001)])


def test_joins_agree_at_every_cut(monkeypatch):
    monkeypatch.setattr(bpe, "WINDOW", 2)
    monkeypatch.setattr(bpe, "LEAF", 16)
    own, rng = ENCODERS["word"], random.Random(8)
    for parts in (list("aeinrst"), ["an", "th", "e"]):
        run = "".join(rng.choice(parts) for _ in range(400))
        assert [t[2] for t in own.tree(run)] == own.model.encode(run, add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=60).map("".join))
def test_long_texts_by_tree_concatenation(text):
    with pytest.MonkeyPatch.context() as patch:
        for name, value in (("LONG_TEXT", 1), ("TEXT_LEAF", 7), ("WINDOW", 2)):
            patch.setattr(bpe, name, value)
        agrees("word", [text])


def test_windows_grow_until_both_sides_agree():
    text, asked = b"ab cdefgh ij", []

    def units(spans):
        asked.extend(spans)
        return [[(a + m.start(), a + m.end(), text[a + m.start() : a + m.end()]) for m in bpe.CHUNK.finditer(text[a:b])] for a, b in spans]

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(bpe, "WINDOW", 1)
        got = bpe.concatenated(len(text), 6, units)
    assert [u[2] for u in got] == [b"ab", b"cdefgh", b"ij"] and asked == [(0, 6), (6, 12), (5, 7), (4, 8), (2, 10), (0, 12)]


def test_byte_encoder_without_ranks_agrees():
    own = bpe.Encoder(BYTE, "byte")
    own.ranked = None
    texts = ["a b  c", "x   y ", " é ó\n z", "foo   bar", "日本 語", "", " ", "it's\n\n 5pm"]
    for t, ids in zip(texts, own.encode([t.encode() for t in texts]), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == own.whole.encode(t, add_special_tokens=False).ids


def test_encoding_digests_of_odd_rows(odd, empty):
    own, want = ENCODERS["word"].whole, Counter()
    for k, t in odd_rows():
        ids = own.encode(t or "", add_special_tokens=False).ids
        want[str(k), len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(own.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert Counter((str(r[0]), *r[1:]) for r in bpe.encoding_digests(odd, WORD).collect()) == want
    assert bpe.encoding_digests(empty, WORD).count() == 0
    both = bpe.encode_and_decode(odd, WORD).collect()
    assert sum(len(r["ids"]) // 4 for r in both) == sum(n * c for (_, n, *_), c in want.items())


def test_forgetting_changes_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    own = bpe.Encoder(WORD)
    texts = [t or "" for _, t in odd_rows()]
    assert own.encode([t.encode() for t in texts]) == ENCODERS["word"].encode([t.encode() for t in texts])


def slow_minhash(text: bytes) -> list:
    """The sketch by definition: for each bin the TUPLE items of smallest hash, k-mers in text order."""
    k = order_minhash.K
    if not text:
        return [None] * order_minhash.BINS
    text = text.ljust(k, b"\0")
    seen: Counter = Counter()
    bins: dict[int, list] = {}
    mix = lambda x: int(order_minhash.mix(np.array([x % 2**64], np.uint64))[0])
    for at in range(len(text) - k + 1):
        mer = text[at : at + k]
        code = mix(int.from_bytes(mer, "little") + int(order_minhash.ODD[0]))
        item = mix(code + seen[mer] * int(order_minhash.ODD[0]))
        seen[mer] += 1
        bins.setdefault(item >> (64 - 6), []).append((item, at, mer))
    sketch = []
    for b in range(order_minhash.BINS):
        after = [x for d in range(order_minhash.BINS) for x in sorted(bins.get((b + d) % order_minhash.BINS, []))]  # its own, then those of the bins after it
        sketch.append(tuple(m for _, m in sorted((at, mer) for _, at, mer in (after * 2)[: order_minhash.TUPLE])))
    return sketch


@pytest.mark.parametrize("seed", range(4))
def test_fingerprints_are_alike_where_sketches_are(seed):
    rng = random.Random(seed)
    say = lambda n: "".join(rng.choice("abc ") for _ in range(n)).encode()
    base = say(400)
    for other in (base, base[:200] + say(200), base[200:] + base[:200], say(400), base[:150], b"ab", b""):
        a, b = slow_minhash(base), slow_minhash(other)
        fa, fb = order_minhash.fingerprint(base), order_minhash.fingerprint(other)
        assert [x is None for x in a] == (fa == 0).tolist() and [x is None for x in b] == (fb == 0).tolist()
        assert [x == y for x, y in zip(a, b, strict=True)] == (fa == fb).tolist()


def test_order_and_number_matter():
    say = lambda *w: " ".join(w).encode()
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefgh") for _ in range(8)) for _ in range(60)]
    near = lambda a, b: order_minhash.likeness(order_minhash.fingerprint(a), order_minhash.fingerprint(b))
    assert near(say(*words), say(*words)) == 1.0
    assert near(say(*words), say(*words[30:], *words[:30])) < 0.95  # the same k-mers but for the seam
    assert near(say(*words), say(*words, *words)) < 0.8
    changed = [*words[:29], "zzzzzzzz", *words[30:]]
    assert 0.5 < near(say(*words), say(*changed)) < 1
    assert near(b"", b"") == 1.0 and near(b"", b"x") == 0.0


def test_compare_with_edits_against_the_definition(odd, empty):
    order = sorted(odd_rows(), key=lambda r: -(r[0] if r[0] is not None else -(2**63)))
    tied = {k for k, n in Counter(k for k, _ in order).items() if n > 1}
    got = {}
    for r in order_minhash.compare_with_edits(odd).collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert sum(map(len, got.values())) == len(order)
    for at, (k, t) in enumerate(order):
        following = order[(at + 1) % len(order)]
        if k in tied or following[0] in tied:
            continue
        (r,) = got[k]
        t, f = t or "", following[1] or ""
        half = len(t) // 2
        edit = t[: len(t) - half] + f[:half]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edit.encode()).hexdigest()
        prints = [order_minhash.fingerprint(x.encode()) for x in (t, edit, f)]
        assert r["fingerprint"] == prints[0].astype(">u2").tobytes().hex() and r["edited_fingerprint"] == prints[1].astype(">u2").tobytes().hex()
        assert r["near_edited"] == order_minhash.likeness(prints[0], prints[1]) and r["near_next"] == order_minhash.likeness(prints[0], prints[2])
    assert got[4][0]["fingerprint"] == got[6][0]["fingerprint"]
    assert order_minhash.compare_with_edits(empty).count() == 0
    alone = order_minhash.compare_with_edits(odd.where("doc_id = 4")).collect()
    assert len(alone) == 1 and alone[0]["near_next"] == 1.0


def test_one_document_in_many_partitions(spark):
    docs = spark.range(300).select((F.col("id") * 7).alias("doc_id"), F.concat(F.lit("text number "), F.col("id").cast("string")).alias("text")).repartition(9)
    rows = {r["doc_id"]: r for r in order_minhash.compare_with_edits(docs).collect()}
    assert len(rows) == 300
    for k in range(300):
        t, f = f"text number {k}", f"text number {(k - 1) % 300}"
        half = len(t) // 2
        assert rows[7 * k]["edited_sha256"] == hashlib.sha256((t[: len(t) - half] + f[:half]).encode()).hexdigest()


def slow_sum_of_squares(lengths, capacity):
    gaps = []
    for s in lengths:
        def cost(after):
            c = Counter(g for g in after if g)
            return sum(n * n for n in c.values())

        options = [(cost([*gaps, capacity - s]), 1, capacity)]
        options += [(cost([*gaps[:k], g - s, *gaps[k + 1 :]]), 0, g) for k, g in enumerate(gaps) if g >= s]
        best = min(options)
        if best[1]:
            gaps.append(capacity - s)
        else:
            gaps[gaps.index(best[2])] -= s
    return Counter(gaps)


@pytest.mark.parametrize("seed", range(5))
def test_sum_of_squares_by_definition(seed):
    rng = random.Random(seed)
    lengths = np.array([rng.randrange(1, 21) for _ in range(120)])
    bins, offsets, gaps = packing.sum_of_squares(lengths, 20)
    assert Counter(gaps.tolist()) == slow_sum_of_squares(lengths.tolist(), 20)
    for b in range(len(gaps)):
        own = np.flatnonzero(bins == b)
        assert offsets[own].tolist() == np.append(0, np.cumsum(lengths[own])[:-1]).tolist() and lengths[own].sum() == 20 - gaps[b]


def check_packing(rows, capacity):
    by: dict = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append(r)
    for own in by.values():
        own.sort(key=lambda r: r["offset"])
        at = 0
        for r in own:
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
    return len(by)


def test_packing_of_odd_rows(odd, empty):
    rows = packing.pack_documents(odd, BYTE, 64, end=2).collect()
    want = Counter()
    for k, t in odd_rows():
        ids = [*ENCODERS["byte"].whole.encode(t or "", add_special_tokens=False).ids, 2]
        first = len(ids) % 64 or min(64, len(ids))
        at, piece = 0, 0
        while at < len(ids):
            n = first if at == 0 else 64
            want[str(k), piece, at, n, zlib.crc32(np.array(ids[at : at + n], "<u4").tobytes())] += 1
            at, piece = at + n, piece + 1
    assert Counter((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    bound = -(-sum(r["length"] for r in rows) // 64)
    assert check_packing(rows, 64) <= bound + 3
    assert packing.pack_documents(empty, BYTE, 64, end=2).count() == 0


def test_rounds_pack_nearly_as_well_as_one_group(spark):
    items = spark.range(6000).select(F.col("id").alias("doc_id"), F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), (F.pmod(F.xxhash64("id"), F.lit(50)) + 1).alias("length"), F.lit(0).cast("long").alias("ids_crc32"))
    total = items.agg(F.sum("length")).first()[0]
    used = [check_packing(packing.pack(items, 100, group).collect(), 100) for group in (500, 10_000)]
    assert used[0] <= 1.02 * total / 100 and used[1] <= 1.02 * total / 100


def test_rounds_end_when_pieces_over_half_a_bin_stay_loose(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(packing, "cut", lambda df: rounds.append(df) or cut(df) if len(rounds) < 6 else pytest.fail("rounds go on"))
    items = spark.range(100_000).select(F.col("id").alias("doc_id"), F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), F.lit(700).cast("long").alias("length"), F.lit(0).cast("long").alias("ids_crc32"))
    rows = packing.pack(items, 1024, 5000)
    assert rows.count() == rows.select("sequence_id").distinct().count() == 100_000 and rows.select("doc_id").distinct().count() == 100_000
    assert rows.agg(F.max("offset")).first()[0] == 0


def test_rows_without_an_id_spread_over_groups(spark):
    items = spark.range(6000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), (F.pmod(F.xxhash64("id"), F.lit(50)) + 1).alias("length"), F.col("id").alias("ids_crc32"))
    rows = packing.pack(items, 100, 500)
    assert rows.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert rows.select("ids_crc32").distinct().count() == 6000 and check_packing(rows.collect(), 100) <= 1.02 * items.agg(F.sum("length")).first()[0] / 100
    groups = rows.where("sequence_id < (1L << 56)").groupBy(F.expr("sequence_id >> 24")).count().agg(F.max("count"), F.count("*")).first()
    assert groups[0] < 700 and groups[1] == 12
