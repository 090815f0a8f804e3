import math
import random
import zlib
from collections import Counter, defaultdict
from dataclasses import fields

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import WORDS, odd_rows
from tidemark.llm import gru, langid, lm_score, quality

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SAMPLES = {"aa": ["the cat sat on the mat", "that is the thing", "The Other"], "bb": ["der hund und die katze", "ich bin über den fluß", "und"]}


def slow_bits(text: str, samples: list[str], n: int) -> float:
    counts = [defaultdict(Counter) for _ in range(langid.ORDER + 1)]
    for s in samples:
        q = [-1] * langid.ORDER + list(langid.normalised(s))
        for i in range(langid.ORDER, len(q)):
            for o in range(langid.ORDER + 1):
                counts[o][tuple(q[i - o : i])][q[i]] += 1
    every = {b for s in samples for b in langid.normalised(s)}

    def chance(symbol, context):
        """P(symbol | context); symbol None is any that training didn't have, context None the one below the empty one."""
        if context is None:
            return 1 / n
        shorter = context[1:] if context else None
        seen = counts[len(context)].get(context)
        if not seen:
            return chance(symbol, shorter)
        size, kinds = sum(seen.values()), len(seen)
        if symbol in seen:
            return seen[symbol] / (size + kinds)
        return kinds / (size + kinds) * chance(symbol, shorter) / (1 - sum(chance(x, shorter) for x in seen))

    q = [-1] * langid.ORDER + list(langid.normalised(text))
    return -sum(math.log2(chance(q[i] if q[i] in every else None, tuple(q[i - langid.ORDER : i]))) for i in range(langid.ORDER, len(q)))


@pytest.mark.parametrize("text", ["the mat", "Über die katze", "zzz", "日本", "t", "the cat sat on the mat, that is " * 20])
def test_code_lengths_against_trees(text):
    model = langid.train(SAMPLES)
    n = int(model.symbols.max()) + 1
    got = langid.code_lengths(model, [langid.normalised(text), b"the"], step=7)[0]
    assert got == pytest.approx([slow_bits(text, SAMPLES[k], n) for k in model.langs], rel=1e-5)


def test_distributions_sum_to_one():
    model = langid.train(SAMPLES)
    assert np.exp2(-model.bits.astype(float)).sum(axis=1) == pytest.approx(1, abs=1e-4)


def test_identify_odd_rows(odd, empty):
    model = langid.train(SAMPLES)
    rows = {(str(r["doc_id"]), r["lang_pred"], round(r["score"], 6)) for r in langid.identify(odd, model).collect()}
    assert len([r for r in rows if r[1] == "und"]) == 5  # 0, 1, 2, 3 and the null id's null text
    assert all(0 <= s <= 1 for *_, s in rows) and ("3", "und", 0.0) in rows
    assert langid.identify(empty, model).count() == 0
    assert {r["lang_pred"] for r in langid.identify(odd, langid.train({})).collect()} == {"und"}
    kept = langid.identified(odd, model)
    assert kept.columns == odd.columns and kept.where("text IS NULL").count() == 0


def test_held_out_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    model = langid.train(langid.sample_by_language(docs, fold != 0))
    found = langid.identify(docs, model).join(docs.where(fold == 0).select("doc_id", "lang"), "doc_id").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in found) >= 0.97 * len(found)
    assert langid.sample_by_language(docs.limit(0), F.lit(True)) == {}


def test_foreign_texts_and_random_letters_go(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("length(text) > 200")
    model = langid.train(langid.sample_by_language(docs.where("lang <> 'fr'"), F.lit(True)))
    rng = random.Random(2)
    noise = spark.createDataFrame([(k, "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(300))) for k in range(50)], "doc_id long, text string")
    assert langid.identified(noise, model).count() == 0
    french = docs.where("lang = 'fr'")
    assert langid.identified(french, model).count() <= 0.05 * french.count()
    own = docs.where("lang <> 'fr'")
    assert langid.identified(own, model).count() >= 0.995 * own.count()


def test_samples_are_bounded(spark):
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("ab").alias("text"), F.lit("x").alias("lang"))
    assert len(langid.sample_by_language(docs, F.lit(True), rows=50)["x"]) == 50
    long = docs.withColumn("text", F.repeat("text", 1000))
    assert 15 <= len(langid.sample_by_language(long, F.lit(True), most_bytes=40_000)["x"]) <= 20
    texts, _ = quality.labelled_sample(docs, docs.select("doc_id", F.lit(1).alias("quality")), F.lit(True), rows=50)
    assert len(texts) == 50


def odd_net(seed: int) -> quality.Net:
    rng = np.random.default_rng(seed)
    f = quality.FILTERS * quality.MEMBERS
    return quality.Net(rng.normal(0, 0.5, (quality.WIDTH, 256, f)).astype(np.float32), rng.normal(0, 0.1, f).astype(np.float32), rng.normal(0, 0.1, 2 * f), 0.1)


def test_network_gradient():
    rng = np.random.default_rng(3)
    net = quality.train_member([], [], 0)
    net.filters = rng.normal(0, 0.5, net.filters.shape)
    net.bias = rng.normal(0, 0.1, net.bias.shape)
    net.out = rng.normal(0, 0.5, net.out.shape)
    b = quality.bytes_of(bytes(rng.integers(97, 104, 900).astype(np.uint8)))
    grads = [np.zeros_like(net.filters, dtype=np.float32), np.zeros_like(net.bias), np.zeros_like(net.out), 0.0]
    quality._backward(net, b, 1.0, 1.0, grads)

    def loss():
        r = quality.responses(net, b)
        return -math.log(quality.probability(net, quality.pool(np.maximum.reduceat(r, np.arange(0, len(r), quality.BLOCK)))))

    for k in range(40):
        where = (int(rng.integers(quality.WIDTH)), int(rng.integers(97, 104)), int(rng.integers(quality.FILTERS)))
        old = net.filters[where]
        net.filters[where] = old + 1e-5
        up = loss()
        net.filters[where] = old - 1e-5
        down = loss()
        net.filters[where] = old
        assert (up - down) / 2e-5 == pytest.approx(grads[0][where], abs=1e-4)


def test_features_are_the_same_in_any_span(monkeypatch):
    net = odd_net(1)
    text = " ".join(random.Random(1).choice(WORDS) for _ in range(9000)).encode()
    whole = quality.features(net, text)
    monkeypatch.setattr(quality, "SPAN", 4096)
    assert quality.features(net, text) == pytest.approx(whole, rel=1e-5)


def slow_quality(net: quality.Net, text: bytes) -> float:
    """The probability by definition: each filter at each place, peaks of blocks, of chunks of blocks, then the linear layer."""
    b = text + b"\0" * max(0, 69 - len(text))
    f = net.filters.shape[2]
    at = [[max(0.0, float(net.bias[c]) + sum(float(net.filters[k, b[p + k], c]) for k in range(5))) for c in range(f)] for p in range(len(b) - 4)]
    blocks = [[max(col) for col in zip(*at[k : k + 64], strict=True)] for k in range(0, len(at), 64)]
    chunks, k = [], 0
    while not chunks or k < len(blocks) - 1:  # a chunk begins at every seventh block that isn't the last
        chunks.append([max(col) for col in zip(*blocks[k : k + 8], strict=True)])
        k += 7
    feats = [sum(col) / len(chunks) for col in zip(*chunks, strict=True)] + [max(col) for col in zip(*chunks, strict=True)]
    return 1 / (1 + math.exp(-sum(x * float(w) for x, w in zip(feats, net.out, strict=True)) - net.out_bias))


def test_scores_of_the_network_against_a_plain_loop(spark):
    rng = random.Random(5)
    say = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    texts = [None, "", "a", say(9), say(10), "x" * 68, "x" * 69, *(say(rng.randrange(20, 300)) for _ in range(12))]
    net = odd_net(2)
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in quality.score(rows, net).collect()}
    assert all(got[k] == pytest.approx(slow_quality(net, (t or "").encode()), rel=1e-4) for k, t in enumerate(texts))


def test_members_join_to_the_mean_of_their_logits(spark):
    texts, labels = [say.encode() for say in ("good words here " * 20, "zzz qqq zzz " * 20)] * 20, [1, 0] * 20
    nets = [quality.train_member(texts, labels, s) for s in (7, 8)]
    joined = quality.join_members(nets)
    logit = lambda net, t: math.log((p := float(quality.probability(net, quality.features(net, t)))) / (1 - p))
    for t in (texts[0], b"good zzz", b""):
        assert logit(joined, t) == pytest.approx(sum(logit(n, t) for n in nets) / 2, rel=1e-4)
    assert quality.probability(joined, quality.features(joined, texts[0])) > 0.9 > 0.1 > quality.probability(joined, quality.features(joined, texts[1]))


def test_quality_on_held_out_rows(spark, odd, empty):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    net = quality.train(*quality.labelled_sample(docs, labels, fold != 2))
    found = quality.score(docs.where(fold == 2), net).join(labels, "doc_id").collect()
    assert sum((r["score"] >= 0.7) == (r["quality"] == 1) for r in found) >= 0.95 * len(found)
    rows = quality.score(odd, net).collect()
    assert len(rows) == len(odd_rows()) and all(0 <= r["score"] <= 1 for r in rows)
    blank = {round(r["score"], 9) for r in rows if r["doc_id"] in (0, 1)}
    assert len(blank) == 1
    assert quality.score(empty, net).count() == 0 and quality.of_quality(odd, net).columns == odd.columns


TAILS = np.array([7, 0, 5])


def perturbed(words: int, seed: int = 0) -> gru.Gru:
    net = gru.start(np.arange(words, 0, -1).astype(float), TAILS)
    v = net.vector()
    return net.load(v + np.random.default_rng(seed).normal(0, 0.3, len(v)))


@pytest.mark.parametrize("words", [1, 2, 5, 33, 40, 1024])
def test_net_is_a_distribution(words):
    net = perturbed(words)
    used, members = gru.shape_of(words)
    h = np.random.default_rng(1).normal(0, 1, (1, gru.WIDTH)).astype(np.float32)
    assert sum(math.exp(gru.log_likelihood(net, h, np.array([k]))[0][0]) for k in range(used * members + len(TAILS))) == pytest.approx(1, abs=1e-5)


def test_net_gradient():
    net = perturbed(40)
    v = net.vector().copy()
    texts = [np.random.default_rng(k).integers(0, 43, 6) for k in range(3)]
    trainer = gru.Trainer(net)
    given = np.stack([np.append(0, t[:-1]) for t in texts]).T
    target = np.stack(texts).T
    given[3], fresh = 0, np.zeros_like(target, bool)
    fresh[3] = True  # two texts of three tokens in each lane
    trainer.step(given, np.zeros((3, gru.WIDTH), np.float32), target, np.ones_like(target, bool), fresh)
    texts = [t[k : k + 3] for t in texts for k in (0, 3)]
    g = trainer.m * 10 * target.size

    def loss(x):
        net.load(x)
        return -sum(gru.log_likelihood(net, gru.run(net, np.append(0, t[:-1])[:, None], np.zeros((1, gru.WIDTH), np.float32))[0][:, 0], t)[0].sum() for t in texts)

    for i in np.random.default_rng(5).choice(len(v), 30, replace=False):
        e = np.zeros(len(v))
        e[i] = 1e-2
        assert (loss(v + e) - loss(v - e)) / 2e-2 == pytest.approx(g[i], abs=0.02 * max(1, abs(g[i])))


def test_training_leaves_the_shared_net_as_it_was():
    net, texts = perturbed(40), [np.append(np.random.default_rng(k).integers(0, 43, 50), 3) for k in range(4)]
    before, trained = net.vector(), []
    for _ in range(2):  # as two tasks of one worker that share a broadcast net
        trainer = gru.Trainer(net)
        trainer.fit(texts, 3)
        trained.append(trainer.net.vector())
    assert np.array_equal(net.vector(), before) and np.array_equal(*trained) and not np.array_equal(trained[0], before)


def test_a_window_takes_two_blocks_of_exponentials_however_many_classes(monkeypatch):
    net, calls = perturbed(1024), []
    targets = np.random.default_rng(2).integers(0, 1000, 300)
    states = np.random.default_rng(3).uniform(-1, 1, (300, gru.WIDTH)).astype(np.float32)
    monkeypatch.setattr(gru.np, "exp", lambda *a, own=np.exp, **k: calls.append(1) or own(*a, **k))
    gru.log_likelihood(net, states, targets)
    assert len(calls) == 2


@pytest.mark.parametrize("scale", [1, 300])
def test_chances_of_large_weights_are_finite(scale):
    net = perturbed(40)
    net.by_class *= scale
    net.by_word *= scale
    states = np.random.default_rng(5).uniform(-1, 1, (50, gru.WIDTH)).astype(np.float32)
    targets = np.random.default_rng(6).integers(0, 40, 50)
    used, members = gru.shape_of(40)

    def share(x, k):
        return x[k] - x.max() - np.log(np.exp(x - x.max()).sum())

    want = [share(h @ net.by_class.astype(float) + net.class_bias, t // members) + share(h @ net.by_word[t // members].astype(float) + net.word_bias[t // members], t % members) for h, t in zip(states.astype(float), targets, strict=True)]
    assert gru.log_likelihood(net, states, targets)[0] == pytest.approx(want, rel=1e-4, abs=1e-4)


def test_state_is_carried_across_windows_and_lanes(monkeypatch):
    net = perturbed(40)
    texts = [np.append(np.random.default_rng(k).integers(0, 43, n - 1), 3) for k, n in enumerate((300, 1, 64, 65, 7, 300))]
    plain = [gru.log_likelihood(net, gru.run(net, np.append(3, t[:-1])[:, None], np.zeros((1, gru.WIDTH), np.float32))[0][:, 0], t)[0].sum() / math.log(10) for t in texts]
    assert gru.score(net, texts, 3) == pytest.approx(plain, rel=1e-5)
    monkeypatch.setattr(gru, "SCORE_WINDOW", 5)
    monkeypatch.setattr(gru, "LANES_SCORE", 2)
    monkeypatch.setattr(gru, "LEAST_LANES", 1)
    assert gru.score(net, texts, 3) == pytest.approx(plain, rel=1e-5)
    assert len(gru.score(net, [], 3)) == 0


@pytest.mark.parametrize("head", [200_000, 3, 0])
def test_base_scores_against_the_definition(odd, monkeypatch, head):
    monkeypatch.setattr(lm_score, "NET_WORDS", 4)
    monkeypatch.setattr(lm_score.vocabulary, "__defaults__", (head,))
    rows = odd_rows()
    learn = lambda k: zlib.crc32(str(k).encode()) % 5 != 1 if k is not None else False
    split = lambda t: (t or "").translate(LOWER).encode().split()
    counts, ends = Counter(), 0
    for k, t in rows:
        if learn(k):
            counts.update(split(t))
            ends += 1
    n, v = sum(counts.values()) + ends, len(counts) + 1
    want = []
    for k, t in rows:
        c = [counts[w] for w in split(t)] + [ends]
        want.append((str(k), len(c), sum(x > 0 for x in c), n, round(sum(math.log10((x + 0.5) / (n + 0.5 * (v + 1))) for x in c), 4)))
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    got = lm_score.score(odd, fold != 1).collect()
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in got) == sorted(want)
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)
    same = {round(r["score"], 3) for r in got if r["doc_id"] in (4, 6)}
    assert len(same) == 1


def slow_net_score(net: gru.Gru, ids: list[int], end: int) -> float:
    """log10 of the product of class and word chances, one word at a time and one number at a time."""
    d, out, h, before = gru.WIDTH, 0.0, [0.0] * gru.WIDTH, end
    used, members = net.word_bias.shape
    dot = lambda m, v, j: sum(float(m[i, j]) * v[i] for i in range(len(v)))
    share = lambda x, k: x[k] - math.log(sum(math.exp(y) for y in x))
    for t in ids:
        x = [float(e) for e in net.inputs[before]]
        a, u = [dot(net.into, x, j) + float(net.bias[j]) for j in range(3 * d)], [dot(net.state, h, j) for j in range(3 * d)]
        r, z = ([1 / (1 + math.exp(-a[j] - u[j])) for j in range(k, k + d)] for k in (0, d))
        new = [math.tanh(a[2 * d + j] + r[j] * u[2 * d + j]) for j in range(d)]
        h = [(1 - z[j]) * new[j] + z[j] * h[j] for j in range(d)]
        own = t // members if t < used * members else used + t - used * members
        out += share([dot(net.by_class, h, c) + float(net.class_bias[c]) for c in range(len(net.class_bias))], own)
        if own < used:
            out += share([dot(net.by_word[own], h, m) + float(net.word_bias[own, m]) for m in range(members)], t % members)
        before = t
    return out / math.log(10)


@pytest.mark.parametrize("head", [200_000, 40, 0])
def test_scores_against_a_plain_loop(spark, monkeypatch, head):
    rng = random.Random(4)
    docs = [(k, " ".join(rng.choice(["Der", "die", "das", "ALPHA", "beta", *(f"w{rng.randrange(40)}" for _ in range(3)), "neu" + str(k)]) for _ in range(rng.randrange(0, 90)))) for k in range(25)]
    taught, asked = docs[:15], docs
    monkeypatch.setattr(lm_score, "NET_WORDS", 12)
    monkeypatch.setattr(lm_score.vocabulary, "__defaults__", (head,))
    shared = {}

    def fixed_net(rows, vocab, *_):
        net = gru.start(vocab.net_counts, vocab.tail_tokens)
        v = net.vector()
        shared["net"], shared["vocab"] = net.load(v + np.random.default_rng(3).normal(0, 0.2, len(v))), vocab
        return net

    monkeypatch.setattr(lm_score, "train", fixed_net)
    rows = spark.createDataFrame(asked, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["score"] for r in lm_score.score(rows, F.col("doc_id") < 15).collect()}
    net, vocab = shared["net"], shared["vocab"]
    split = lambda t: t.translate(LOWER).encode().split()
    counts = Counter(w for _, t in taught for w in split(t))
    in_net = {w: int(vocab.ids[k]) for k, w in enumerate(vocab.words[:11])}
    assert len(in_net) == (0 if not head else 11)
    tail = lambda w: zlib.crc32(w[-3:]) % lm_score.TAILS
    tokens, kinds = Counter(), Counter()
    for w, n in counts.items():
        if w not in in_net:
            tokens[tail(w)] += n
            kinds[tail(w)] += 1
    for k, t in asked:
        ids = [in_net.get(w, vocab.first_tail + tail(w)) for w in split(t)] + [vocab.end]
        want = slow_net_score(net, ids, vocab.end)
        want += sum(math.log10((counts[w] + 0.5) / (tokens[tail(w)] + 0.5 * (kinds[tail(w)] + 1))) for w in split(t) if w not in in_net)
        assert got[k] == pytest.approx(want, rel=2e-4)


def test_scores_without_rows_or_training(empty, odd):
    assert lm_score.score(empty, F.lit(True)).count() == 0
    rows = lm_score.score(odd, F.lit(False)).collect()
    assert len(rows) == len(odd_rows()) and {r["train_tokens"] for r in rows} == {0} and all(math.isfinite(r["score"]) for r in rows)


def test_the_net_beats_the_counts_on_held_out_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    scored = lm_score.score(docs, fold != 1).join(docs.where(fold == 1).select("doc_id"), "doc_id").collect()
    assert sum(r["score"] for r in scored) > 0.99 * sum(r["base_score"] for r in scored)
    assert sum(r["score"] > r["base_score"] for r in scored) > 0.9 * len(scored)


def test_fields_of_the_net_round_trip():
    net = perturbed(9)
    again = gru.start(np.arange(9, 0, -1).astype(float), TAILS).load(net.vector())
    assert all(np.array_equal(getattr(net, f.name), getattr(again, f.name)) for f in fields(net))


def test_the_net_learns_from_every_training_document_once(spark, monkeypatch):
    seen = spark.sparkContext.accumulator(0)
    docs = spark.range(4000).select(F.when(F.col("id") % 4 > 0, F.col("id")).alias("doc_id"), F.concat(F.lit("a b c w"), F.col("id") % 50).alias("text"))
    vocab = lm_score.vocabulary(lm_score.count_words(docs), 4000)
    monkeypatch.setattr(lm_score, "words_of", lambda text, own=lm_score.words_of: seen.add(1) or own(text))
    lm_score.train(docs, vocab)
    assert seen.value == 4000


def test_a_labelled_sample_keeps_to_rows_and_bytes(spark):
    docs = spark.range(300).selectExpr("id AS doc_id", "repeat('x', 1000 + cast(id AS int)) AS text").unionByName(spark.sql("SELECT 7L AS doc_id, 'shorter' AS text UNION ALL SELECT 8L, NULL UNION ALL SELECT NULL, 'no id'"))
    labels = spark.range(300).selectExpr("id AS doc_id", "cast(id % 2 AS int) AS quality")
    texts, marks = quality.labelled_sample(docs, labels, F.lit(True), rows=100)
    assert len(texts) == len(marks) == 100
    texts, marks = quality.labelled_sample(docs, labels, F.lit(True), rows=300, most_bytes=50_000)
    assert 35 <= len(texts) <= 50 and sum(map(len, texts)) <= 50_000 and sum(map(len, texts)) > 48_000
    every, marks = quality.labelled_sample(docs, labels, F.lit(True), rows=300)
    assert len(every) == 300 and sorted(map(len, every))[0] == 7 and all((len(t) - 1000) % 2 == m for t, m in zip(every, marks, strict=True) if len(t) > 7)
    assert quality.labelled_sample(docs.limit(0), labels, F.lit(True)) == ([], [])
