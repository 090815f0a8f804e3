import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm.conftest import odd_rows
import corpus_pipeline
from tidemark.llm import exact_dedup, simhash
from tidemark.llm.components import components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_exact_duplicates_against_brute_force(odd, keep):
    groups = defaultdict(list)
    for k, t in odd_rows():
        groups[(t or "").translate(LOWER)].append(k)
    pick = min if keep == "smallest" else max
    want = []
    for t, ids in groups.items():
        stays = pick((i for i in ids if i is not None), default=None)
        want += [(str(i), str(stays), len(ids), i == stays, hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    got = exact_dedup.exact_duplicates(odd, keep=keep)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted((str(r[0]), str(r[1]), *r[2:]) for r in got.collect()) == sorted(want)


def test_exact_duplicates_of_nothing(empty):
    assert exact_dedup.exact_duplicates(empty).count() == 0
    assert exact_dedup.drop_exact_duplicates(empty).columns == empty.columns


def test_runs_merge_to_the_same_in_any_tree(spark):
    docs = spark.range(0, 500, 1, 10).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("t"), (F.col("id") % 50).cast("string"))).alias("text"))
    rows = exact_dedup.digests(docs)
    trees = [sorted(tuple(r) for r in exact_dedup.merge_runs(rows, "smallest", rounds, fan).collect()) for rounds, fan in ((2, 8), (4, 2), (1, 2), (2, 3))]
    assert all(t == trees[0] for t in trees) and sum(t[-1] for t in trees[0]) == 500


def test_rounds_hand_sorted_runs_over_and_merge_them(spark):
    rows = exact_dedup.digests(spark.range(200).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text")))
    merged = exact_dedup.merge_runs(rows, rounds=3, fan_in=2)
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Exchange shufflepartitionidpassthrough") == 2  # one hand-over a round
    assert "HashAggregate" not in plan and plan.count("SortAggregate") == 6 and plan.count("Sort [") == 4  # each round sorts once; the first also in the tasks before
    places = [[bytes(r["digest"]) for r in part] for part in merged.rdd.glom().collect()]
    assert len(places) == 8 and [d for p in places for d in p] == sorted(d for p in places for d in p)  # one run, sorted over all places


def test_a_false_digest_match_is_not_merged(spark):
    rows = spark.createDataFrame([(1, b"same", 4, 11), (2, b"same", 4, 12)], "doc_id long, digest binary, octets int, proof long")
    assert exact_dedup.merge_runs(rows).count() == 2


def test_drop_exact_duplicates_tells_rows_apart(odd):
    left = exact_dedup.drop_exact_duplicates(odd, keep="largest")
    texts = [(r["doc_id"], (r["text"] or "").translate(LOWER)) for r in left.collect()]
    assert left.columns == odd.columns
    assert sorted(t for _, t in texts) == sorted({(t or "").translate(LOWER) for _, t in odd_rows()})  # each text once
    assert (14, "another text with the same id") in texts and (None, "no id here") in texts and (6, odd_rows()[4][1].translate(LOWER)) in texts


def slow_fingerprint(text: str | None) -> int:
    words = (text or "").translate(LOWER).split()
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", (text or "").translate(LOWER)) if w]
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(bits: list[int], radius: int) -> list[int]:
    parent = list(range(len(bits)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(bits)):
        for j in range(i):
            if (bits[i] ^ bits[j]).bit_count() <= radius:
                parent[find(i)] = find(j)
    return [find(k) for k in range(len(bits))]


def test_fingerprints_against_the_definition(odd):
    got = sorted((str(r["doc_id"]), r["bits"] % 2**64) for r in simhash.fingerprints(odd).collect())
    assert got == sorted((str(k), slow_fingerprint(t)) for k, t in odd_rows())


def test_fingerprint_equals_the_engines_hash(spark):
    h = spark.range(1).select(F.xxhash64(F.lit("a b c"))).first()[0] % 2**64
    assert h == xxhash.xxh64(b"a b c", seed=42).intdigest() == simhash.fingerprint(b"A b  C")


def clustered(n: int, seed: int) -> list[int]:
    rng = random.Random(seed)
    out = []
    while len(out) < n:
        x = rng.getrandbits(64)
        for _ in range(rng.randrange(1, 6)):
            out.append(x)
            for b in rng.sample(range(64), rng.randrange(1, 6)):
                x ^= 1 << b
    return sorted(set(out[:n]) | {0, 2**64 - 1})


@pytest.mark.parametrize("n", [3, 150, 1500])
def test_tree_links_are_exact(n):
    bits = clustered(n, n)
    got = simhash.link_within(np.array(bits, np.uint64), 3, leaf=16)
    want = slow_components(bits, 3)
    assert len(set(zip(got.tolist(), want, strict=True))) == len(set(want)) == len(set(got.tolist()))


@pytest.mark.parametrize("halves, most", [(2, 4096), (1, 4096), (2, 64), (1, 64), (3, 64)])
def test_every_link_has_a_shard_of_its_own(spark, halves, most):
    bits = np.array(clustered(600, 5), np.uint64)
    nodes = spark.createDataFrame([(int(b),) for b in bits.view(np.int64)], "bits long")
    levels = simhash.levels_for(len(bits), most)
    shards = defaultdict(set)
    for r in simhash.vantage_shards(nodes, levels, halves).collect():
        shards[r["bits"]].add(r["shard"])
    i, j = np.nonzero(np.bitwise_count(bits[:, None] ^ bits[None, :]) <= 3)
    assert levels >= (4 if most == 64 else 1) and len(set.union(*shards.values())) > (50 if most == 64 else 2)
    assert all(shards[int(a)] & shards[int(b)] for a, b in zip(bits.view(np.int64)[i], bits.view(np.int64)[j], strict=True))


@pytest.mark.parametrize("halves, most, dense", [(2, 4096, False), (1, 4096, False), (2, 20, False), (2, 4, False), (2, 60, True), (1, 8, True)])
def test_shards_and_splits_lose_no_link(spark, halves, most, dense):
    rng = random.Random(8)
    bits = sorted({0x5A5A << 40 ^ sum(1 << 5 * b for b in range(12) if rng.random() < 0.4) for _ in range(300)}) if dense else clustered(300, 77)
    signed = [b - 2**64 if b >> 63 else b for b in bits]
    edges = simhash.near_links(spark.createDataFrame([(b,) for b in signed], "bits long"), 3, halves, most)
    root = {r["node"]: r["root"] for r in components(edges).collect()}
    want = slow_components(bits, 3)
    got = [root.get(b, b) for b in signed]
    assert len(set(zip(got, want, strict=True))) == len(set(want)) == len(set(got))


def test_components_of_a_long_path_and_a_star(spark):
    path = [(k, k + 1) for k in range(200)]
    star = [(1000, 1001 + k) for k in range(100)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(path + star + [(5, 5)], "a long, b long")).collect()}
    assert got == {k: 0 for k in range(201)} | {1000 + k: 1000 for k in range(101)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates_against_brute_force(odd, empty):
    rows = odd_rows()
    want = slow_components([slow_fingerprint(t) for _, t in rows], 3)
    least = {c: min((k for (k, _), x in zip(rows, want, strict=True) if x == c and k is not None), default=None) for c in want}
    got = simhash.near_duplicates(odd)
    assert sorted((str(r["doc_id"]), str(r["component_id"])) for r in got.collect()) == sorted((str(k), str(least[c])) for (k, _), c in zip(rows, want, strict=True))
    assert simhash.near_duplicates(empty).count() == 0
    left = simhash.drop_near_duplicates(odd)
    assert left.columns == odd.columns and {r["doc_id"] for r in left.collect()} >= {4, 10, 14, None}
    assert not {r["doc_id"] for r in left.collect()} & {6, 1, 2}


def test_the_stage_drops_copies_of_likeness_from_eight_tenths(spark):
    rng = random.Random(3)
    docs = [(k, " ".join(f"w{rng.randrange(5000)}" for _ in range(rng.randrange(60, 300)))) for k in range(300)]
    cuts = lambda t: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)}
    near, far = [], []
    for k, t in docs:
        words = t.split()
        for _ in range(rng.randrange(1, 1 + len(words) // 40)):
            words[rng.randrange(len(words))] = "edited"
        a, b = cuts(t), cuts(" ".join(words))
        likeness = len(a & b) / len(a | b)
        (near if likeness >= 0.8 else far).append((1000 + k, " ".join(words), likeness))
    rows = spark.createDataFrame(docs + [x[:2] for x in near + far], "doc_id long, text string")
    left = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, rows, "").collect()}
    assert len(near) > 100 and len(far) > 30 and sum(x[2] < 0.9 for x in near) > 50
    assert sum(x[0] in left for x in near) <= 0.01 * len(near)
    assert left >= {k for k, _ in docs} | {x[0] for x in far if x[2] < 0.5}
    bits = {k: simhash.fingerprint(t.encode()) for k, t, *_ in docs + far}
    assert left >= {x[0] for x in far if (bits[x[0]] ^ bits[x[0] - 1000]).bit_count() > 3}


@pytest.mark.parametrize("crowd", [1024, 12])
def test_no_link_of_a_crowded_band_is_lost(spark, monkeypatch, crowd):
    """Many texts around one passage, of likeness from 0.6 to 0.95: all that share a band and are alike end up connected."""
    rng = random.Random(12)
    base = [f"w{k}" for k in range(600)]
    texts = []
    for k in range(90):
        words = list(base)
        for _ in range(rng.choice([2, 5, 7, 9, 12, 20, 30])):
            words[rng.randrange(600)] = f"x{k}y{rng.randrange(1000)}"
        texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    monkeypatch.setattr(simhash.crossing, "__defaults__", (crowd, 1 << 21))
    rows = simhash.sketches(docs, 5)
    links = simhash.alike(rows, docs, 5, 0.8)
    root = {r["node"]: r["root"] for r in components(links).collect()}
    bits = {r["doc_id"]: r["bits"] for r in rows.collect()}
    sets = [simhash.shingle_set(t.encode(), 5) for t in texts]
    bands = [set(simhash.band_keys(simhash.least_hashes(x)).tolist()) for x in sets]
    alike, crowded = [], 0
    for a in range(90):
        for b in range(a):
            if bands[a] & bands[b]:
                crowded += 1
                if len(np.intersect1d(sets[a], sets[b])) >= 0.8 * len(np.union1d(sets[a], sets[b])):
                    alike.append((a, b))
    want = slow_components_of(90, alike)
    assert 500 < len(alike) < crowded - 500 and len(set(want)) > 1
    got = [root.get(bits[k], bits[k]) for k in range(90)]
    pairs = {(got[a] == got[b], want[a] == want[b]) for a in range(90) for b in range(a)}
    assert (False, True) not in pairs and (True, False) not in pairs


def slow_components_of(n: int, links: list[tuple[int, int]]) -> list[int]:
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(k) for k in range(n)]


def test_large_shards_go_down_their_own_tree(spark):
    rng = random.Random(6)
    bits = [rng.getrandbits(64) for _ in range(3000)]
    nodes = spark.createDataFrame([(b - 2**64 if b >> 63 else b,) for b in bits], "bits long")
    for levels in (0, 1, 3):
        sizes = simhash.split_large(simhash.vantage_shards(nodes, levels), most=150).groupBy("shard").count()
        assert sizes.agg(F.max("count")).first()[0] <= 150


def test_shared_counts():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 9000, rng.integers(0, 6000))) for _ in range(12)]
    assert (simhash.shared_counts(sets[:5], sets[5:]) == [[len(np.intersect1d(a, b)) for b in sets[5:]] for a in sets[:5]]).all()
