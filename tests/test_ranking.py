import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import intake, ranking, resolution


def test_numbers_equal_a_window_over_all_rows(spark):
    rng = random.Random(1)
    rows = [(k, rng.choice(["hot"] * 8 + ["a", "b", None]), rng.choice([None, 1, 2, 3])) for k in range(2000)]
    df = spark.createDataFrame(rows, "id int, g string, v int").repartition(6)
    key = lambda r: (r[2] is None, -(r[2] or 0), r[0])
    got = {r.id: r.place for r in ranking.numbered(df, ["g"], [F.desc_nulls_last("v"), F.asc("id")]).collect()}
    assert got == {r[0]: k for g in ("hot", "a", "b", None) for k, r in enumerate(sorted((x for x in rows if x[1] == g), key=key), 1)}
    got = {r.id: r.n for r in ranking.numbered(df, [], [F.asc("id")], "n").collect()}
    assert got == {k: k + 1 for k in range(2000)}


@pytest.mark.parametrize("slice_", [None, 7, 100])
def test_runs_over_slices_equal_sessions(spark, slice_):
    rng = random.Random(2)
    times = [0, 5, 9, 10, 19, 40, 41] + [rng.randrange(0, 4000) for _ in range(300)] + list(range(5000, 5600, 3))
    df = spark.createDataFrame([("hot" if k % 3 else "b", t) for k, t in enumerate(times)] + [(None, 1), ("c", None)], "k string, t long").withColumn("at", F.timestamp_seconds("t"))
    got = sorted((r.k or "", r.b, r.l, r.n) for r in ranking.gap_runs(df, "k", "at", 10, slice_).select("k", F.unix_seconds("began").alias("b"), F.unix_seconds("last").alias("l"), "n").collect())
    want = [("", 1, 1, 1)]
    for key in ("hot", "b"):
        run = []
        for t in sorted(t for k, t in enumerate(times) if ("hot" if k % 3 else "b") == key):
            if run and t - run[-1] >= 10:
                want.append((key, run[0], run[-1], len(run)))
                run = []
            run.append(t)
        want.append((key, run[0], run[-1], len(run)))
    assert got == sorted(want)
    due = intake.debounced(df.where("k = 'b'"), "k", "at", 10).agg(F.max(F.unix_seconds("due")), F.sum("n")).first()
    assert due[0] == max(t for k, t in enumerate(times) if k % 3 == 0) + 10


def test_greedy_choice_equals_a_pass_in_order(spark):
    rng = random.Random(3)
    pairs = {tuple(sorted(rng.sample(range(200), 2))) for _ in range(250)} | {(k, k + 1) for k in range(300, 330)}
    ids = list(range(200)) + list(range(300, 331))
    taken = []
    for k in ids:
        if not any((t, k) in pairs for t in taken):
            taken.append(k)
    got = ranking.greedy_choice(spark.createDataFrame([(k,) for k in ids], "id int"), "id", spark.createDataFrame(list(pairs), "before int, after int"))
    assert sorted(r.id for r in got.collect()) == taken


def test_a_source_of_all_drafts_is_decided_by_rounds(spark):
    rows = [("one", f"f{k:04}", f"alpha{k // 3} beta{k // 3} gamma{k // 3}", k % 7, False, 0.5, k in (4, 9, 11)) for k in range(900)]
    df = spark.createDataFrame(rows, "source string, fingerprint string, title string, impact int, protected boolean, confidence double, pending boolean")
    got = {r.fingerprint for r in resolution.review_queue(df, 5).collect()}
    best = {}
    for r in sorted(rows, key=lambda r: (-r[3], r[1])):
        best.setdefault(r[2], r)
    stay = sorted(best.values(), key=lambda r: (not r[6], -r[3], r[1]))
    assert got == {r[1] for k, r in enumerate(stay) if r[6] or k < 5}


def test_small_and_large_sources_are_decided_alike(spark, monkeypatch):
    rng = random.Random(5)
    words = [f"word{k}" for k in range(9)]
    rows = [(rng.choice(["a", "b", "c", None, *map(str, range(30))]), f"f{k % 700}", " ".join(rng.sample(words, rng.randrange(0, 5))), rng.randrange(4), k % 3 == 0, 0.5, rng.choice([True, False, False, None])) for k in range(1500)]
    rows = list({(r[0], r[1]): r for r in rows}.values())
    df = spark.createDataFrame(rows, "source string, fingerprint string, title string, impact int, protected boolean, confidence double, pending boolean").repartition(5).cache()

    def plain(slots):
        out = set()
        for source in {r[0] for r in rows}:
            stay = []
            for r in sorted((r for r in rows if r[0] == source), key=lambda r: (-r[3], -r[4], r[1])):
                own = set(r[2].split())
                if source is None or not any(own & set(s[2].split()) and len(own & set(s[2].split())) / len(own | set(s[2].split())) >= 0.6 for s in stay):
                    stay.append(r)
            order = sorted(stay, key=lambda r: {True: 0, False: 1, None: 2}[r[6]])
            out |= {(source, r[1]) for k, r in enumerate(order) if r[6] or k < slots}
        return out

    found = lambda: {(r.source, r.fingerprint) for r in resolution.review_queue(df, 3).collect()}
    want = plain(3)
    for most in (10_000, 40, 0):  # all small; some large; all large
        monkeypatch.setattr(resolution, "SIDE_BY_SIDE", most)
        assert found() == want
    monkeypatch.undo()
    monkeypatch.setattr(ranking, "greedy_choice", None)  # small sources need no rounds
    small = df.where("source IS NOT NULL AND length(source) < 3 AND source > '0' AND source < 'a'")
    assert resolution.review_queue(small, 3).count() == sum(x[0] is not None and "0" < x[0] < "a" for x in want)
