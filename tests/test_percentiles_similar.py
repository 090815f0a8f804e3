import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.operators import joins, percentiles, similar


@pytest.mark.parametrize("buckets", [1, 3, 4096])
def test_percentiles_of_any_spread(spark, buckets):
    rng = random.Random(1)
    data = {"even": [rng.random() for _ in range(101)], "ties": [1.0] * 50 + [2.0, 2.0, 9.0], "one": [7.0], "far": [0.0, 1e-9, 2e-9, 1e9], None: [3.0, 4.0]}
    rows = [(k, v) for k, vs in data.items() for v in vs] + [("even", None), ("nulls", None)]
    got = percentiles.exact_percentiles(spark.createDataFrame(rows, "k string, v double"), ["k"], F.col("v"), {"mid": 0.5, "high": 0.95, "top": 1.0}, buckets).collect()
    assert {r["k"] for r in got} == set(data)
    for r in got:
        assert [r["mid"], r["high"], r["top"]] == pytest.approx([float(np.quantile(data[r["k"]], p)) for p in (0.5, 0.95, 1.0)], rel=1e-12)
    whole = percentiles.exact_percentiles(spark.createDataFrame(rows, "k string, v double"), [], F.col("v"), {"mid": 0.5}, buckets).first()
    assert whole["mid"] == pytest.approx(float(np.median([v for _, v in rows if v is not None])))


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


@pytest.mark.parametrize("least", [0.5, 0.75, 0.9])
def test_edit_pairs_against_all_pairs(spark, least):
    rng = random.Random(2)
    names = {"".join(rng.choice("abc") for _ in range(rng.randrange(1, 12))) for _ in range(90)}
    rows = spark.createDataFrame([(n,) for n in names] * 2 + [(None,)], "name string")
    want = {(a, b, distance(a, b)) for a in names for b in names if a < b and 1 - distance(a, b) / max(len(a), len(b)) >= least}
    assert {tuple(r) for r in similar.edit_pairs(rows, "name", least).collect()} == want


def test_jaro_winkler_pairs_against_all_pairs(spark):
    rng = random.Random(3)
    names = {"".join(rng.choice("abcd") for _ in range(rng.randrange(2, 9))) for _ in range(80)}
    want = {(a, b) for a in names for b in names if a < b and a[:1] == b[:1] and text.jaro_winkler_score(a, b) >= 0.9}
    assert {tuple(r) for r in similar.jaro_winkler_pairs(spark.createDataFrame([(n,) for n in names], "name string"), "name", 0.9, 1).collect()} == want


@pytest.mark.parametrize("least", [0.2, 0.5, 1.0])
def test_jaccard_pairs_against_all_pairs(spark, least):
    rng = random.Random(4)
    rows = [(k % 3, k, [f"w{rng.randrange(30)}" for _ in range(rng.randrange(0, 9))]) for k in range(90)]
    want = set()
    for g, i, x in rows:
        for h, j, y in rows:
            if g == h and i < j and x and y and len({*x} & {*y}) / len({*x} | {*y}) >= least:
                want.add((g, i, j))
    got = joins.jaccard_pairs(spark.createDataFrame(rows, "k int, id int, ws array<string>"), "k", "id", "ws", least)
    assert {tuple(r)[:3] for r in got.collect()} == want


def test_family_survives_a_cycle(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (1, 3)], "parent int, child int")
    got = {(r["node"], r["depth"]) for r in joins.family(edges, spark.createDataFrame([(1,)], "root int"), 5).collect()}
    assert got == {(1, 0), (2, 1), (3, 1)}


def test_opposite_pairs_of_two_and_of_more_accounts(spark):
    legs = [(1, "d", -5.0, "a"), (2, "d", -5.0, "a"), (3, "d", 5.0, "b"), (4, "d", 5.0, "b"), (5, "d", 5.0, "b"), (6, "e", -5.0, "a"), (7, "e", 5.0, "a"), (8, "f", -1.0, "a"), (9, "f", 1.0, "a"), (10, "f", 1.0, "c"), (11, "f", -1.0, "c")]
    got = joins.opposite_pairs(spark.createDataFrame(legs, "id long, day string, amount double, account string"), ["day"], "amount", "account", "id")
    assert {tuple(r) for r in got.collect()} == {(1, 3), (2, 4), (8, 10), (11, 9)}
