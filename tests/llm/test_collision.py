import math
from math import comb, erf, sqrt

import numpy as np
import pytest

from tidemark.llm import collision
from tidemark.llm.collision import cell_keys, collisions, cuts_for, least_count, near_vectors, tables_for

SCHEMA = "vec_id long, embedding array<float>, label int, cell string, node string, links string, kind string"


def slow(rows: list[tuple], least: float) -> list[tuple]:
    """(vec_id, n_links, component_id, kept) by comparing every row with every other."""
    good = lambda v, label: label is not None and bool(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)
    usable = [k for k, (_, v, label) in enumerate(rows) if good(v, label)]
    links: list[list[int]] = [[] for _ in rows]
    for label, dim in {(rows[k][2], len(rows[k][1])) for k in usable}:
        own = [k for k in usable if rows[k][2] == label and len(rows[k][1]) == dim]
        x = np.array([rows[k][1] for k in own], np.float64)
        x = x / np.abs(x).max(axis=1, keepdims=True)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        near = x @ x.T >= least
        for i, k in enumerate(own):
            links[k] = [own[j] for j in np.flatnonzero(near[i]) if j != i]
    out, root = [None] * len(rows), {}
    for k in range(len(rows)):
        if k not in root:
            todo, seen = [k], {k}
            while todo:
                for j in links[todo.pop()]:
                    if j not in seen:
                        seen.add(j)
                        todo.append(j)
            ids = [rows[j][0] for j in seen if rows[j][0] is not None]
            root |= dict.fromkeys(seen, min(ids, default=None))
        out[k] = (rows[k][0], len(links[k]), root[k], rows[k][0] == root[k])
    return sorted(map(repr, out))


def planted(rng, n: int, dim: int, labels: int) -> list[tuple]:
    """Vectors of which two in five are near another one, some at just over 0.93."""
    rows = []
    for k in range(n):
        label = 0 if rng.random() < 0.4 else int(rng.integers(labels))
        v = rng.standard_normal(dim)
        if k > 10 and rng.random() < 0.4:
            other = rows[int(rng.integers(len(rows)))]
            base = np.array(other[1]) / np.linalg.norm(other[1])
            away = v - (v @ base) * base
            cos = rng.choice([0.92, 0.9302, 0.94, 0.97, 0.999])
            v, label = cos * base + sqrt(1 - cos * cos) * away / np.linalg.norm(away), other[2]
        rows.append((k + 100, [float(np.float32(x)) for x in v * rng.choice([0.01, 1, 50])], label))
    return rows


def table(spark, rows, schema=SCHEMA):
    return spark.createDataFrame([(*r, "c", "n", "l", "k") for r in rows], schema).repartition(3)


def found(df):
    assert df.columns == ["vec_id", "n_links", "component_id", "kept"]
    return sorted(repr(tuple(r)) for r in df.collect())


@pytest.mark.parametrize("sizes", [{}, {"cell": 16}, {"cell": 4000, "most": 64}])
def test_against_all_pairs(spark, sizes):
    rng = np.random.default_rng(5)
    rows = planted(rng, 1200, 24, 4)
    rows += [(2000 + k, rows[3][1], rows[3][2]) for k in range(150)]  # copies of one vector
    centre = rng.standard_normal(24)
    rows += [(3000 + k, [float(np.float32(x)) for x in centre + 0.02 * rng.standard_normal(24)], 1) for k in range(150)]  # near copies
    got, want = found(near_vectors(table(spark, rows), **sizes)), slow(rows, 0.93)
    assert got == want


def test_rows_that_link_with_nothing_and_odd_ones(spark):
    near, inf, nan = [1.0, 2.0, 3.0], float("inf"), float("nan")
    rows = [
        (1, near, 0), (2, near, 1), (3, near, None), (4, None, 0), (5, [0.0] * 3, 0), (6, [1.0, nan, 3.0], 0), (7, [1.0, inf, 3.0], 0), (8, [1.0, None, 3.0], 0), (9, [], 0),
        (10, near, 0), (10, near, 0), (None, near, 0), (None, [9.0, -9.0, 0.0], 0), (None, None, None), (11, [1.0, 2.0, 3.0, 0.0], 0), (12, [1e30, 2e30, 3e30], 1), (13, [1e-38, 2e-38, 3e-38], 1),
        (14, [0.0, -0.0, 1.0], 5), (15, [-0.0, 0.0, 2.0], 5), (4, None, 0),
    ]
    rows = [(k, v and [None if x is None else float(np.float32(x)) for x in v], label) for k, v, label in rows]
    kept_null = {"(None, 0, None, True)"}  # a row without id in a component of its own
    want = sorted(r.replace("(None, 0, None, True)", next(iter(kept_null))) for r in slow(rows, 0.93))
    assert found(near_vectors(table(spark, rows))) == want
    double = SCHEMA.replace("array<float>", "array<double>").replace("label int", "label string")
    big = [(1, [1e300, 2e300], "x"), (2, [2e-300, 4e-300], "x"), (3, [1e300, -2e300], "x")]
    assert found(near_vectors(table(spark, big, double))) == slow(big, 0.93)


def test_nothing(spark):
    assert found(near_vectors(table(spark, []))) == []


def test_collisions_are_those_of_all_pairs(monkeypatch):
    rng = np.random.default_rng(1)
    a, b = rng.standard_normal((40, 9)), rng.standard_normal((31, 9))
    want = (np.abs(a[:, None, :] - b[None, :, :]) <= 0.5).sum(axis=2)
    assert (collisions(a, b, 0.5) == want).all()
    monkeypatch.setattr(collision, "STEP", 2000)
    assert (collisions(a, b, 0.5) == want).all()


def test_calibration_holds_for_pairs_at_the_threshold():
    p, k = erf(1 / sqrt(2)), least_count(0.93)
    tail = lambda k: sum(comb(48, i) * p**i * (1 - p) ** (48 - i) for i in range(k, 49))
    assert tail(k) >= 0.999 > tail(k + 1)
    rng = np.random.default_rng(2)
    x = rng.standard_normal((4000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.standard_normal((4000, 64))
    y -= (x * y).sum(axis=1, keepdims=True) * x
    y = 0.93 * x + sqrt(1 - 0.93**2) * y / np.linalg.norm(y, axis=1, keepdims=True)
    on = collision.directions(64, 48, 0)
    assert (((np.abs(x @ on - y @ on) <= sqrt(0.14)).sum(axis=1)) >= k).mean() > 0.995
    cuts = cuts_for(100_000)
    tables = tables_for(cuts, 0.93)
    assert cuts == 10 and (cell_keys(x, cuts, tables) == cell_keys(y, cuts, tables)).any(axis=1).mean() > 0.995
