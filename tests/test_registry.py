import duckdb
import pytest

import __spark_entry__ as entry
from tidemark.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def same(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return str(v)
    try:
        return "None" if v != v else f"{float(v):.5f}"
    except (TypeError, ValueError):
        return str(v)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_matches_its_oracle(spark, duck, name):
    mine = registry.QUERIES[name](spark, SF)
    theirs = duck.execute(registry.ORACLES[name])
    columns = [c[0] for c in theirs.description]
    assert sorted(mine.columns) == sorted(columns)
    order = sorted(columns)
    a = sorted(tuple(same(r[c]) for c in order) for r in mine.collect())
    b = sorted(tuple(same(dict(zip(columns, r, strict=True))[c]) for c in order) for r in theirs.fetchall())
    assert a == b


def test_queries_without_an_oracle():
    """These two are held against all pairs of names in test_entities."""
    assert set(registry.QUERIES) - set(registry.ORACLES) == {"q71_entity_resolution", "q144_entity_outcomes"}


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(registry.QUERIES) <= set(entry.queries()) and set(registry.ORACLES) <= set(entry.oracle_sql())
