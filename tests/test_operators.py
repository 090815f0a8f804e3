import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import groups, joins, search, security, series, upsert


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_asof_backward_and_forward_against_brute_force(spark):
    rng = random.Random(5)
    asked = [(k, rng.randrange(3), rng.randrange(40)) for k in range(60)]
    points = [(rng.randrange(3), rng.randrange(40), rng.randrange(100)) for _ in range(40)]
    left, right = spark.createDataFrame(asked, "id int, key int, at int"), spark.createDataFrame(points, "key int, ts int, value int")

    def back(key, at):
        before = [(t, v) for k, t, v in points if k == key and t <= at]
        return max(before)[1] if before else None

    def ahead(key, at):
        later = [(t, v) for k, t, v in points if k == key and t > at]
        return min(later)[1] if later else -1

    assert rows(joins.asof_backward(left, right, "key", "at", "ts", "value", "v").select("id", "v").na.fill(-9)) == [(i, -9 if (x := back(k, a)) is None else x) for i, k, a in asked]
    assert rows(joins.asof_forward(left, right, "key", "at", "ts", "value", F.lit(-1), "v").select("id", "v")) == [(i, ahead(k, a)) for i, k, a in asked]


def test_within_range_has_every_pair_once(spark):
    rng = random.Random(2)
    a = [(k, rng.randrange(2), rng.randrange(20_000)) for k in range(50)]
    b = [(k, rng.randrange(2), rng.randrange(20_000)) for k in range(50)]
    left = spark.createDataFrame(a, "a int, key int, s long").select("a", "key", F.timestamp_seconds("s").alias("a_ts"))
    right = spark.createDataFrame(b, "b int, key int, s long").select("b", "key", F.timestamp_seconds("s").alias("b_ts"))
    got = rows(joins.within_range(left, right, ["key"], F.col("a_ts"), F.col("b_ts"), 900).select("a", "b"))
    assert got == sorted((x, y) for x, k, s in a for y, j, t in b if k == j and abs(s - t) <= 900)


def test_family_ends_on_cycles(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4)], "parent int, child int")
    assert rows(joins.family(edges, spark.createDataFrame([(1,)], "root int"), 6)) == [(1, 1, 0), (1, 2, 1), (1, 3, 2), (1, 4, 3)]


def test_for_all_needs_children(spark):
    parents = spark.createDataFrame([(1,), (2,), (3,)], "p int")
    children = spark.createDataFrame([(1, True), (1, True), (2, True), (2, None)], "p int, ok boolean")
    assert rows(joins.for_all(parents, children, "p", F.col("ok"))) == [(1,)]


def test_opposite_pairs_skip_the_same_account(spark):
    legs = [(1, "d", -5, "a"), (2, "d", 5, "a"), (3, "d", 5, "b"), (4, "d", -5, "b"), (5, "e", -5, "a")]
    df = spark.createDataFrame(legs, "id long, day string, amount int, account string")
    assert rows(joins.opposite_pairs(df, ["day"], "amount", "account", "id")) == [(1, 3), (4, 2)]


def test_bag_difference_pairs_by_position(spark):
    before = spark.createDataFrame([("k", "a"), ("k", "b"), ("k", "b"), ("m", "x")], "k string, v string")
    after = spark.createDataFrame([("k", "b"), ("k", "c"), ("n", "y")], "k string, v string")
    assert {tuple(r) for r in joins.bag_difference(before, after, "k", "v").collect()} == {("k", "a", "c"), ("k", "b", None), ("m", "x", None), ("n", None, "y")}


def test_capped_top_pins_and_fills_up(spark):
    data = [(1, "g", 90, False), (2, "g", 80, False), (3, "g", 70, False), (4, "g", 60, False), (5, None, 10, False), (6, "h", 5, True)]
    df = spark.createDataFrame(data, "id int, grp string, score int, pin boolean")
    got = groups.capped_top(df, "grp", [F.desc("score"), F.asc("id")], 5, 2, F.col("pin"))
    assert rows(got.select("place", "id")) == [(1, 6), (2, 1), (3, 2), (4, 5), (5, 3)]


def test_last_points_and_since_last(spark):
    df = spark.createDataFrame([("a", k, k * k) for k in range(5)] + [("b", 1, 9)], "k string, t int, v int")
    got = {r["k"]: [tuple(p) for p in r["points"]] for r in groups.last_points(df, ["k"], "t", 2, ["v"], "points").collect()}
    assert got == {"a": [(3, 9), (4, 16)], "b": [(1, 9)]}
    assert rows(groups.since_last(df, ["k"], "t", F.col("v") == 4).select("k", "t")) == [("a", 3), ("a", 4), ("b", 1)]


def test_series(spark):
    counted = spark.createDataFrame([("2026-11-01", 4), ("2026-12-25", 1)], "day string, n int").select(F.col("day").cast("date").alias("day"), "n")
    filled = series.fill(series.day_spine(spark, "2026-11-02", 3), counted, "day", ["n"]).orderBy("day").collect()
    assert [(str(r["day"]), r["n"]) for r in filled] == [("2026-10-31", 0), ("2026-11-01", 4), ("2026-11-02", 0)]
    months = [str(r["month"]) for r in series.month_spine(spark, "2026-01-15", "2026-04-01").collect()]
    assert months == ["2026-01-01", "2026-02-01", "2026-03-01"]
    df = spark.createDataFrame([(k, float(k)) for k in range(4)], "t int, v double")
    out = df.select("t", series.trailing(F.col("v"), 3, F.col("t"), full_only=True).alias("m")).orderBy("t").collect()
    assert [r["m"] for r in out] == [None, None, 1.0, 2.0]
    short = df.limit(2).select(series.trailing(F.col("v"), 3, F.col("t"), full_only=True).alias("m")).collect()
    assert sorted(str(r["m"]) for r in short) == ["0.5", "None"]


def test_scopes_nest(spark):
    items = spark.createDataFrame([(k, lv, s) for k, (lv, s) in enumerate([("LOW", "a"), ("HIGH", "a"), (None, "b"), ("CRITICAL", None)])], "id int, level string, source string")
    see = lambda scope: rows(items.where(security.readable(scope, F.col("level"), F.col("source"), F.col("id"))).select("id"))
    assert see(security.Scope()) == []
    assert see(security.Scope(clearance="MEDIUM")) == [(0,)]
    assert see(security.Scope(clearance="MEDIUM", sources=("b",), items=(3,))) == [(0,), (2,), (3,)]
    assert see(security.Scope(everything=True)) == [(0,), (1,), (2,), (3,)]


def test_two_rules_of_provenance(spark):
    records = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "id int, text string")
    refs = spark.createDataFrame([(1, True), (1, False), (2, False)], "id int, ok boolean")
    assert rows(security.hide_by_provenance(records, refs, "id", F.col("ok"))) == [(3, "z")]
    assert {tuple(r) for r in security.masked_by_provenance(records, refs, "id", F.col("ok"), "text").collect()} == {(1, "x"), (2, None), (3, "z")}


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_upsert_twice_is_once_whatever_the_partitioning(spark, parts):
    current = spark.createDataFrame([(1, "a", 1), (2, "b", 4)], "k int, s string, version int")
    incoming = spark.createDataFrame([(2, "c"), (3, "d"), (1, "a"), (4, None)], "k int, s string").repartition(parts)
    once = upsert.upsert(current, incoming, ["k"], ["s"])
    want = [(1, "a", 1), (2, "c", 5), (3, "d", 1), (4, None, 1)]
    assert rows(once) == want and rows(upsert.upsert(once, incoming, ["k"], ["s"])) == want
    change = {r["k"]: r["change"] for r in upsert.classify_changes(current, incoming, ["k"], ["s"]).collect()}
    assert change == {1: "unchanged", 2: "updated", 3: "created", 4: "created"}


def test_repoint_folds_edges(spark):
    edges = spark.createDataFrame([(1, "r", 5, 0.5, 10, 1), (2, "r", 5, 0.9, 11, 3), (1, "r", 2, 0.9, 12, 3)], "from_id int, relation string, to_id int, confidence double, source_id int, seen_at int")
    merged = spark.createDataFrame([(2, 1)], "old_id int, new_id int")
    assert rows(upsert.repoint(edges, merged)) == [(1, "r", 5, 0.9, 2, 1, 3)]


def test_search_tiers_and_groups(spark):
    docs = spark.createDataFrame([(1, "signed contracts"), (2, "contract"), (3, "subcontractor unsigned"), (4, "")], "id int, text string")
    index = search.postings(docs, "id", {"text": 1.0})
    assert rows(search.match_all(index, search.SearchPlan.parse("contract")).select("id")) == [(1,), (2,)]
    assert rows(search.match_all(index, search.SearchPlan.parse("contract -sign")).select("id")) == [(2,)]
    find = lambda t: rows(search.best_tiers(docs, "id", "text", [t]).select("id", "tier"))
    assert find("contracts") == [(1, 1), (2, 1)] and find("subcontr") == [(3, 2)] and find("bcontr") == [(3, 3)] and find("zzz") == []
    hits = spark.createDataFrame([("a", k, k) for k in range(4)] + [("b", 9, 9)], "type string, id int, rank int")
    got = rows(search.grouped_results(hits, search.SearchPlan((), per_type=2), [F.desc("rank")]).select("type", "id", "place", "more"))
    assert got == [("a", 2, 2, True), ("a", 3, 1, True), ("b", 9, 1, False)]


def test_ordered_sums_have_one_last_digit(spark):
    from tidemark.operators import series

    values = [0.1, 0.2, 0.3, 1e16, 0.7, -1e16, 5.55, 2.05] * 7
    rows = spark.createDataFrame([(g, k, v) for g in "ab" for k, v in enumerate(values)], "g string, k int, v double")
    plain = 0.0
    for v in values:
        plain += v
    for parts in (1, 3, 13):
        got = series.ordered_sum(rows.repartition(parts), ["g"], "v", "k").collect()
        assert sorted((r.g, r.v) for r in got) == [("a", plain), ("b", plain)]


def test_metric_change_rounds_halves_like_its_sql(spark, tmp_path):
    import duckdb

    from tidemark.plans import registry

    pairs = [(240.0, 136.86), (161.6, 81.81), (184.0, 50.37), (2.0, 3.0), (100.0, 100.0)]
    rows = [(2 * k + j, f"2024-01-0{1 + j} 10:00:00", k, v) for k, pair in enumerate(pairs) for j, v in enumerate(pair)]
    df = spark.createDataFrame(rows, "event_id long, ts string, user_id long, value double").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    df.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    got = {r.user_id: r.change for r in registry.QUERIES["q39_metric_view"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    assert got == {r[0]: r[3] for r in con.execute(registry.ORACLES["q39_metric_view"]).fetchall()}


def test_metric_view_has_its_sqls_signs_and_places(spark, tmp_path):
    import duckdb

    from tidemark.plans import registry

    days = ["2024-01-01 10:00:00", "2024-01-02 10:00:00", None]
    series = [(1000.0, 999.99), (999.99, 1000.0), (5.0, 5.0), (-0.00002, -0.00003), (7.0, 9.0, 11.0), (2.00005, 1.00005), (None, 3.0)]
    rows = [(3 * k + j, days[j], k, v) for k, values in enumerate(series) for j, v in enumerate(values)] + [(90, days[2], 90, 4.0), (91, days[0], 90, 6.0)]
    df = spark.createDataFrame(rows, "event_id long, ts string, user_id long, value double").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    df.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    found = registry.QUERIES["q39_metric_view"](spark, str(tmp_path)).select("user_id", "current", "previous", "change", "target_progress")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = sorted(map(repr, con.execute(registry.ORACLES["q39_metric_view"]).fetchall()))
    assert sorted(repr(tuple(r)) for r in found.collect()) == want and any("-0.0," in r for r in want)


def test_partitions_grow_with_rows(spark, tmp_path, monkeypatch):
    from tidemark.operators import groups
    from tidemark.plans import assistant

    assert groups.parts(spark, 0) == 4 and groups.parts(spark, 4 * groups.ROWS + 1) == 5
    spark.sql("SELECT id AS o_orderkey, id % 7 AS o_custkey, if(id % 2 = 0, 'P', 'O') AS o_orderstatus, id * 1D AS o_totalprice, timestamp_ntz'2001-01-01 00:00:00' AS o_orderdate FROM range(50)").write.parquet(f"{tmp_path}/orders.parquet")
    spark.sql("SELECT id % 50 AS l_orderkey, id % 9 AS l_suppkey FROM range(90)").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.sql("SELECT id AS event_id, id % 8 AS user_id, timestamp_ntz'2001-01-01 00:00:00' AS ts FROM range(40)").write.parquet(f"{tmp_path}/events.parquet")
    monkeypatch.setattr(groups, "ROWS", 10)
    found = assistant.q142(spark, str(tmp_path))
    assert "hashpartitioning(o_custkey" in (plan := found._jdf.queryExecution().executedPlan().toString()) and ", 9), REPARTITION_BY_NUM" in plan
    assert {(r.who, r.section, r.n) for r in found.groupBy("who", "section").agg({"*": "count"}).toDF("who", "section", "n").collect()} == {(w, s, 5) for w in range(7) for s in ("deal", "recent", "touch", "supplier")}


def test_family_items_are_dealt_by_number(spark, monkeypatch):
    from tidemark.operators import groups, joins

    monkeypatch.setattr(groups, "ROWS", 10)
    edges = spark.createDataFrame([(1, 2), (2, 3)], "parent int, child int")
    items = spark.createDataFrame([(k % 4, k % 30, k) for k in range(90)], "entity int, item int, seen_at int")
    found = joins.family_items(spark.createDataFrame([(1,), (3,)], "entity int"), edges, items)
    assert found._jdf.queryExecution().executedPlan().toString().count(", 9), REPARTITION_BY_NUM") >= 2
    want = {(e, len(m), len({k % 30 for k in range(90) if k % 4 in m}), min(k for k in range(90) if k % 4 in m), max(k for k in range(90) if k % 4 in m)) for e, m in ((1, {1, 2, 3}), (3, {3}))}
    assert set(map(tuple, found.collect())) == want
