import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import intervals, ledger, sketches
from tidemark.plans import registry


def test_intervals_and_instants_equal_a_plain_scan(spark):
    rng = random.Random(7)
    log = [(rng.choice(["hot"] * 6 + ["a", "b", None]), rng.choice([0, 5, 60, 3600, 86400, 10**6, 10**7]) + rng.randrange(2000), k, rng.choice("xyz")) for k in range(600)]
    df = spark.createDataFrame(log, "key string, s long, tie int, state string").withColumn("at", F.timestamp_seconds("s")).repartition(4)
    held = intervals.validity(df, "key", "at", "tie", ["state"])
    want = []
    for key in {r[0] for r in log}:
        own = sorted((r for r in log if r[0] == key), key=lambda r: (r[1], r[2]))
        for r, following in zip(own, [*own[1:], None], strict=True):
            if following is None or following[1] > r[1]:
                want.append((key, r[3], r[1], following and following[1]))
    seconds = held.select("key", "state", F.unix_seconds("valid_from").alias("f"), F.unix_seconds("valid_to").alias("t"))
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in seconds.collect())
    instants = sorted({rng.randrange(0, 11_000_000) for _ in range(40)} | {r[1] for r in log[:20]} | {0, 1500})
    asked = spark.createDataFrame([(t,) for t in instants], "s long").select(F.timestamp_seconds("s").alias("t"), F.col("s").alias("asked"))
    got = intervals.held_at(held, asked, "t").select("asked", "key", "state")
    assert sorted(repr(tuple(r)) for r in got.collect()) == sorted(repr((t, k, s)) for t in instants for k, s, a, b in want if a <= t and (b is None or t < b))


def test_sketches_merge_without_the_events(spark):
    rng = random.Random(8)
    rows = [("g" if k % 4 else "h", f"2024-01-{1 + k % 12:02}", rng.gauss(0, 1) if k % 50 else None, rng.randrange(900)) for k in range(30_000)]
    df = spark.createDataFrame(rows, "g string, d string, v double, u int").withColumn("d", F.to_date("d"))
    daily = sketches.daily_sketches(df, ["g"], "d", "v", "u")
    again = sketches.with_days(daily, sketches.daily_sketches(df.where("d = '2024-01-05'"), ["g"], "d", "v", "u"), ["g"], "d")
    found = {(r.g, str(r.d)): r for r in sketches.window_figures(again, ["g"], "d", 7, {"p50": 0.5, "p95": 0.95}).collect()}
    assert len(found) == len({(r[0], r[1]) for r in rows})
    for (g, d), r in found.items():
        day = int(d[-2:])
        own = [x for x in rows if x[0] == g and day - 6 <= int(x[1][-2:]) <= day]
        values = sorted(x[2] for x in own if x[2] is not None)
        assert r.n == len(own) and r.people == pytest.approx(len({x[3] for x in own}), rel=0.01)
        for q, value in ((0.5, r.p50), (0.95, r.p95)):
            assert abs(sum(v <= value for v in values) / len(values) - q) < 0.005


def test_a_ledger_works_on_what_changed_and_goes_on_after_a_failure(spark, tmp_path):
    path = str(tmp_path / "ledger")
    items = spark.createDataFrame([(k, f"text {k}", None) for k in range(20)], "item int, text string, note string")
    shape = lambda df: df.select("item", "content", F.upper("text").alias("t"))

    def broken(df):
        return df.select("item", "content", F.raise_error(F.lit("no")).cast("string").alias("n"))

    count = lambda df: df.select("item", "content", F.length("t").alias("n"))
    with pytest.raises(Exception, match="no"):
        ledger.run_stages(items, "item", path, {"shape": shape, "count": broken})
    out, worked = ledger.run_stages(items, "item", path, {"shape": shape, "count": count})
    assert worked == {"shape": 0, "count": 20} and out.count() == 20
    changed = items.where("item <> 3").withColumn("text", F.when(F.col("item") < 4, "longer text").otherwise(F.col("text"))).unionByName(spark.createDataFrame([(99, "TEXT 5", None)], items.schema))
    out, worked = ledger.run_stages(changed, "item", path, {"shape": shape, "count": count})
    assert worked == {"shape": 4, "count": 4} and {r.item: r.n for r in out.collect()} == {k: 11 if k < 3 else len(f"text {k}") for k in range(20) if k != 3} | {99: 6}
    _, worked = ledger.run_stages(items, "item", path, {"shape": shape, "count": count})
    assert worked == {"shape": 0, "count": 0}  # contents of an earlier run
    nothing = lambda df: df.select("item", "content", F.lit(1).alias("x")).where("item < 0")
    assert [ledger.run_stage(items, "item", path, "none", nothing)[1] for _ in range(2)] == [20, 0]


def test_people_of_a_window_are_exact(spark):
    rng = random.Random(9)
    rows = [("g" if k % 3 else "h", f"2024-01-{rng.choice([1, 2, 5, 6, 7, 15, 16, 29]):02}", rng.choice([None, *range(9000)])) for k in range(60_000)] + [("h", "2024-01-20", None)]
    df = spark.createDataFrame(rows, "g string, d string, u int").withColumn("d", F.to_date("d")).repartition(4)
    got = {(r.g, r.d.day): r.people for r in sketches.window_people(df, ["g"], "d", 7, "u").collect()}
    want = {(g, d): len({u for h, at, u in rows if h == g and u is not None and d - 6 <= int(at[-2:]) <= d}) for g, d in {(r[0], int(r[1][-2:])) for r in rows}}
    assert got == want and got["h", 20] > 0


def test_window_query_counts_thousands_of_people_exactly(spark, tmp_path):
    day = F.timestamp_seconds(F.lit(1_704_067_200) + (F.col("id") % 9) * 86_400)
    rows = spark.range(30_000).select(day.cast("timestamp_ntz").alias("ts"), F.lit("a").alias("event_type"), (F.col("id") % 50).cast("double").alias("value"), (F.col("id") * 7 % 20_011).alias("user_id"))
    rows.write.parquet(str(tmp_path / "events.parquet"))
    got = {r.day: r.people for r in registry.QUERIES["q153_window_sketches"](spark, str(tmp_path)).collect()}
    plain = [(k % 9, k * 7 % 20_011) for k in range(30_000)]
    assert got == {f"2024-01-{d + 1:02}": len({u for at, u in plain if d - 6 <= at <= d}) for d in range(9)}


def test_totals_at_instants_equal_what_held_and_meet_no_interval(spark):
    rng = random.Random(11)
    spans = [(rng.choice(["a", "a", "b", None]), a := rng.randrange(3000), rng.choice([None, a + rng.randrange(1, 900)]), rng.randrange(100)) for _ in range(3000)]
    df = spark.createDataFrame(spans, "state string, a long, b long, v int").select("state", F.timestamp_seconds("a").alias("valid_from"), F.timestamp_seconds("b").alias("valid_to"), F.col("v").cast("double").alias("v")).repartition(4)
    asked = spark.createDataFrame([(k, None if k == 7 else k * 11 % 4000 - 50) for k in range(900)], "who int, s long").withColumn("t", F.timestamp_seconds("s"))
    got = {(r.who, r.state): (r.n, r.v) for r in intervals.totals_at(df, asked, "t", "state", "v").collect()}
    want = {}
    for k in range(900):
        for state, a, b, v in spans:
            t = k * 11 % 4000 - 50
            if k != 7 and a <= t and (b is None or t < b):
                n, total = want.get((k, state), (0, 0))
                want[k, state] = (n + 1, total + v)
    assert got == want
    plan = intervals.totals_at(df, asked, "t", "state")._jdf.queryExecution().optimizedPlan().toString()
    assert "valid_from" not in plan  # steps are summed up before instants come


def test_a_ledger_reads_its_items_once_a_run(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def read(k):
        seen.add(1)
        return f"text {k}"

    items = spark.range(20).select(F.col("id").alias("item"), read("id").alias("text"))
    stages = {name: lambda df: df.select("item", "content", F.concat("text", F.lit("x")).alias("text")) for name in ("one", "two", "three")}
    for run, fresh in enumerate((20, 0), 1):
        out, worked = ledger.run_stages(items, "item", str(tmp_path / "ledger"), stages)
        assert worked == dict.fromkeys(stages, fresh) and {r.text for r in out.collect()} == {f"text {k}xxx" for k in range(20)}
        assert seen.value == 20 * run
