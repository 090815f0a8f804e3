import random

import pytest
from pyspark.sql import functions as F

from tests.test_sources_streaming import replay
from tidemark.streaming import timers

HOUR = 3600


def at(seconds: int):
    return F.timestamp_seconds(F.lit(1_700_000_000) + seconds)


@pytest.mark.parametrize("longest", [None, 4 * HOUR])
def test_sessions_with_timers_equal_the_batch(spark, tmp_path, longest):
    rng = random.Random(3)
    times = sorted(rng.randrange(0, 200 * HOUR) for _ in range(400))
    late = [t + rng.randrange(-1500, 1500) for t in times]  # out of order, within the watermark
    rows = [(f"k{k % 5}", t) for k, t in enumerate(late)]
    base = spark.createDataFrame(rows, "key string, s long").withColumn("ts", at(F.col("s"))).drop("s")
    last = spark.createDataFrame([("end", 400 * HOUR)], "key string, s long").withColumn("ts", at(F.col("s"))).drop("s")
    stream = replay(spark, base.union(last), str(tmp_path / "in"), "ts")
    got = timers.run_into(timers.timed_sessions(stream, "key", "ts", HOUR, longest, "2 hours"), str(tmp_path / "out"))
    want = timers.batch_sessions(base, "key", "ts", HOUR, longest)
    shape = lambda df: sorted(tuple(map(str, r)) for r in df.where("key <> 'end'").collect())
    assert shape(got) == shape(want) and want.count() > 100
    if longest is None:
        plain = base.groupBy("key", F.session_window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n")).select("key", "w.start", "w.end", "n")
        assert shape(want) == shape(plain)
    else:
        assert want.where(F.unix_seconds("ended") - F.unix_seconds("began") > longest).count() == 0


def test_sessions_of_microseconds_equal_their_sql(spark, tmp_path):
    import duckdb

    from tidemark.plans import registry

    # Gaps of 3 hours less 0.8 ms, of exactly 3 hours and of one microsecond less; an end at the watermark and one just before it.
    times = {
        1: ["00:00:00.000900", "03:00:00.000100"], 2: ["00:00:00.000900", "03:00:00.000900"], 3: ["00:00:00.000001", "03:00:00.000000"],
        4: ["20:00:00.000000"], 5: ["19:59:59.998999", "19:59:59.998999"], 6: ["00:00:00.000000", "02:59:59.999999", "05:59:59.999999"],
    }
    rows = [(who, f"2024-01-01 {t}") for who, each in times.items() for t in each] + [(9, "2024-01-02 00:00:00"), (1, None), (None, None), (None, "2024-01-01 01:00:00")]
    spark.createDataFrame(rows, "user_id long, ts string").withColumn("ts", F.col("ts").cast("timestamp_ntz")).write.parquet(str(tmp_path / "events.parquet"))
    got = sorted(map(tuple, registry.QUERIES["q157_timed_sessions"](spark, str(tmp_path)).select("who", "began", "ended", "n").collect()), key=repr)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = sorted(con.execute(registry.ORACLES["q157_timed_sessions"]).fetchall(), key=repr)
    assert got == want and len(want) == 8


def test_overdue_promises_come_out_by_themselves(spark, tmp_path):
    promises = [(1, "a", 0, 10), (2, "a", 5, 8), (3, "b", 0, 20), (4, "c", 1, 2), (5, None, 0, 9)]
    sent = [(10, "a", 9), (11, "a", 4), (12, "b", 30), (13, "c", 2), (14, "zz", 1)]
    far = 24 * 200
    p = spark.createDataFrame(promises + [(99, "end", far, far + 1)], "promise_id long, thread string, m long, d long").select("promise_id", "thread", at(F.col("m") * HOUR).alias("made_at"), at(F.col("d") * HOUR).alias("due_at"))
    d = spark.createDataFrame(sent + [(98, "late", far)], "delivery_id long, thread string, s long").select("delivery_id", "thread", at(F.col("s") * HOUR).alias("sent_at"))
    stream = timers.promise_outcomes(replay(spark, p, str(tmp_path / "p"), "made_at"), replay(spark, d, str(tmp_path / "d"), "sent_at"), "6 hours")
    got = {(r.promise_id, r.delivery_id) for r in timers.run_into(stream, str(tmp_path / "out")).collect()}
    want = {(r.promise_id, r.delivery_id) for r in timers.promise_outcomes(p, d, "6 hours").where("promise_id < 99").collect()}
    assert want == {(1, 10), (1, 11), (2, None), (3, None), (4, 13), (5, None)}
    assert got == want
