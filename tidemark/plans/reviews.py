"""Read models: insights, rescoring, agenda, pulse, reviews, scoreboard, risks, boards, access and defaults."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import dates, rounding
from tidemark.operators import ranking, review, series
from tidemark.plans.registry import query, table

TODAY = "2001-08-01"
NY = "America/New_York"


@query(
    "q90_rescore_delegates",
    """WITH l AS (SELECT s_suppkey, s_nationkey, count(l_orderkey) AS load FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey AND l_linestatus = 'O' GROUP BY 1, 2),
            d AS (SELECT s_nationkey, first(s_suppkey ORDER BY load, s_suppkey) AS delegate FROM l GROUP BY 1), n AS (SELECT l_orderkey, count(*) AS blocks FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1)
       SELECT o_orderkey, coalesce(blocks, 0) AS blocks, delegate, least(100, coalesce(blocks, 0) * 5 + CASE o_orderpriority WHEN '1-URGENT' THEN 50 WHEN '2-HIGH' THEN 30 ELSE 10 END) AS score
       FROM orders JOIN customer ON c_custkey = o_custkey LEFT JOIN n ON l_orderkey = o_orderkey LEFT JOIN d ON s_nationkey = c_nationkey WHERE o_orderstatus = 'O'""",
)
def q90(spark, sf):
    """Open tasks rescored by what they block, each with the least-loaded person of its field."""
    lines = table(spark, sf, "lineitem").where("l_linestatus = 'O'").select("l_orderkey", "l_suppkey")
    orders = table(spark, sf, "orders").where("o_orderstatus = 'O'").select("o_orderkey", "o_custkey", "o_orderpriority")
    tasks = orders.join(table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("field")), F.col("o_custkey") == F.col("c_custkey"))
    blocks = lines.groupBy("l_orderkey").agg(F.count("*").alias("blocks"))
    tasks = tasks.join(blocks, F.col("l_orderkey") == F.col("o_orderkey"), "left").withColumn("blocks", F.coalesce("blocks", F.lit(0)))
    people = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("person"), F.col("s_nationkey").alias("field"))
    loads = lines.groupBy(F.col("l_suppkey").alias("person")).agg(F.count("*").alias("load"))
    base = F.when(F.col("o_orderpriority") == "1-URGENT", 50).when(F.col("o_orderpriority") == "2-HIGH", 30).otherwise(10)
    return review.delegates(tasks, people, loads, "field").select("o_orderkey", "blocks", "delegate", F.least(F.lit(100), F.col("blocks") * 5 + base).alias("score"))


INSIGHTS = {
    "overdue": f"SELECT o_custkey AS subject, 40 + least(60, datediff('day', o_orderdate, TIMESTAMP '{TODAY}') // 60) AS importance FROM orders WHERE o_orderstatus = 'O' AND o_orderdate < TIMESTAMP '{TODAY}' - INTERVAL 365 DAY",
    "stalled": "SELECT o_orderkey, 50 FROM orders WHERE o_orderstatus = 'P' AND o_totalprice > 300000",
    "large": "SELECT o_custkey, o_totalprice / 10000 FROM orders WHERE o_totalprice > 400000",
    "idle": "SELECT c_custkey, 30 FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)",
    "in_debt": "SELECT c_custkey, -c_acctbal / 100 FROM customer WHERE c_acctbal < 0",
    "overloaded": "SELECT l_suppkey, count(*) FROM lineitem GROUP BY 1 HAVING count(*) > (SELECT count(*) / count(DISTINCT l_suppkey) FROM lineitem) * 1.05",
    "errors": "SELECT user_id, count(*) FROM events WHERE event_type = 'error' GROUP BY 1 HAVING count(*) >= 5",
    "silent": "SELECT user_id, 20 FROM events GROUP BY 1 HAVING max(ts) < (SELECT max(ts) FROM events) - INTERVAL 5 DAY",
    "unlabelled": "SELECT source, count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY 1",
    "uncovered": "SELECT n_name, 10 FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier)",
}


@query(
    "q91_insights",
    "WITH i AS ("
    + " UNION ALL ".join(f"SELECT '{kind}' AS kind, CAST(subject AS VARCHAR) AS subject, CAST(importance AS DOUBLE) AS importance FROM ({sql}) s(subject, importance)" for kind, sql in INSIGHTS.items())
    + ") SELECT kind || ':' || subject AS fingerprint, kind, subject, round(max(importance), 6) AS importance, count(*) AS n FROM i GROUP BY kind, subject",
)
def q91(spark, sf):
    """What ten analyzers find, one row a fingerprint."""
    t = lambda name: table(spark, sf, name)
    orders, events = t("orders"), t("events")
    today = F.lit(TODAY).cast("timestamp_ntz")
    row = lambda df, subject, importance: df.select(F.col(subject).alias("subject"), importance.alias("importance"))
    late = F.least(F.lit(60), F.floor(F.datediff(today, "o_orderdate") / 60))
    loads = t("lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"))
    usual = loads.agg((F.sum("n") / F.count("*") * 1.05).alias("usual"))
    last = events.groupBy("user_id").agg(F.max("ts").alias("last"))
    newest = last.agg(F.max("last").alias("newest"))
    found = review.insights({
        "overdue": lambda: row(orders.where((F.col("o_orderstatus") == "O") & (F.col("o_orderdate") < F.date_sub(today, 365).cast("timestamp_ntz"))), "o_custkey", 40 + late),
        "stalled": lambda: row(orders.where("o_orderstatus = 'P' AND o_totalprice > 300000"), "o_orderkey", F.lit(50)),
        "large": lambda: row(orders.where("o_totalprice > 400000"), "o_custkey", F.col("o_totalprice") / 10000),
        "idle": lambda: row(t("customer").join(orders.select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti"), "c_custkey", F.lit(30)),
        "in_debt": lambda: row(t("customer").where("c_acctbal < 0"), "c_custkey", -F.col("c_acctbal") / 100),
        "overloaded": lambda: row(loads.crossJoin(F.broadcast(usual)).where("n > usual"), "l_suppkey", F.col("n")),  # one row
        "errors": lambda: row(events.where("event_type = 'error'").groupBy("user_id").agg(F.count("*").alias("n")).where("n >= 5"), "user_id", F.col("n")),
        "silent": lambda: row(last.crossJoin(F.broadcast(newest)).where("last < newest - interval 5 days"), "user_id", F.lit(20)),  # one row
        "unlabelled": lambda: row(t("documents").join(t("labels").select("doc_id"), "doc_id", "left_anti").groupBy("source").agg(F.count("*").alias("n")), "source", F.col("n")),
        "uncovered": lambda: row(t("nation").join(t("supplier").select(F.col("s_nationkey").alias("n_nationkey")), "n_nationkey", "left_anti"), "n_name", F.lit(10)),
    })
    return found.withColumn("importance", F.round("importance", 6))


@query(
    "q92_agenda",
    """WITH e AS (SELECT event_id, event_type, value, ts, CAST(timezone('America/New_York', timezone('UTC', ts)) AS DATE) AS day FROM events),
            k AS (SELECT *, CASE WHEN event_type = 'signup' THEN timezone('UTC', timezone('America/New_York', CAST(day AS TIMESTAMP))) ELSE ts END AS start FROM e)
       SELECT event_id, strftime(day, '%Y-%m-%d') AS day, CAST(row_number() OVER (PARTITION BY day ORDER BY start, CASE WHEN event_type = 'signup' THEN 0 ELSE 1 END, value DESC, event_id) AS INTEGER) AS place FROM k""",
)
def q92(spark, sf):
    """Every local day's agenda: all-day items at its midnight, first and by importance, then the rest by time."""
    day = dates.local_day(F.col("ts"), NY)
    items = table(spark, sf, "events").select("event_id", "event_type", "value", F.col("ts").cast("timestamp").alias("ts"), day.alias("day")).withColumn("midnight", dates.day_start(F.col("day"), NY).cast("timestamp"))
    placed = review.day_agenda(items, "day", F.col("ts"), F.col("event_type") == "signup", "value", "event_id")
    return placed.select("event_id", dates.day_key(F.col("day")).alias("day"), "place")


@query(
    "q93_pulse",
    """WITH s AS (SELECT CAST(unnest(generate_series(DATE '2024-01-18', DATE '2024-01-31', INTERVAL 1 DAY)) AS DATE) AS day), d AS (SELECT CAST(ts AS DATE) AS day, count(*) FILTER (event_type = 'error') AS flags, count(*) FILTER (event_type = 'signup') AS calls, count(DISTINCT user_id) AS people FROM events GROUP BY 1)
       SELECT strftime(s.day, '%Y-%m-%d') AS day, coalesce(flags, 0) AS flags, coalesce(calls, 0) AS calls, coalesce(people, 0) AS people FROM s LEFT JOIN d ON d.day = s.day""",
)
def q93(spark, sf):
    """Flags, calls and people of each of fourteen days, quiet ones included."""
    daily = table(spark, sf, "events").groupBy(F.to_date("ts").alias("day")).agg(
        F.count_if(F.col("event_type") == "error").alias("flags"), F.count_if(F.col("event_type") == "signup").alias("calls"), F.countDistinct("user_id").alias("people")
    )
    return series.fill(series.day_spine(spark, "2024-01-31", 14), daily, "day", ["flags", "calls", "people"]).withColumn("day", dates.day_key(F.col("day")))


@query(
    "q94_weekly_review",
    """WITH w AS (SELECT event_type, user_id, value, CASE WHEN ts >= TIMESTAMP '2024-01-22' AND ts < TIMESTAMP '2024-01-29' THEN 'now' WHEN ts >= TIMESTAMP '2024-01-15' AND ts < TIMESTAMP '2024-01-22' THEN 'before' END AS week FROM events),
            u AS (SELECT event_type, user_id, sum(value) AS v FROM w WHERE week = 'now' GROUP BY 1, 2), t AS (SELECT event_type, user_id FROM u QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY round(v, 6) DESC, user_id) = 1)
       SELECT w.event_type AS area, count(*) FILTER (week = 'now') AS n, count(*) FILTER (week = 'before') AS n_before, count(*) FILTER (week = 'now') - count(*) FILTER (week = 'before') AS change, round(sum(value) FILTER (week = 'now'), 4) AS amount, any_value(t.user_id) AS most
       FROM w LEFT JOIN t ON t.event_type = w.event_type WHERE week IS NOT NULL GROUP BY 1""",
)
def q94(spark, sf):
    """This week beside the last by area, and who was in it most."""
    ts = F.col("ts")
    week = F.when((ts >= "2024-01-22") & (ts < "2024-01-29"), "now").when((ts >= "2024-01-15") & (ts < "2024-01-22"), "before")
    rows = table(spark, sf, "events").select("event_type", "user_id", "value", week.alias("week")).where("week IS NOT NULL")
    by_user = rows.groupBy("event_type", "user_id").agg(F.count_if(F.col("week") == "now").alias("n"), F.count_if(F.col("week") == "before").alias("n_before"), F.sum(F.when(F.col("week") == "now", F.col("value"))).alias("v"))
    most = F.max_by("user_id", F.when(F.col("v").isNotNull(), F.struct(F.round("v", 6), -F.col("user_id"))))
    areas = by_user.groupBy(F.col("event_type").alias("area")).agg(F.sum("n").alias("n"), F.sum("n_before").alias("n_before"), F.round(F.sum("v"), 4).alias("amount"), most.alias("most"))
    return areas.select("area", "n", "n_before", (F.col("n") - F.col("n_before")).alias("change"), "amount", "most")


@query(
    "q95_scoreboard",
    """WITH g AS (SELECT * FROM (VALUES ('BUILDING', 40000000.0), ('MACHINERY', 45000000.0), ('HOUSEHOLD', 30000000.0), ('FURNITURE', 90000000.0)) v(segment, target)), a AS (SELECT c_mktsegment AS segment, sum(o_totalprice) AS actual, count(*) AS deals FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'F' GROUP BY 1)
       SELECT g.segment, round(coalesce(actual, 0), 2) AS actual, CAST(target AS DOUBLE) AS target, CAST(floor(coalesce(actual, 0) * 100 / target + 0.5) AS BIGINT) AS pct, CASE WHEN coalesce(actual, 0) >= target THEN 'ahead' WHEN coalesce(actual, 0) >= target * 0.8 THEN 'on_track' WHEN coalesce(actual, 0) >= target * 0.5 THEN 'at_risk' ELSE 'off_track' END AS status, coalesce(deals, 0) AS deals FROM g LEFT JOIN a ON a.segment = g.segment""",
)
def q95(spark, sf):
    """What was reached of each target, and how it stands."""
    goals = spark.createDataFrame([("BUILDING", 4e7), ("MACHINERY", 4.5e7), ("HOUSEHOLD", 3e7), ("FURNITURE", 9e7)], "segment string, target double")
    won = table(spark, sf, "orders").where("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("v"), F.count("*").alias("n"))
    actual = won.join(table(spark, sf, "customer").select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_mktsegment").alias("segment")).agg(F.sum("v").alias("actual"), F.sum("n").alias("deals"))
    board = goals.join(actual, "segment", "left").fillna(0, ["actual", "deals"])
    status = rounding.bands(F.col("actual") / F.col("target"), [(1.0, "ahead"), (0.8, "on_track"), (0.5, "at_risk")], "off_track")
    return board.select("segment", F.round("actual", 2).alias("actual"), "target", rounding.percent(F.col("actual"), F.col("target")).alias("pct"), status.alias("status"), "deals")


@query(
    "q96_risks",
    """WITH e AS (SELECT c_custkey, c_acctbal, coalesce(sum(o_totalprice) FILTER (o_orderstatus = 'O'), 0) AS exposure FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2),
            s AS (SELECT *, CASE WHEN c_acctbal < 0 THEN 5 WHEN c_acctbal < 1000 THEN 3 ELSE 1 END * CASE WHEN exposure > 1000000 THEN 5 WHEN exposure > 300000 THEN 3 ELSE 1 END AS severity FROM e)
       SELECT CASE WHEN severity >= 15 THEN 'critical' WHEN severity >= 9 THEN 'high' WHEN severity >= 5 THEN 'medium' ELSE 'low' END AS band, count(*) AS n, round(sum(exposure), 2) AS exposure, first(c_custkey ORDER BY severity DESC, round(exposure, 4) DESC, c_custkey) AS first_one FROM s GROUP BY 1""",
)
def q96(spark, sf):
    """Risks by band of likelihood times impact, with exposure and the first of each."""
    opened = table(spark, sf, "orders").where("o_orderstatus = 'O'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum("o_totalprice").alias("exposure"))
    each = table(spark, sf, "customer").select("c_custkey", "c_acctbal").join(opened, "c_custkey", "left").fillna(0, ["exposure"])
    likely = F.when(F.col("c_acctbal") < 0, 5).when(F.col("c_acctbal") < 1000, 3).otherwise(1)
    impact = F.when(F.col("exposure") > 1_000_000, 5).when(F.col("exposure") > 300_000, 3).otherwise(1)
    scored = each.withColumn("severity", likely * impact)
    band = rounding.bands(F.col("severity"), [(15, "critical"), (9, "high"), (5, "medium")], "low")
    first = F.max_by("c_custkey", F.struct("severity", F.round("exposure", 4), -F.col("c_custkey")))
    return scored.groupBy(band.alias("band")).agg(F.count("*").alias("n"), F.round(F.sum("exposure"), 2).alias("exposure"), first.alias("first_one"))


BOARDS = {
    "orders": {"open": "o_orderstatus = 'O'", "won": "o_orderstatus = 'F'", "urgent": "o_orderpriority = '1-URGENT'", "all": "true"},
    "lineitem": {"returned": "l_returnflag = 'R'", "late": "l_linestatus = 'O'", "discounted": "l_discount > 0.05", "all": "true"},
    "documents": {"english": "lang = 'en'", "long": "n_chars > 5000", "unsourced": "source IS NULL", "all": "true"},
    "events": {"errors": "event_type = 'error'", "large": "value > 90", "all": "true"},
    "conversations": {"asked": "role = 'user'", "answered": "role = 'assistant'", "all": "true"},
}


@query("q97_board_counts", " UNION ALL ".join(f"SELECT '{t}' AS board, '{v}' AS view, count(*) FILTER ({p}) AS n FROM {t}" for t, views in BOARDS.items() for v, p in views.items()))
def q97(spark, sf):
    """How many rows each view of each board has, one scan a board."""
    every = None
    for name, views in BOARDS.items():
        counted = table(spark, sf, name).agg(*(F.count_if(F.expr(p)).alias(v) for v, p in views.items())).unpivot([], list(views), "view", "n").select(F.lit(name).alias("board"), "view", "n")
        every = counted if every is None else every.unionByName(counted)
    return every


@query(
    "q98_access_rules",
    """WITH u AS (SELECT s_suppkey, s_nationkey, CASE WHEN s_suppkey % 7 = 0 THEN 'OWNER' WHEN s_suppkey % 3 = 0 THEN 'ADMIN' ELSE 'MEMBER' END AS role FROM supplier)
       SELECT s_suppkey, role, count(*) FILTER (role = 'OWNER') OVER (PARTITION BY s_nationkey) AS keepers, role <> 'OWNER' OR count(*) FILTER (role = 'OWNER') OVER (PARTITION BY s_nationkey) > 1 AS may_change FROM u""",
)
def q98(spark, sf):
    """Whose role may change: the last owner of a group keeps it."""
    role = F.when(F.col("s_suppkey") % 7 == 0, "OWNER").when(F.col("s_suppkey") % 3 == 0, "ADMIN").otherwise("MEMBER")
    users = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey", role.alias("role"))
    return review.may_lose_role(users, "s_nationkey", "role", "OWNER").select("s_suppkey", "role", "keepers", "may_change")


@query(
    "q99_scoring_defaults",
    f"""SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 5 WHEN o_totalprice > 100000 THEN 4 WHEN o_totalprice > 20000 THEN 3 ELSE 2 END AS impact,
              CASE WHEN o_orderpriority = '1-URGENT' THEN 'P0' WHEN o_orderpriority = '2-HIGH' OR CAST(o_orderdate AS DATE) + 60 BETWEEN DATE '{TODAY}' AND DATE '{TODAY}' + 3 THEN 'P1' WHEN o_orderstatus = 'F' THEN 'P3' ELSE 'P2' END AS priority,
              CASE WHEN o_totalprice > 300000 THEN 120 WHEN o_totalprice > 100000 THEN 60 ELSE 30 END AS minutes FROM orders""",
)
def q99(spark, sf):
    """A new task's impact, priority and minutes, from what is known of it."""
    price = F.col("o_totalprice")
    due = F.date_add(F.to_date("o_orderdate"), 60)
    soon = due.between(F.lit(TODAY).cast("date"), F.date_add(F.lit(TODAY).cast("date"), 3))
    priority = F.when(F.col("o_orderpriority") == "1-URGENT", "P0").when((F.col("o_orderpriority") == "2-HIGH") | soon, "P1").when(F.col("o_orderstatus") == "F", "P3").otherwise("P2")
    impact = F.when(price > 300_000, 5).when(price > 100_000, 4).when(price > 20_000, 3).otherwise(2)
    minutes = F.when(price > 300_000, 120).when(price > 100_000, 60).otherwise(30)
    return table(spark, sf, "orders").select("o_orderkey", impact.alias("impact"), priority.alias("priority"), minutes.alias("minutes"))


@query(
    "q100_source_precedence",
    """WITH f AS (SELECT date_trunc('month', o_orderdate) AS month, CASE WHEN o_orderkey % 3 = 0 THEN 'bank' WHEN o_orderkey % 3 = 1 THEN 'books' ELSE 'manual' END AS source, o_totalprice FROM orders WHERE NOT (o_orderkey % 3 = 0 AND month(o_orderdate) % 2 = 0)),
            s AS (SELECT month, source, sum(o_totalprice) AS amount FROM f GROUP BY 1, 2)
       SELECT strftime(month, '%Y-%m') AS month, source, round(amount, 2) AS amount FROM s QUALIFY row_number() OVER (PARTITION BY month ORDER BY CASE source WHEN 'bank' THEN 0 WHEN 'books' THEN 1 ELSE 2 END) = 1""",
)
def q100(spark, sf):
    """Each month's figure from the best source that has one: bank feed, then books, then by hand."""
    k = F.col("o_orderkey") % 3
    rows = table(spark, sf, "orders").select(F.trunc("o_orderdate", "MONTH").alias("month"), F.month("o_orderdate").alias("m"), F.when(k == 0, "bank").when(k == 1, "books").otherwise("manual").alias("source"), "o_totalprice")
    sums = rows.where(~((F.col("source") == "bank") & (F.col("m") % 2 == 0))).groupBy("month", "source").agg(F.sum("o_totalprice").alias("amount"))
    best = review.by_precedence(sums, ["month"], "source", ["bank", "books"], ["amount"])
    return best.select(F.date_format("month", "yyyy-MM").alias("month"), "source", F.round("amount", 2).alias("amount"))


@query(
    "q101_computed_sorts",
    """WITH g AS (SELECT user_id, avg(value) AS v, count(*) AS n FROM events GROUP BY 1)
       SELECT user_id, CAST(row_number() OVER (ORDER BY round(abs(v - 50), 6) DESC, user_id) AS INTEGER) AS by_gap, CAST(row_number() OVER (ORDER BY round(v * n, 6) DESC, user_id) AS INTEGER) AS by_impact FROM g ORDER BY by_gap LIMIT 25""",
)
def q101(spark, sf):
    """The 25 users farthest from the usual value, with their places by gap and by impact."""
    each = table(spark, sf, "events").groupBy("user_id").agg(F.avg("value").alias("v"), F.count("*").alias("n"))
    keyed = each.select("user_id", F.round(F.abs(F.col("v") - 50), 6).alias("gap"), F.round(F.col("v") * F.col("n"), 6).alias("impact"))
    by_impact = ranking.numbered(keyed, [], [F.desc("impact"), F.asc("user_id")], "by_impact")
    first = by_impact.orderBy(F.desc("gap"), "user_id").limit(25)
    return first.select("user_id", F.row_number().over(Window.orderBy(F.desc("gap"), "user_id")).alias("by_gap"), "by_impact")


@query(
    "q102_urgency_sort",
    """WITH c AS (SELECT o_orderkey, CASE WHEN o_orderstatus <> 'F' THEN CAST(o_orderdate AS DATE) + 60 END AS due, o_orderdate FROM orders)
       SELECT o_orderkey, CAST(row_number() OVER (ORDER BY due ASC NULLS LAST, o_orderdate, o_orderkey) AS INTEGER) AS place FROM c ORDER BY place LIMIT 50""",
)
def q102(spark, sf):
    """Promises by due date, undated ones last, then by when they were made."""
    due = F.when(F.col("o_orderstatus") != "F", F.date_add(F.to_date("o_orderdate"), 60))
    order = [F.asc_nulls_last("due"), F.asc("o_orderdate"), F.asc("o_orderkey")]
    first = table(spark, sf, "orders").select("o_orderkey", due.alias("due"), "o_orderdate").orderBy(*order).limit(50)
    return first.select("o_orderkey", F.row_number().over(Window.orderBy(*order)).alias("place"))


@query(
    "q103_snapshots",
    """WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, sum(value) AS v FROM events GROUP BY 1, 2)
       SELECT user_id, strftime(day, '%Y-%m-%d') AS day, round(CASE WHEN day = DATE '2024-01-10' THEN v * 2 ELSE v END, 4) AS v FROM d WHERE day <> DATE '2024-01-11'""",
)
def q103(spark, sf):
    """Daily values after one day's were taken again and another day's were refreshed to nothing; taking them twice changes nothing."""
    daily = table(spark, sf, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.sum("value").alias("v"))
    again = daily.where("day = '2024-01-10'").withColumn("v", F.col("v") * 2)
    once = review.snapshot(again, daily, ["user_id"], "day")
    twice = review.snapshot(again, once, ["user_id"], "day")
    kept = review.refreshed(twice.where("day <> '2024-01-11'"), twice.where("day = '2024-01-12'"), "day")
    return kept.select("user_id", dates.day_key(F.col("day")).alias("day"), F.round("v", 4).alias("v"))
