"""Scores, allocations, period comparisons, metrics, finance and retention over the driver tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import rounding, scoring, text
from tidemark.operators import groups, percentiles, series
from tidemark.plans.registry import query, table

TODAY = "2001-08-01"


#: A task's fields, derived from an order and the number of its lines, as SQL that both engines read.
TASK = {
    "strategic": "6 - CAST(left(o_orderpriority, 1) AS INT)", "revenue": "o_totalprice / 100000", "fundraising": "o_custkey % 6", "customer": "o_orderkey % 4", "scientific": "o_orderkey % 7",
    "risk": "n - 2", "uniqueness": "o_orderkey % 6", "opportunity": "o_custkey % 4", "blocks": "n % 4", "hard": "o_orderkey % 3 = 0", "postponed": "o_orderkey % 5",
    "due_days": "CASE WHEN o_orderkey % 8 > 0 THEN o_custkey % 50 - 10 END", "milestone_days": "CASE WHEN o_orderkey % 2 = 0 THEN o_custkey % 45 END", "milestone_status": "CASE WHEN o_orderkey % 2 = 0 THEN CASE WHEN o_custkey % 3 = 0 THEN 'AT_RISK' ELSE 'ON_TRACK' END END",
    "priority": "concat('P', CAST(o_custkey % 4 AS VARCHAR(1)))", "goal_status": "CASE WHEN o_custkey % 5 = 0 THEN 'OFF_TRACK' WHEN o_custkey % 5 < 3 THEN 'ON_TRACK' END", "status": "CASE o_orderstatus WHEN 'P' THEN 'WAITING' WHEN 'F' THEN 'BLOCKED' ELSE 'OPEN' END",
}


def priority_sql() -> str:
    five = lambda x: f"greatest(0.0::DOUBLE, least(5.0::DOUBLE, ({x})::DOUBLE))"
    days = "least(due_days, milestone_days + 7)"
    factor = {k: five(k) for k in ("strategic", "revenue", "fundraising", "customer", "scientific", "risk", "uniqueness", "opportunity")}
    factor["urgency"] = f"CASE WHEN {days} IS NULL THEN 0.5 WHEN {days} <= 0 THEN 5 WHEN {days} <= 1 THEN 4.5 WHEN {days} <= 3 THEN 4 WHEN {days} <= 7 THEN 3 WHEN {days} <= 14 THEN 2 WHEN {days} <= 30 THEN 1 ELSE 0.5 END"
    factor["dependency"] = five("blocks * 1.5 + CASE WHEN milestone_days <= 14 THEN 2 WHEN milestone_days <= 30 THEN 1 ELSE 0 END + CASE WHEN milestone_status IN ('AT_RISK', 'BLOCKED') THEN 1 ELSE 0 END")
    factor["deadline"] = "CASE WHEN hard THEN 5 WHEN due_days IS NOT NULL THEN 2 ELSE 0 END"
    points = {k: f"floor(({factor[k]})::DOUBLE * {float(w)}::DOUBLE / 5 * 10 + 0.5) / 10" for k, w in scoring.PRIORITY_WEIGHTS.items()}
    times = """CASE priority WHEN 'P0' THEN 1.1::DOUBLE WHEN 'P1' THEN 1.04::DOUBLE WHEN 'P3' THEN 0.85::DOUBLE ELSE 1 END * CASE WHEN goal_status IN ('AT_RISK', 'OFF_TRACK') THEN 1.05::DOUBLE ELSE 1 END
        * CASE WHEN uniqueness <= 2 THEN 0.85::DOUBLE ELSE 1 END * CASE status WHEN 'BLOCKED' THEN 0.93::DOUBLE WHEN 'WAITING' THEN 0.8::DOUBLE ELSE 1 END"""
    return f"""WITH l AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1), o AS (SELECT orders.*, coalesce(n, 0) AS n FROM orders LEFT JOIN l ON l_orderkey = o_orderkey),
        t AS (SELECT o_orderkey, {", ".join(f"{v} AS {k}" for k, v in TASK.items())} FROM o), p AS (SELECT *, {", ".join(f"{v} AS {k}_points" for k, v in points.items())} FROM t)
        SELECT o_orderkey, {", ".join(f"{k}_points" for k in points)}, greatest(0, least(100, floor((({" + ".join(f"{k}_points" for k in points)}) * {times} + CASE WHEN postponed >= 3 THEN 3 ELSE 0 END) * 10 + 0.5) / 10)) AS score FROM p"""


@query("q37_priority_score", priority_sql())
def q37(spark, sf):
    """A task's score: factors rounded one by one, multipliers in their order, points for slippage last."""
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    orders = table(spark, sf, "orders")
    base = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").withColumn("n", F.coalesce("n", F.lit(0)))
    tasks = base.select("o_orderkey", *(F.expr(v).alias(k) for k, v in TASK.items()))
    t = {k: F.col(k) for k in TASK}
    scored = scoring.priority_score(scoring.priority_factors(t), t)
    return tasks.select("o_orderkey", *(v.alias(k) for k, v in scored.items()))


@query(
    "q37b_attention_levels",
    """WITH i AS (SELECT event_id, value, user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_type FROM events),
       s AS (SELECT *, greatest(0, least(100, floor(14 * greatest(least(1.0::DOUBLE, value / 100), CASE WHEN k % 3 = 0 THEN 0.6::DOUBLE ELSE 0.3::DOUBLE END) + 9 * CASE WHEN value * 20000 >= 5000000 THEN 1 WHEN value * 20000 >= 1000000 THEN 0.9::DOUBLE WHEN value * 20000 >= 300000 THEN 0.75::DOUBLE WHEN value * 20000 >= 100000 THEN 0.5::DOUBLE WHEN value * 20000 >= 1e-9 THEN 0.3::DOUBLE ELSE 0 END
             + 8 * CASE WHEN k % 4 = 0 THEN least(1.0::DOUBLE, 0.5::DOUBLE + 0.1::DOUBLE * (user_id % 6)) ELSE 0 END + 9 * ((k % 6) / 5.0::DOUBLE) + 13 * CASE WHEN user_id % 20 <= 0 THEN 1.0::DOUBLE WHEN user_id % 20 <= 1 THEN 0.9::DOUBLE WHEN user_id % 20 <= 2 THEN 0.8::DOUBLE WHEN user_id % 20 <= 7 THEN 0.6::DOUBLE WHEN user_id % 20 <= 14 THEN 0.35::DOUBLE ELSE 0.1::DOUBLE END
             + 10 * CASE WHEN event_type = 'error' THEN 1 ELSE 0 END + CASE WHEN k % 7 = 0 THEN 5 ELSE 0 END + 0.5::DOUBLE))) AS score FROM i)
       SELECT event_id, CAST(score AS BIGINT) AS score, CASE WHEN score >= 66 THEN 'IMMEDIATE' WHEN score >= 50 OR (event_type = 'error' AND (k % 4 = 0 OR k % 3 = 0) AND user_id % 20 <= 3) OR (k % 6 >= 4 AND (k % 4 = 0 OR k % 3 = 0)) THEN 'TODAY'
             WHEN score >= 35 OR (event_type = 'error' AND user_id % 20 <= 7) THEN 'THIS_WEEK' WHEN score >= 18 THEN 'MONITOR' ELSE 'ARCHIVE' END AS level FROM s""",
)
def q37b(spark, sf):
    """How much attention an incoming item deserves, and when."""
    k = F.get_json_object("props", "$.k").cast("long")
    events = table(spark, sf, "events").withColumn("k", k)
    no, none = F.lit(False), F.lit(None)
    score = scoring.attention_score({
        "noise": no, "relevance": F.when(F.col("k") % 7 == 0, "HIGH").otherwise("MEDIUM"), "category": F.when(F.col("k") % 3 == 0, "LEGAL").otherwise("OTHER"),
        "company_type": F.when(F.col("k") % 4 == 0, "CUSTOMER").otherwise("VENDOR"), "company_relationship": F.col("user_id") % 6, "strategic_score": F.col("value") / 100,
        "revenue": F.col("value") * 20000, "fundraising": no, "fundraising_value": none.cast("double"), "risk_severity": F.col("k") % 6, "days_to_due": F.col("user_id") % 20,
        "hard": no, "deal_owner": no, "sole_recipient": no, "replied_before": no, "legal": no, "scientific": no, "opportunity_value": none.cast("double"),
        "asked": F.col("event_type") == "error", "owes_due_soon": no, "urgent_action": no, "decision_needed": no, "team_owned": no, "wrote": no,
        "change_importance": none.cast("int"), "change_soon": no,
    })
    return events.select("event_id", *(v.alias(n) for n, v in score.items()))


@query(
    "q38_attention",
    """WITH t AS (SELECT * FROM (VALUES ('click', 40.0), ('purchase', 5.0), ('view', 20.0), ('signup', 25.0), ('error', 10.0)) v(event_type, target)),
       m AS (SELECT event_type, sum(value) AS minutes FROM events WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-08' AND DATE '2024-01-21' GROUP BY 1),
       s AS (SELECT t.event_type, target, coalesce(minutes, 0) AS minutes, coalesce(minutes, 0) * 100 / (SELECT sum(minutes) FROM m) AS pct FROM t LEFT JOIN m ON m.event_type = t.event_type)
       SELECT event_type, target, round(minutes, 2) AS minutes, round(pct, 4) AS pct, CASE WHEN target >= 3 AND pct - target <= -3 AND pct < target * 0.6 THEN 'under' WHEN pct - target >= 4 AND pct > target * 1.4 THEN 'over' ELSE 'ok' END AS flag FROM s""",
)
def q38(spark, sf):
    """Shares of time by area against targets; a flag needs a relative and an absolute gap. Both days of the window count."""
    targets = spark.createDataFrame([("click", 40.0), ("purchase", 5.0), ("view", 20.0), ("signup", 25.0), ("error", 10.0)], "event_type string, target double")
    spent = table(spark, sf, "events").where(F.to_date("ts").between("2024-01-08", "2024-01-21")).groupBy("event_type").agg(F.sum("value").alias("minutes"))
    share = targets.join(spent, "event_type", "left").withColumn("minutes", F.coalesce("minutes", F.lit(0.0)))
    share = share.withColumn("pct", F.col("minutes") * 100 / F.sum("minutes").over(Window.partitionBy()))  # a row for each target
    gap = F.col("pct") - F.col("target")
    under = (F.col("target") >= 3) & (gap <= -3) & (F.col("pct") < F.col("target") * 0.6)
    over = (gap >= 4) & (F.col("pct") > F.col("target") * 1.4)
    return share.select("event_type", "target", F.round("minutes", 2).alias("minutes"), F.round("pct", 4).alias("pct"), F.when(under, "under").when(over, "over").otherwise("ok").alias("flag"))


@query(
    "q39_metric_view",
    """WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, sum(value) AS v FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY day DESC) AS k, lag(v) OVER (PARTITION BY user_id ORDER BY day) AS p FROM d)
       SELECT user_id, round(v, 4) AS current, round(p, 4) AS previous, round((v - p) / nullif(abs(p), 0), 4) AS change, CAST(floor(least(100, greatest(0, v / 200 * 100)) + 0.5) AS BIGINT) AS target_progress FROM r WHERE k = 1""",
)
def q39(spark, sf):
    """Each metric's current and previous daily value, change and progress towards a target of 200."""
    # A day's values are added up in the order of the table, as the SQL does it: halves are rounded by the sum's last digit.
    daily = series.ordered_sum(table(spark, sf, "events").select("user_id", F.to_date("ts").alias("day"), F.col("value").alias("v"), "event_id"), ["user_id", "day"], "v", "event_id")
    along = F.asc_nulls_last("day")
    points = daily.withColumn("p", F.lag("v").over(Window.partitionBy("user_id").orderBy(along))).withColumn("change", series.change_from_previous(F.col("v"), [along], ["user_id"]))
    progress = F.floor(rounding.clamp(F.col("v") / 200 * 100, 0.0, 100.0) + 0.5)
    current = groups.top_per_group(points, ["user_id"], [F.desc("day")])
    return current.select("user_id", *(rounding.half_away(F.col(c), 4).alias(name) for c, name in (("v", "current"), ("p", "previous"), ("change", "change"))), progress.alias("target_progress"))


MONTHLY = """m AS (SELECT date_trunc('month', o_orderdate) AS month, sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE 0 END) AS paid, sum(CASE WHEN o_orderstatus <> 'F' THEN o_totalprice ELSE 0 END) AS spent FROM orders WHERE o_orderdate >= TIMESTAMP '1999-01-01' AND o_orderdate < TIMESTAMP '2001-08-01' GROUP BY 1)"""


def monthly(spark, sf, first="1999-01-01", last="2001-08-01"):
    orders = table(spark, sf, "orders").where((F.col("o_orderdate") >= first) & (F.col("o_orderdate") < last))
    won = F.col("o_orderstatus") == "F"
    by_month = orders.groupBy(F.trunc("o_orderdate", "MONTH").alias("month")).agg(
        F.sum(F.when(won, F.col("o_totalprice")).otherwise(0.0)).alias("paid"), F.sum(F.when(~won, F.col("o_totalprice")).otherwise(0.0)).alias("spent")
    )
    return series.fill(series.month_spine(spark, first, last), by_month, "month", ["paid", "spent"])


@query(
    "q40_runway",
    f"""WITH {MONTHLY}, l AS (SELECT *, greatest(0, spent - paid) AS burn, row_number() OVER (ORDER BY month DESC) AS k FROM m)
        SELECT round(any_value(b.cash), 2) AS cash, round(avg(burn), 2) AS burn, CASE WHEN avg(burn) > 0 THEN floor(any_value(b.cash) / avg(burn) * 10 + 0.5) / 10 END AS months
        FROM l, (SELECT sum(c_acctbal) AS cash FROM customer) b WHERE k <= 3""",
)
def q40(spark, sf):
    """Months of cash left at the mean burn of the last three months; none without burn."""
    last = monthly(spark, sf).withColumn("burn", F.greatest(F.lit(0.0), F.col("spent") - F.col("paid"))).orderBy(F.desc("month")).limit(3)
    burn = last.agg(F.avg("burn").alias("burn"))
    cash = table(spark, sf, "customer").agg(F.sum("c_acctbal").alias("cash"))
    months = F.when(F.col("burn") > 0, rounding.half_up(F.col("cash") / F.col("burn"), 1))
    return cash.crossJoin(burn).select(F.round("cash", 2).alias("cash"), F.round("burn", 2).alias("burn"), months.alias("months"))  # a row each


@query(
    "q41_period_compare",
    """WITH p AS (SELECT CASE WHEN o_orderdate >= TIMESTAMP '2001-08-01' - INTERVAL 90 DAY THEN 'now' ELSE 'before' END AS period, * FROM orders WHERE o_orderdate >= TIMESTAMP '2001-08-01' - INTERVAL 180 DAY AND o_orderdate < TIMESTAMP '2001-08-01')
       SELECT count(*) FILTER (period = 'now') AS orders, count(*) FILTER (period = 'before') AS orders_before, round(sum(o_totalprice) FILTER (period = 'now'), 2) AS amount, round(sum(o_totalprice) FILTER (period = 'before'), 2) AS amount_before,
              count(DISTINCT o_custkey) FILTER (period = 'now') AS buyers, count(DISTINCT o_custkey) FILTER (period = 'before') AS buyers_before, round(median(o_totalprice) FILTER (period = 'now'), 2) AS mid, round(median(o_totalprice) FILTER (period = 'before'), 2) AS mid_before,
              CAST(floor(count(*) FILTER (period = 'now' AND o_orderstatus = 'F') * 100 / nullif(count(*) FILTER (period = 'now'), 0) + 0.5) AS BIGINT) AS won_pct,
              count(*) FILTER (period = 'now') - count(*) FILTER (period = 'before') AS change FROM p""",
)
def q41(spark, sf):
    """This period's figures beside those of the one before, in one pass over both."""
    start, middle = "timestamp'2001-08-01' - interval 180 days", "timestamp'2001-08-01' - interval 90 days"
    orders = table(spark, sf, "orders").where(F.expr(f"o_orderdate >= {start} AND o_orderdate < timestamp'2001-08-01'")).withColumn("now", F.expr(f"o_orderdate >= {middle}"))
    now, before = F.col("now"), ~F.col("now")
    of = lambda c, p: F.when(p, F.col(c))
    mids = percentiles.exact_percentiles(orders, ["now"], F.col("o_totalprice"), {"mid": 0.5})
    mid = mids.agg(F.round(F.max(of("mid", now)), 2).alias("mid"), F.round(F.max(of("mid", before)), 2).alias("mid_before"))
    figures = orders.agg(
        F.count_if(now).alias("orders"), F.count_if(before).alias("orders_before"),
        F.round(F.sum(of("o_totalprice", now)), 2).alias("amount"), F.round(F.sum(of("o_totalprice", before)), 2).alias("amount_before"),
        F.countDistinct(of("o_custkey", now)).alias("buyers"), F.countDistinct(of("o_custkey", before)).alias("buyers_before"),
        rounding.percent(F.count_if(now & (F.col("o_orderstatus") == "F")), F.count_if(now)).alias("won_pct"),
        (F.count_if(now) - F.count_if(before)).alias("change"),
    )
    return figures.crossJoin(mid)  # a row each


@query(
    "q42_kept_late_overdue",
    """WITH c AS (SELECT o_orderpriority AS priority, CASE WHEN l_linestatus = 'F' AND l_shipdate <= o_orderdate + INTERVAL 60 DAY THEN 'kept' WHEN l_linestatus = 'F' THEN 'late' WHEN o_orderdate + INTERVAL 60 DAY < TIMESTAMP '2001-08-01' THEN 'overdue' ELSE 'open' END AS state
              FROM orders JOIN lineitem ON l_orderkey = o_orderkey)
       SELECT priority, count(*) FILTER (state = 'kept') AS kept, count(*) FILTER (state = 'late') AS late, count(*) FILTER (state = 'overdue') AS overdue, count(*) FILTER (state = 'open') AS still_open,
              CAST(floor(count(*) FILTER (state = 'kept') * 100 / nullif(count(*) FILTER (state <> 'open'), 0) + 0.5) AS BIGINT) AS rate FROM c GROUP BY 1""",
)
def q42(spark, sf):
    """Promises kept, late and overdue, and the rate over those that can be judged."""
    due = F.expr("o_orderdate + interval 60 days")
    done = F.col("l_linestatus") == "F"
    state = F.when(done & (F.col("l_shipdate") <= due), "kept").when(done, "late").when(due < F.lit(TODAY).cast("timestamp_ntz"), "overdue").otherwise("open")
    both = table(spark, sf, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority").join(table(spark, sf, "lineitem").select("l_orderkey", "l_linestatus", "l_shipdate"), F.col("o_orderkey") == F.col("l_orderkey"))
    n = lambda s: F.count_if(F.col("state") == s)
    return both.withColumn("state", state).groupBy(F.col("o_orderpriority").alias("priority")).agg(
        n("kept").alias("kept"), n("late").alias("late"), n("overdue").alias("overdue"), n("open").alias("still_open"), rounding.percent(n("kept"), F.count_if(F.col("state") != "open")).alias("rate")
    )


@query(
    "q43_stage_rollup_names",
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders)
       SELECT o_orderstatus AS stage, count(*) AS n, round(sum(o_totalprice), 2) AS amount, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY k) FILTER (k <= 20) AS names FROM r GROUP BY 1""",
)
def q43(spark, sf):
    """Count and sum of each stage, and the names of its twenty largest."""
    orders = table(spark, sf, "orders").select(F.col("o_orderstatus").alias("stage"), "o_orderkey", "o_totalprice")
    totals = orders.groupBy("stage").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("amount"))
    top = groups.top_per_group(orders, ["stage"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 20, "place")
    listed = top.groupBy("stage").agg(F.array_sort(F.collect_list(F.struct("place", "o_orderkey"))).alias("top"))
    return totals.join(listed, "stage").select("stage", "n", "amount", F.array_join(F.transform("top", lambda t: t["o_orderkey"].cast("string")), ",").alias("names"))


@query(
    "q44_monthly_cashflow",
    """WITH s AS (SELECT CAST(unnest(generate_series(DATE '1994-10-01', DATE '2001-07-01', INTERVAL 1 MONTH)) AS DATE) AS month),
       m AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE 0 END) AS paid, sum(CASE WHEN o_orderstatus <> 'F' THEN o_totalprice ELSE 0 END) AS spent FROM orders GROUP BY 1)
       SELECT strftime(s.month, '%Y-%m') AS month, round(coalesce(paid, 0), 2) AS paid, round(coalesce(spent, 0), 2) AS spent, round(greatest(0, coalesce(spent, 0) - coalesce(paid, 0)), 2) AS net_burn FROM s LEFT JOIN m ON m.month = s.month""",
)
def q44(spark, sf):
    """Money in, out and burnt in every month, empty months included."""
    flows = monthly(spark, sf, "1994-10-01", "2001-08-01")
    return flows.select(
        F.date_format("month", "yyyy-MM").alias("month"), F.round("paid", 2).alias("paid"), F.round("spent", 2).alias("spent"), F.round(F.greatest(F.lit(0.0), F.col("spent") - F.col("paid")), 2).alias("net_burn")
    )


@query(
    "q45_trailing_ttm_burn",
    f"""WITH {MONTHLY}, w AS (SELECT month, sum(paid) OVER (ORDER BY month ROWS 11 PRECEDING) AS ttm, avg(greatest(0, spent - paid)) OVER (ORDER BY month ROWS 2 PRECEDING) AS burn, count(*) OVER (ORDER BY month ROWS 2 PRECEDING) AS n, row_number() OVER (ORDER BY month DESC) AS k FROM m)
        SELECT strftime(month, '%Y-%m') AS month, round(ttm, 2) AS ttm, CASE WHEN n = 3 OR k = 1 THEN round(burn, 2) END AS burn FROM w""",
)
def q45(spark, sf):
    """Twelve-month revenue and three-month burn; burn only for full frames, but always for the latest month."""
    flows = monthly(spark, sf)
    year = Window.orderBy("month").rowsBetween(-11, 0)  # a row for each month
    burn = series.trailing(F.greatest(F.lit(0.0), F.col("spent") - F.col("paid")), 3, F.col("month"), full_only=True)
    return flows.select(F.date_format("month", "yyyy-MM").alias("month"), F.round(F.sum("paid").over(year), 2).alias("ttm"), F.round(burn, 2).alias("burn"))


RETENTION = {
    "email_content": "n_chars > 2000 AND source IN ('src1', 'src2')", "attachments": "source = 'src3'", "document_text": "n_chars > 10000", "extractions": "lang <> 'en' AND doc_id % 7 = 0",
    "deleted_upstream": "doc_id % 97 = 0", "noise": "n_chars < 200", "foreign": "lang IN ('de', 'fr', 'es')", "long_tail": "doc_id % 100 > 90 AND n_chars > 500", "unsourced": "source IS NULL", "everything": "true",
}


@query("q46_retention_preview", "SELECT " + ", ".join(f"count(*) FILTER ({p}) AS {k}" for k, p in RETENTION.items()) + " FROM documents")
def q46(spark, sf):
    """How many rows each retention rule would touch, in one pass."""
    return table(spark, sf, "documents").agg(*(F.count_if(F.expr(p)).alias(k) for k, p in RETENTION.items()))


@query(
    "q46b_retention_sweep",
    """SELECT doc_id, CASE WHEN doc_id % 97 = 0 THEN 'deleted' WHEN n_chars > 10000 THEN 'text_purged' WHEN n_chars < 200 THEN 'noise_purged' ELSE 'kept' END AS verdict,
              CASE WHEN doc_id % 97 = 0 OR n_chars > 10000 OR n_chars < 200 THEN 0 ELSE length(text) END AS left_chars FROM documents""",
)
def q46b(spark, sf):
    """The verdict ladder, first rule wins, with purged texts set to null."""
    verdict = F.when(F.col("doc_id") % 97 == 0, "deleted").when(F.col("n_chars") > 10000, "text_purged").when(F.col("n_chars") < 200, "noise_purged").otherwise("kept")
    swept = table(spark, sf, "documents").withColumn("verdict", verdict).withColumn("text", F.when(F.col("verdict") == "kept", F.col("text")))
    return swept.select("doc_id", "verdict", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("left_chars"))


@query(
    "q46c_weighted_pipeline",
    """SELECT c_mktsegment AS segment, round(sum(o_totalprice * p / 100), 4) AS weighted, round(sum(CASE WHEN o_orderstatus = 'F' OR (o_orderstatus = 'O' AND p >= 90) THEN o_totalprice ELSE 0 END), 2) AS committed
       FROM (SELECT *, CASE o_orderstatus WHEN 'F' THEN 100 WHEN 'P' THEN 50 ELSE 10 + 20 * CAST(left(o_orderpriority, 1) AS INT) END AS p FROM orders) JOIN customer ON o_custkey = c_custkey GROUP BY 1""",
)
def q46c(spark, sf):
    """Value weighted by probability, and what is won or as good as won."""
    p = F.when(F.col("o_orderstatus") == "F", 100).when(F.col("o_orderstatus") == "P", 50).otherwise(10 + 20 * F.substring("o_orderpriority", 1, 1).cast("int"))
    deals = table(spark, sf, "orders").select("o_custkey", "o_orderstatus", "o_totalprice", p.alias("p")).join(table(spark, sf, "customer").select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    sure = (F.col("o_orderstatus") == "F") | ((F.col("o_orderstatus") == "O") & (F.col("p") >= 90))
    return deals.groupBy(F.col("c_mktsegment").alias("segment")).agg(F.round(F.sum(F.col("o_totalprice") * F.col("p") / 100), 4).alias("weighted"), F.round(F.sum(F.when(sure, F.col("o_totalprice")).otherwise(0.0)), 2).alias("committed"))


@query(
    "q46d_visible_total_hidden",
    """SELECT o_custkey, count(*) FILTER (o_totalprice < 200000) AS visible, count(*) AS total, count(*) - count(*) FILTER (o_totalprice < 200000) AS hidden FROM orders GROUP BY 1""",
)
def q46d(spark, sf):
    """Of each target's sources, how many a reader sees and how many not."""
    visible = F.count_if(F.col("o_totalprice") < 200000)
    return table(spark, sf, "orders").groupBy("o_custkey").agg(visible.alias("visible"), F.count("*").alias("total"), (F.count("*") - visible).alias("hidden"))


@query(
    "q46e_first_from_last_to",
    "SELECT user_id, first(event_type ORDER BY ts, event_id) AS first_type, last(event_type ORDER BY ts, event_id) AS last_type, count(*) AS moves FROM events GROUP BY 1",
)
def q46e(spark, sf):
    """Where each thread began and ended, and in how many moves; of moves at one instant the id decides."""
    at = F.struct("ts", "event_id")
    return table(spark, sf, "events").groupBy("user_id").agg(F.min_by("event_type", at).alias("first_type"), F.max_by("event_type", at).alias("last_type"), F.count("*").alias("moves"))


@query(
    "q46f_brief_sections",
    """SELECT o_orderstatus AS section, o_orderkey, CAST(k AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate >= TIMESTAMP '2001-07-01' DESC, o_totalprice DESC, o_orderkey) AS k FROM orders) WHERE k <= 6""",
)
def q46f(spark, sf):
    """At most six items a section, new ones first, then by importance."""
    fresh = F.col("o_orderdate") >= "2001-07-01"
    picked = groups.top_per_group(table(spark, sf, "orders"), ["o_orderstatus"], [fresh.desc(), F.desc("o_totalprice"), F.asc("o_orderkey")], 6, "place")
    return picked.select(F.col("o_orderstatus").alias("section"), "o_orderkey", "place")


SIGNAL_TEXTS = [
    ("This delay is unacceptable, please confirm", "escalation"), ("Waiting for your approval of the decision", "approval_request"), ("The candidate can start by Monday", "hiring_decision"), ("They want to see the data room", "investor_request"),
    ("Is it go/no-go? We will know soon", "decision_request"), ("I'll send it", "commitment"), ("Let me know about the risk", "response_needed"), ("Churned accounts", "risk"), ("An opportunity to grow", "opportunity"), ("Nothing of note, offered freely", "development"),
]


@query(
    "q46g_signal_classifier",
    "SELECT o_orderkey, CASE o_orderkey % 10 " + " ".join(f"WHEN {k} THEN '{kind}'" for k, (_, kind) in enumerate(SIGNAL_TEXTS)) + " END AS kind FROM orders",
)
def q46g(spark, sf):
    """What kind of signal a text is, by the first of nine kinds whose words it has."""
    said = F.element_at(F.array(*(F.lit(t) for t, _ in SIGNAL_TEXTS)), (F.col("o_orderkey") % 10 + 1).cast("int"))
    return table(spark, sf, "orders").select("o_orderkey", text.signal_kind(said).alias("kind"))


@query(
    "q46h_parse_amounts",
    """SELECT c_custkey, coalesce(try_cast(regexp_replace(t, '[, $]', '', 'g') AS DOUBLE), 0) AS amount FROM (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '$1,' || lpad(CAST(c_custkey % 1000 AS VARCHAR), 3, '0') || '.50' WHEN c_custkey % 3 = 1 THEN 'n/a' ELSE CAST(c_custkey AS VARCHAR) END AS t FROM customer)""",
)
def q46h(spark, sf):
    """Amounts as people write them; what isn't one counts as 0."""
    k = F.col("c_custkey")
    written = F.when(k % 3 == 0, F.concat(F.lit("$1,"), F.lpad((k % 1000).cast("string"), 3, "0"), F.lit(".50"))).when(k % 3 == 1, "n/a").otherwise(k.cast("string"))
    return table(spark, sf, "customer").select("c_custkey", text.parse_amount(written).alias("amount"))
