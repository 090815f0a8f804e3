"""Scans, filters, aggregates, sorts and set operations over the driver tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import dates, rounding, text
from tidemark.operators import groups, joins, percentiles, security, series
from tidemark.plans.registry import query, table

AS_OF = "2001-08-01"
ORDER_VIEWS = {
    "open": "o_orderstatus = 'O'", "won": "o_orderstatus = 'F'", "waiting": "o_orderstatus = 'P'", "urgent": "o_orderpriority = '1-URGENT'",
    "large": "o_totalprice >= 200000", "recent": f"o_orderdate >= TIMESTAMP '{AS_OF} 00:00:00' - INTERVAL 90 DAYS", "stale": f"o_orderstatus = 'O' AND o_orderdate < TIMESTAMP '{AS_OF} 00:00:00' - INTERVAL 365 DAYS",
}


@query(
    "q01_projection_filter",
    """SELECT l_orderkey, l_partkey, l_quantity, l_discount FROM lineitem
       WHERE l_shipdate >= TIMESTAMP '1997-01-01' AND l_shipdate < TIMESTAMP '1997-04-01' AND l_discount BETWEEN 0.05 AND 0.07 AND l_returnflag IN ('A', 'R') AND l_linestatus <> 'X'""",
)
def q01(spark, sf):
    """Half-open range of instants, closed range of numbers, membership."""
    ship = F.col("l_shipdate")
    keep = (ship >= "1997-01-01") & (ship < "1997-04-01") & F.col("l_discount").between(0.05, 0.07) & F.col("l_returnflag").isin("A", "R") & (F.col("l_linestatus") != "X")
    return table(spark, sf, "lineitem").where(keep).select("l_orderkey", "l_partkey", "l_quantity", "l_discount")


@query(
    "q02_ilike_escaped",
    r"""SELECT p_partkey, p_name || '_50%' AS label FROM part WHERE (p_name || '_50%') ILIKE '%e%\_50\%%' ESCAPE '\' AND NOT (p_name ILIKE '%\_%' ESCAPE '\')""",
)
def q02(spark, sf):
    """Text search for what a user typed, wildcards in it taken literally."""
    label = F.concat("p_name", F.lit("_50%"))
    part = table(spark, sf, "part").withColumn("label", label)
    return part.where(F.col("label").ilike("%e" + text.like_pattern("_50%")) & ~F.col("p_name").ilike(text.like_pattern("_"))).select("p_partkey", "label")


@query(
    "q03_null_or_not",
    "SELECT d.doc_id, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.toxic IS NULL OR l.toxic <> 1",
)
def q03(spark, sf):
    """Null, or not a value: unlabelled documents count as not toxic."""
    labelled = table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels").select("doc_id", "toxic"), "doc_id", "left")
    return labelled.where(F.col("toxic").isNull() | (F.col("toxic") != 1))


@query(
    "q04_json_predicate",
    "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) > 50",
)
def q04(spark, sf):
    """A field of a JSON column in projection and predicate."""
    k = F.get_json_object("props", "$.k").try_cast("long")
    return table(spark, sf, "events").select("event_id", k.alias("k")).where("k > 50")


@query(
    "q05_dynamic_filters",
    """SELECT doc_id FROM documents WHERE (lower(text) LIKE '%the%' AND lower(text) LIKE '%tion%' AND lang = 'en' AND n_chars >= 500)
       AND (lower(text) LIKE '%ing%' OR lower(text) LIKE '%zzz%' OR lower(source) LIKE '%src1%' OR lower(text) LIKE '%qqq%')""",
)
def q05(spark, sf):
    """Filters composed from optional inputs: up to three terms must all be found, of more any one will do."""

    def terms(found: list[str], fields: list[str]):
        each = [reduce(lambda a, b: a | b, [F.contains(F.lower(F.col(f)), F.lit(t)) for f in fields]) for t in found]
        return reduce((lambda a, b: a & b) if len(found) <= 3 else (lambda a, b: a | b), each)

    wanted = {"lang": "en", "source": None, "least": 500}
    predicates = [terms(["the", "tion"], ["text"])]
    predicates.append(terms(["ing", "zzz", "src1", "qqq"], ["text", "source"]))
    predicates += [F.col(c) == v for c, v in wanted.items() if v is not None and c != "least"]
    predicates.append(F.col("n_chars") >= wanted["least"])
    return table(spark, sf, "documents").where(reduce(lambda a, b: a & b, predicates, F.lit(True))).select("doc_id")


LEVEL = "CASE WHEN doc_id % 10 < 5 THEN 'LOW' WHEN doc_id % 10 < 8 THEN 'MEDIUM' WHEN doc_id % 10 < 9 THEN 'HIGH' ELSE 'CRITICAL' END"


@query(
    "q06_row_security",
    f"SELECT doc_id, source FROM documents WHERE ({LEVEL}) IN ('LOW', 'MEDIUM') OR source IN ('src3') OR doc_id IN (9, 19, 29)",
)
def q06(spark, sf):
    """Documents that a reader may see: by level, by granted source, by granted item."""
    scope = security.Scope(clearance="MEDIUM", sources=("src3",), items=(9, 19, 29))
    docs = table(spark, sf, "documents")
    return docs.where(security.readable(scope, F.expr(LEVEL), F.col("source"), F.col("doc_id"))).select("doc_id", "source")


@query(
    "q07_provenance_hide",
    """SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN
       (SELECT l_orderkey FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE s_acctbal < 0 AND l_orderkey IS NOT NULL)""",
)
def q07(spark, sf):
    """Orders hidden if any of their lines comes from a supplier that may not be read."""
    sources = table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey").join(table(spark, sf, "supplier").select("s_suppkey", "s_acctbal"), F.col("l_suppkey") == F.col("s_suppkey"))
    references = sources.select(F.col("l_orderkey").alias("o_orderkey"), "s_acctbal")
    return security.hide_by_provenance(table(spark, sf, "orders").select("o_orderkey"), references, "o_orderkey", F.col("s_acctbal") >= 0)


@query("q08_view_counts", "SELECT " + ", ".join(f"count(*) FILTER ({p.replace('90 DAYS', '90 DAY').replace('365 DAYS', '365 DAY')}) AS n_{v}" for v, p in ORDER_VIEWS.items()) + " FROM orders")
def q08(spark, sf):
    """The counts of all views in one pass."""
    return table(spark, sf, "orders").agg(*(F.count_if(F.expr(p)).alias(f"n_{v}") for v, p in ORDER_VIEWS.items()))


@query("q09_group_count", "SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1")
def q09(spark, sf):
    return table(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))


@query(
    "q10_group_pivot",
    """SELECT event_type, count(*) FILTER (hour(ts) < 8) AS night, count(*) FILTER (hour(ts) BETWEEN 8 AND 17) AS office, count(*) FILTER (hour(ts) > 17) AS evening FROM events GROUP BY 1""",
)
def q10(spark, sf):
    """Counts by two keys, the second across."""
    part = F.when(F.hour("ts") < 8, "night").when(F.hour("ts") <= 17, "office").otherwise("evening")
    wide = table(spark, sf, "events").select("event_type", part.alias("part")).groupBy("event_type").pivot("part", ["night", "office", "evening"]).count()
    return wide.na.fill(0)


@query(
    "q11_company_directory",
    """SELECT c.c_custkey, n.n_name AS nation, coalesce(o.n, 0) AS open_orders, round(coalesce(o.v, 0), 2) AS open_value, o.last_order
       FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
       LEFT JOIN (SELECT o_custkey, count(*) AS n, sum(o_totalprice) AS v, max(o_orderdate) AS last_order FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) o ON o.o_custkey = c.c_custkey""",
)
def q11(spark, sf):
    """All customers with their open orders, 0 where there are none: the child is aggregated before the join."""
    opened = table(spark, sf, "orders").where("o_orderstatus = 'O'").groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("v"), F.max("o_orderdate").alias("last_order"))
    customer, nation = table(spark, sf, "customer").select("c_custkey", "c_nationkey"), table(spark, sf, "nation").select("n_nationkey", "n_name")
    every = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(opened, F.col("c_custkey") == F.col("o_custkey"), "left")
    return every.select("c_custkey", F.col("n_name").alias("nation"), F.coalesce("n", F.lit(0)).alias("open_orders"), F.round(F.coalesce("v", F.lit(0.0)), 2).alias("open_value"), "last_order")


@query("q12_rollup_tabs", "SELECT o_orderstatus AS status, o_orderpriority AS priority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def q12(spark, sf):
    """Counts by tab, with subtotals and the total."""
    return table(spark, sf, "orders").select(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority")).rollup("status", "priority").agg(F.count("*").alias("n"))


@query("q12b_cube", "SELECT o_orderstatus AS status, o_orderpriority AS priority, count(*) AS n, CAST(grouping_id(o_orderstatus, o_orderpriority) AS BIGINT) AS gid FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def q12b(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority")).cube("status", "priority").agg(F.count("*").alias("n"), F.grouping_id().alias("gid"))


@query(
    "q13_stage_timing_p95",
    "SELECT event_type, count(*) AS n, round(avg(value), 4) AS mean, round(quantile_cont(value, 0.95), 4) AS p95 FROM events GROUP BY 1",
)
def q13(spark, sf):
    """Mean and exact, interpolated 95th percentile of durations by stage."""
    events = table(spark, sf, "events").select("event_type", "value")
    p95 = percentiles.exact_percentiles(events, ["event_type"], F.col("value"), {"p95": 0.95}).select("event_type", F.round("p95", 4).alias("p95"))
    return events.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("mean")).join(p95, "event_type", "left")


@query(
    "q14_median_speed",
    """SELECT o_orderpriority AS priority, floor(median(datediff('day', o_orderdate, l_shipdate)) * 10 + 0.5) / 10 AS median_days
       FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1""",
)
def q14(spark, sf):
    """Median days from order to shipping, one decimal, halves up."""
    lines, orders = table(spark, sf, "lineitem").select("l_orderkey", "l_shipdate"), table(spark, sf, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority")
    days = F.datediff("l_shipdate", "o_orderdate")
    both = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    return both.groupBy(F.col("o_orderpriority").alias("priority")).agg(rounding.half_up(F.median(days), 1).alias("median_days"))


@query("q15_latest_per_group", "SELECT user_id, event_id, event_type, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def q15(spark, sf):
    """Each user's latest event; of several at once, the one with the largest id."""
    events = table(spark, sf, "events").select("user_id", "event_id", "event_type", "ts")
    return groups.top_per_group(events, ["user_id"], [F.desc("ts"), F.desc("event_id")])


@query(
    "q16_last_n_points",
    """SELECT o_custkey, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderdate, o_orderkey) AS keys, count(*) AS n FROM
       (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) <= 3) GROUP BY 1""",
)
def q16(spark, sf):
    """A customer's last three orders, oldest first."""
    last = groups.last_points(table(spark, sf, "orders").select("o_custkey", "o_orderdate", "o_orderkey"), ["o_custkey"], "o_orderdate", 3, ["o_orderkey"], "points")
    return last.select("o_custkey", F.array_join(F.transform("points", lambda p: p["o_orderkey"].cast("string")), ",").alias("keys"), F.size("points").cast("long").alias("n"))


@query(
    "q17_change_vs_previous",
    """SELECT event_id, round((value - p) / abs(p), 6) AS change FROM (SELECT event_id, value, nullif(lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0) AS p FROM events)""",
)
def q17(spark, sf):
    """Fractional change against the user's previous event."""
    change = series.change_from_previous(F.col("value"), [F.col("ts"), F.col("event_id")], ["user_id"])
    return table(spark, sf, "events").select("event_id", F.round(change, 6).alias("change"))


@query(
    "q18_daily_series_local",
    """WITH c AS (SELECT CAST(timezone('America/New_York', timezone('UTC', ts)) AS DATE) AS day, count(*) AS n FROM events GROUP BY 1)
       SELECT strftime(s.day, '%Y-%m-%d') AS day, coalesce(c.n, 0) AS n FROM (SELECT CAST(unnest(generate_series(DATE '2024-01-02', DATE '2024-02-05', INTERVAL 1 DAY)) AS DATE) AS day) s LEFT JOIN c ON c.day = s.day""",
)
def q18(spark, sf):
    """Events for each of 35 local days, 0 where there are none."""
    day = dates.local_day(F.col("ts"), "America/New_York")
    counted = table(spark, sf, "events").groupBy(day.alias("day")).agg(F.count("*").alias("n"))
    filled = series.fill(series.day_spine(spark, "2024-02-05", 35), counted, "day", ["n"])
    return filled.select(dates.day_key(F.col("day")).alias("day"), "n")


@query("q19_semi", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O')")
def q19(spark, sf):
    opened = table(spark, sf, "orders").where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf, "customer").select("c_custkey").join(opened, "c_custkey", "left_semi")


@query("q20_anti", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def q20(spark, sf):
    """Customers without an order that waits."""
    waiting = table(spark, sf, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf, "customer").select("c_custkey").join(waiting, "c_custkey", "left_anti")


@query(
    "q21_for_all",
    """SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING bool_and(l_shipdate < TIMESTAMP '1999-01-01'))""",
)
def q21(spark, sf):
    """Orders with lines, all of which were shipped before the cutoff."""
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_shipdate")
    return joins.for_all(table(spark, sf, "orders").select("o_orderkey"), lines, "o_orderkey", F.col("l_shipdate") < "1999-01-01")


@query(
    "q22_bridge_distinct",
    """SELECT k AS user_id, count(DISTINCT event_id) AS n FROM (SELECT user_id AS k, event_id FROM events UNION ALL SELECT CAST(json_extract_string(props, '$.k') AS BIGINT), event_id FROM events) GROUP BY 1""",
)
def q22(spark, sf):
    """Events that a user owns or is attached to, each counted once."""
    events = table(spark, sf, "events")
    roles = events.select("user_id", "event_id").unionByName(events.select(F.get_json_object("props", "$.k").cast("long").alias("user_id"), "event_id"))
    return roles.groupBy("user_id").agg(F.countDistinct("event_id").alias("n"))


@query(
    "q23_union_events",
    """SELECT 'order' AS kind, o_orderkey AS id, CAST(o_orderdate AS TIMESTAMP) AS at, o_totalprice AS amount FROM orders WHERE o_totalprice > 300000
       UNION ALL SELECT 'event', event_id, CAST(ts AS TIMESTAMP), value FROM events WHERE event_type = 'purchase'""",
)
def q23(spark, sf):
    """Several kinds of rows in one timeline."""
    orders = table(spark, sf, "orders").where("o_totalprice > 300000").select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("at"), F.col("o_totalprice").alias("amount"))
    events = table(spark, sf, "events").where("event_type = 'purchase'").select(F.lit("event").alias("kind"), F.col("event_id").alias("id"), F.col("ts").alias("at"), F.col("value").alias("amount"))
    return orders.unionByName(events)


@query(
    "q24_page_offset",
    """SELECT o_orderkey, (SELECT count(*) FROM orders) AS total, CAST(ceil((SELECT count(*) FROM orders) / 50.0) AS BIGINT) AS pages FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 100""",
)
def q24(spark, sf):
    """The third page of fifty, with the total and the number of pages."""
    orders = table(spark, sf, "orders")
    total = orders.agg(F.count("*").alias("total"), F.ceil(F.count("*") / 50).alias("pages"))
    page = orders.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(100).limit(50)
    return page.select("o_orderkey").crossJoin(F.broadcast(total))  # one row


@query(
    "q24b_null_order",
    """SELECT doc_id, toxic, row_number() OVER (ORDER BY toxic ASC NULLS LAST, doc_id) AS place, count(*) OVER () > 60 AS more FROM (SELECT d.doc_id, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)) ORDER BY toxic ASC NULLS LAST, doc_id LIMIT 60""",
)
def q24b(spark, sf):
    """A sort with nulls last, cut to 60 rows, with a flag for more: limit + 1 rows are read."""
    labelled = table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels").select("doc_id", "toxic"), "doc_id", "left")
    first = labelled.orderBy(F.asc_nulls_last("toxic"), "doc_id").limit(61)
    placed = first.withColumn("place", F.row_number().over(Window.orderBy(F.asc_nulls_last("toxic"), "doc_id"))).withColumn("more", F.count("*").over(Window.partitionBy()) > 60)
    return placed.where("place <= 60").select("doc_id", "toxic", "place", "more")


@query(
    "q24c_enum_sort",
    """SELECT o_orderkey, CAST(CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'P' THEN 1 WHEN 'F' THEN 2 END AS INTEGER) AS ordinal FROM orders
       ORDER BY ordinal NULLS LAST, o_totalprice DESC, o_orderkey LIMIT 40""",
)
def q24c(spark, sf):
    """Sorted by an enum's order of declaration, not by its names."""
    ordinal = F.create_map(*(F.lit(x) for pair in (("O", 0), ("P", 1), ("F", 2)) for x in pair))[F.col("o_orderstatus")]
    return table(spark, sf, "orders").select("o_orderkey", ordinal.alias("ordinal"), "o_totalprice").orderBy(F.asc_nulls_last("ordinal"), F.desc("o_totalprice"), "o_orderkey").limit(40).drop("o_totalprice")


@query(
    "q24d_set_operations",
    """(SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'O' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') EXCEPT SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'""",
)
def q24d(spark, sf):
    """Intersection and difference of keys."""
    orders = table(spark, sf, "orders")
    by = lambda s: orders.where(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("k"))
    return by("O").intersect(by("F")).subtract(table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("k")))
