"""Scalar functions over the driver tables: calendar, labels, text forms, numbers, resolution."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import date_phrases, dates, rounding, scoring, text
from tidemark.operators import resolution
from tidemark.plans.registry import query, table

NY = "America/New_York"


@query(
    "q64_calendar",
    """WITH e AS (SELECT event_id, ts, timezone('America/New_York', timezone('UTC', ts)) AS l FROM events), d AS (SELECT *, CAST(l AS DATE) AS day FROM e)
       SELECT event_id, strftime(day, '%Y-%m-%d') AS local_day, strftime(date_trunc('week', day), '%Y-%m-%d') AS week, strftime(last_day(day), '%Y-%m-%d') AS month_end, year(day) || '-Q' || quarter(day) AS quarter, hour(l) * 60 + minute(l) AS minute,
              isodow(day) < 6 AND hour(l) * 60 + minute(l) >= 420 AND hour(l) * 60 + minute(l) < 1140 AS working, strftime(timezone('UTC', timezone('America/New_York', CAST(day AS TIMESTAMP))), '%Y-%m-%d %H:%M') AS midnight_utc FROM d""",
)
def q64(spark, sf):
    """The local day of instants and what follows from it."""
    at = F.col("ts")
    day = dates.local_day(at, NY)
    return table(spark, sf, "events").select(
        "event_id", dates.day_key(day).alias("local_day"), dates.day_key(dates.week_start(day)).alias("week"), dates.day_key(F.last_day(day)).alias("month_end"), dates.quarter_key(day).alias("quarter"),
        dates.minute_of_day(at, NY).cast("long").alias("minute"), dates.in_work_hours(at, NY).alias("working"), F.date_format(dates.day_start(day, NY), "yyyy-MM-dd HH:mm").alias("midnight_utc"),
    )


@query(
    "q65_business_days",
    """WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, CAST(o_orderkey % 9 AS INT) AS n FROM orders),
            s AS (SELECT day, CAST(unnest(generate_series(day + INTERVAL 1 DAY, day + INTERVAL 20 DAY, INTERVAL 1 DAY)) AS DATE) AS x FROM (SELECT DISTINCT day FROM o)), w AS (SELECT day, x, row_number() OVER (PARTITION BY day ORDER BY x) AS n FROM s WHERE isodow(x) < 6)
       SELECT o_orderkey, strftime(x, '%Y-%m-%d') AS due FROM o JOIN w ON o.day = w.day AND o.n = w.n""",
)
def q65(spark, sf):
    """So many workdays after an order, in closed form; the oracle counts them off."""
    orders = table(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"), (F.col("o_orderkey") % 9).cast("int").alias("n"))
    return orders.where("n > 0").select("o_orderkey", dates.day_key(dates.add_business_days(F.col("day"), F.col("n"))).alias("due"))


@query(
    "q66_labels",
    """WITH o AS (SELECT o_orderkey, datediff('day', DATE '2000-01-15', CAST(o_orderdate AS DATE)) AS n, CAST(o_orderdate AS DATE) AS day FROM orders WHERE o_orderdate >= TIMESTAMP '1999-11-01' AND o_orderdate < TIMESTAMP '2000-06-01')
       SELECT o_orderkey, CASE WHEN n = 0 THEN 'Today' WHEN n = 1 THEN 'Tomorrow' WHEN n = -1 THEN 'Yesterday' WHEN n < 0 THEN (-n) || 'd overdue' WHEN n < 7 THEN 'in ' || n || 'd' WHEN n < 60 THEN 'in ' || CAST(floor(n / 7.0 + 0.5) AS BIGINT) || 'w' ELSE strftime(day, '%Y-%m-%d') END AS due FROM o""",
)
def q66(spark, sf):
    """Days as people say them."""
    orders = table(spark, sf, "orders").where("o_orderdate >= '1999-11-01' AND o_orderdate < '2000-06-01'")
    return orders.select("o_orderkey", dates.relative_day(F.to_date("o_orderdate"), F.lit("2000-01-15").cast("date")).alias("due"))


@query(
    "q67_text_forms",
    r"""WITH w AS (SELECT p_partkey, p_name, list_filter(regexp_split_to_array(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: length(x) > 0) AS ws FROM part)
        SELECT p_partkey, array_to_string(ws, ' ') AS words, len(ws) AS n, substr(sha256(array_to_string(list_sort(list_distinct(ws)), ' ')), 1, 24) AS key FROM w""",
)
def q67(spark, sf):
    """Names in normal form, and a key in which the order of words doesn't matter."""
    found = text.words(F.col("p_name"))
    key = F.substring(F.sha2(F.array_join(F.array_sort(F.array_distinct("ws")), " "), 256), 1, 24)
    return table(spark, sf, "part").select("p_partkey", found.alias("ws")).select("p_partkey", F.array_join("ws", " ").alias("words"), F.size("ws").cast("long").alias("n"), key.alias("key"))


@query(
    "q68_numbers",
    """SELECT event_id, floor(value * 10 + 0.5) / 10 AS tenth, CASE WHEN value / 100 >= 0.85 THEN 'CRITICAL' WHEN value / 100 >= 0.65 THEN 'HIGH' WHEN value / 100 >= 0.4 THEN 'MEDIUM' ELSE 'LOW' END AS band,
              round(greatest(0, 1 - abs(value - 50) / 90), 6) AS recency, least(600.0, 5 * pow(2, greatest(user_id % 12 - 1, 0))) AS wait, CASE WHEN user_id % 5 > 0 THEN CAST(floor((event_id % 7) / (user_id % 5) * 100 + 0.5) AS BIGINT) END AS pct FROM events""",
)
def q68(spark, sf):
    """Rounding, bands, decay, back-off and percentages."""
    v, u = F.col("value"), F.col("user_id")
    band = rounding.bands(v / 100, [(0.85, "CRITICAL"), (0.65, "HIGH"), (0.4, "MEDIUM")], "LOW")
    return table(spark, sf, "events").select(
        "event_id", rounding.half_up(v, 1).alias("tenth"), band.alias("band"), F.round(rounding.recency(v - 50, 90.0), 6).alias("recency"),
        rounding.backoff(u % 12, 5.0, 600.0).alias("wait"), rounding.percent(F.col("event_id") % 7, u % 5).alias("pct"),
    )


@query(
    "q69_gate",
    """SELECT event_id, CASE WHEN event_type = 'error' THEN CASE WHEN value / 100 < 0.55 AND user_id % 3 <> 0 THEN 'DROP' ELSE 'REVIEW' END WHEN value / 100 >= 0.8 THEN 'WRITE' WHEN value / 100 >= 0.55 THEN 'REVIEW' ELSE 'DROP' END AS verdict FROM events""",
)
def q69(spark, sf):
    """Written, reviewed or dropped, with a class of proposals that is always reviewed."""
    relevance = F.when(F.col("user_id") % 3 == 0, "CRITICAL").otherwise("HIGH")
    protected = F.when(F.col("event_type") == "error", "OWNER_CHANGE")
    return table(spark, sf, "events").select("event_id", scoring.gate(F.col("value") / 100, relevance, protected).alias("verdict"))


@query(
    "q70_evidence",
    r"""WITH w AS (SELECT conv_id, turn, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(text), '[‘’‚‛′]', '''', 'g'), '[“”„″]', '"', 'g'), '[–—]', '-', 'g'), '…', '...', 'g'), '\s+', ' ', 'g')) AS form, regexp_extract_all(lower(text), '[a-z]{4,}') AS ws FROM conversations),
             p AS (SELECT *, CASE turn % 2 WHEN 0 THEN ws[1] ELSE ws[len(ws)] END AS a, CASE turn % 2 WHEN 0 THEN ws[len(ws)] ELSE ws[1] END AS b FROM w WHERE len(ws) >= 2)
        SELECT conv_id, turn, contains(form, a || ' ... ' || b) OR (contains(form, a) AND contains(substr(form, strpos(form, a) + length(a)), b)) AS found FROM p""",
)
def q70(spark, sf):
    """Quotes with an ellipsis found in what they quote; those of odd turns have their parts the wrong way round."""
    rows = table(spark, sf, "conversations").withColumn("ws", F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{4,})"), 1)).where("size(ws) >= 2")
    first, last, even = F.element_at("ws", 1), F.element_at("ws", -1), F.col("turn") % 2 == 0
    quote = F.concat(F.when(even, first).otherwise(last), F.lit(" ... "), F.when(even, last).otherwise(first))
    return rows.select("conv_id", "turn", resolution.evidence_found(F.col("text"), quote).alias("found"))


PHRASES = [
    ("by tomorrow", "d + 1"), ("in two weeks", "d + 14"), ("within 30 days", "d + 30"), ("by the end of the month", "last_day(d)"), ("end of next month", "last_day(CAST(d + INTERVAL 1 MONTH AS DATE))"),
    ("by end of the year", "CAST(make_date(year(d), 12, 31) AS DATE)"), ("next Tuesday", "d + CAST((8 - isodow(d)) % 7 + 1 AS INT)"), ("on Friday", "d + CAST((12 - isodow(d)) % 7 AS INT)"), ("early next week", "d + CAST(8 - isodow(d) AS INT)"),
    ("by 1999-03-04", "DATE '1999-03-04'"), ("October 14th, 1998", "DATE '1998-10-14'"), ("in 3 months", "CAST(d + INTERVAL 3 MONTH AS DATE)"),
]


@query(
    "q78_date_phrases",
    "WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders) SELECT o_orderkey, strftime(CASE o_orderkey % 12 "
    + " ".join(f"WHEN {k} THEN {day}" for k, (_, day) in enumerate(PHRASES))
    + " END, '%Y-%m-%d') AS due, o_orderkey % 12 IN (0, 2, 3, 5, 9) AS firm FROM o",
)
def q78(spark, sf):
    """The day that a sentence of each order names, relative to the day it was placed, and whether it binds."""
    phrase = F.element_at(F.array(*(F.lit(p) for p, _ in PHRASES)), (F.col("o_orderkey") % 12 + 1).cast("int"))
    said = table(spark, sf, "orders").select("o_orderkey", F.concat(F.lit("Please send the papers "), phrase, F.lit(".")).alias("text"), F.to_date("o_orderdate").alias("day"))
    found = said.select("o_orderkey", date_phrases.deadline(date_phrases.date_phrases("text", "day")).alias("due"))
    return found.select("o_orderkey", dates.day_key(F.col("due.day")).alias("due"), F.col("due.firm").alias("firm"))


@query(
    "q79_fulfilments",
    """SELECT o_orderkey AS promise_id, l_linenumber AS line, CASE l_linenumber % 4 WHEN 0 THEN 'auto' WHEN 1 THEN 'review' WHEN 3 THEN 'review' END AS verdict
       FROM orders JOIN (SELECT l_orderkey, l_linenumber, max(l_shipdate) AS l_shipdate FROM lineitem GROUP BY 1, 2) ON l_orderkey = o_orderkey WHERE l_shipdate > o_orderdate AND l_linenumber % 4 <> 2""",
)
def q79(spark, sf):
    """Promises that later messages of their thread, or of their party elsewhere, deliver."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    promises = orders.select(F.col("o_orderkey").alias("promise_id"), F.concat(F.lit("Send pricing sheet "), F.col("o_orderkey").cast("string")).alias("title"), F.col("o_orderkey").alias("thread"), F.col("o_orderkey").alias("party"), F.col("o_orderdate").alias("made_at"))
    k = F.col("l_orderkey").cast("string")
    body = F.element_at(F.array(
        F.concat(F.lit("We've just shared the pricing sheet "), k), F.concat(F.lit("Attached: the sheet "), k), F.concat(F.lit("Lunch on order "), k), F.concat(F.lit("About pricing and sheet "), k),
    ), (F.col("l_linenumber") % 4 + 1).cast("int"))
    thread = F.when(F.col("l_linenumber") % 4 == 1, -1).otherwise(F.col("l_orderkey"))
    messages = lines.groupBy("l_orderkey", "l_linenumber").agg(F.max("l_shipdate").alias("l_shipdate")).select(
        F.struct("l_orderkey", "l_linenumber").alias("message_id"), body.alias("body"), thread.alias("thread"), F.col("l_orderkey").alias("party"), F.col("l_shipdate").alias("sent_at")
    )
    found = resolution.fulfilments(promises, messages)
    return found.select("promise_id", F.col("message_id.l_linenumber").alias("line"), "verdict")
