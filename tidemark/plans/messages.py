"""Messages, streams and files: thread states, windows, prose, headers, formats, books and review queues."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import finance, rounding
from tidemark.operators import percentiles, resolution, threads
from tidemark.plans.registry import query, table
from tidemark.sources import files, mail
from tidemark.streaming import events as streams


@query(
    "q130_thread_status",
    """WITH m AS (SELECT user_id AS thread, event_id AS sent, event_type = 'purchase' AS mine, event_type = 'signup' AS automated, value > 60 AS asks, value > 20 AS addressed, value < 15 AS closes FROM events),
            p AS (SELECT o_custkey AS thread, o_orderkey % 2 = 0 AS inbound, o_orderstatus = 'O' AS is_open, o_orderkey AS made_at FROM orders),
            h AS (SELECT *, max(CASE WHEN mine THEN sent END) OVER (PARTITION BY thread) AS our_last FROM m WHERE NOT automated),
            s AS (SELECT thread, count(*) AS n, arg_max(mine, sent) AS mine, arg_max(asks, sent) AS asks, arg_max(closes, sent) AS closes, arg_max(NOT mine AND asks AND addressed, sent) AS asks_us, max(sent) AS sent,
                         min(sent) FILTER (NOT mine AND asks AND addressed AND (our_last IS NULL OR sent > our_last)) AS asked_at, bool_or(mine) AS wrote, bool_or(addressed) AS addressed FROM h GROUP BY 1),
            o AS (SELECT thread, min(made_at) FILTER (inbound AND is_open) AS owed, bool_and(NOT is_open) AS closed FROM p GROUP BY 1),
            e AS (SELECT t.thread, coalesce(n, 0) AS n, mine, asks, sent, asked_at, owed, CASE WHEN n IS NULL THEN 'FYI' WHEN closes AND NOT asks_us THEN 'RESOLVED' WHEN NOT mine AND asked_at IS NOT NULL THEN 'AWAITING_US' WHEN mine AND asks THEN 'AWAITING_THEM'
                         WHEN owed IS NOT NULL THEN 'AWAITING_THEM' WHEN closed THEN 'RESOLVED' WHEN NOT wrote AND NOT addressed THEN 'FYI' ELSE 'ACTIVE' END AS status FROM (SELECT DISTINCT thread FROM m) t LEFT JOIN s ON s.thread = t.thread LEFT JOIN o ON o.thread = t.thread)
       SELECT thread, n, status, CASE WHEN status = 'AWAITING_US' THEN asked_at WHEN status = 'AWAITING_THEM' AND mine AND asks THEN sent WHEN status = 'AWAITING_THEM' THEN owed END AS since FROM e""",
)
def q130(spark, sf):
    """How each thread stands, from who asked, who answered and what was promised."""
    v, kind = F.col("value"), F.col("event_type")
    messages = table(spark, sf, "events").select(
        F.col("user_id").alias("thread"), F.col("event_id").alias("sent"), (kind == "purchase").alias("mine"), (kind == "signup").alias("automated"), (v > 60).alias("asks"), (v > 20).alias("addressed"), (v < 15).alias("closes")
    )
    k = F.col("o_orderkey")
    promises = table(spark, sf, "orders").select(F.col("o_custkey").alias("thread"), (k % 2 == 0).alias("inbound"), (F.col("o_orderstatus") == "O").alias("is_open"), k.alias("made_at"))
    return threads.thread_status(messages, promises)


@query(
    "q131_sliding_means",
    """WITH w AS (SELECT event_type, value, unnest([time_bucket(INTERVAL 6 HOUR, ts) - INTERVAL 18 HOUR, time_bucket(INTERVAL 6 HOUR, ts) - INTERVAL 12 HOUR, time_bucket(INTERVAL 6 HOUR, ts) - INTERVAL 6 HOUR, time_bucket(INTERVAL 6 HOUR, ts)]) AS start FROM events)
       SELECT event_type, start, round(avg(value), 6) AS mean FROM w GROUP BY 1, 2""",
)
def q131(spark, sf):
    """Means over a day, every six hours: the streaming query over a finished table."""
    rows = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    found = streams.sliding_means(rows, "event_type", "ts", "value", "24 hours", "6 hours")
    return found.select("event_type", F.col("window_start").cast("timestamp_ntz").alias("start"), F.round("mean", 6).alias("mean"))


@query(
    "q132_formats",
    """SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN 'pdf' WHEN 1 THEN 'csv' WHEN 2 THEN 'xlsx' WHEN 3 THEN 'html' WHEN 4 THEN 'markdown' WHEN 5 THEN 'text' ELSE 'unknown' END AS format FROM documents""",
)
def q132(spark, sf):
    """The format of files, by what they begin with and then by their names."""
    k = F.col("doc_id") % 7
    name = F.when(k == 0, "/a/report.bin").when(k == 1, "/a/data.CSV").when(k == 2, "/a/sheet.xlsx").when(k == 3, "/a/page.htm").when(k == 4, "/a/notes.md").when(k == 5, "/a/readme.txt").otherwise("/a/blob")
    head = F.when(k == 0, F.lit("%PDF-1.7 x")).when(k == 2, F.lit("PK\x03\x04 and then xl/workbook.xml")).otherwise(F.lit("plain words"))
    return table(spark, sf, "documents").select("doc_id", files.detect_format(name, F.encode(head, "UTF-8")).alias("format"))


@query("q133_csv_guard", "SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN '''=1+' || o_custkey WHEN 1 THEN '''-' || o_custkey WHEN 2 THEN '''@x' WHEN 3 THEN 'a=b' ELSE CAST(o_custkey AS VARCHAR) END AS cell FROM orders")
def q133(spark, sf):
    """Cells that a spreadsheet would take for formulas, made harmless."""
    k, c = F.col("o_orderkey") % 5, F.col("o_custkey").cast("string")
    cell = F.when(k == 0, F.concat(F.lit("=1+"), c)).when(k == 1, F.concat(F.lit("-"), c)).when(k == 2, "@x").when(k == 3, "a=b").otherwise(c)
    return table(spark, sf, "orders").select("o_orderkey", files.guard(cell).alias("cell"))


OPENINGS = ["On Tue, Oct 6, 2026 at 9:00 Ada wrote:", "Am 6. Oktober 2026 schrieb Ada:", "Le mar. 6 oct. 2026, Ada a écrit :", "-----Original Message-----", "-- ", "Sent from my phone", "CONFIDENTIALITY NOTICE: this e-mail is private."]


@query(
    "q134_mail_bodies",
    "SELECT o_orderkey, 'Please sign order ' || o_orderkey || '.' || chr(10) || 'Dr. No agreed. Thanks!' AS body, 3 AS sentences FROM orders",
)
def q134(spark, sf):
    """What is new in a message: no quotes, signatures, footers or notices; and its sentences."""
    k = F.col("o_orderkey")
    opening = F.element_at(F.array(*(F.lit(o) for o in OPENINGS)), (k % len(OPENINGS) + 1).cast("int"))
    body = F.concat(F.lit("Please sign order "), k.cast("string"), F.lit(".\nDr. No agreed. Thanks!\n\n"), opening, F.lit("\n> quoted before\nand more"))
    rows = table(spark, sf, "orders").select("o_orderkey", mail.extract_new_content(body).alias("body"))
    return rows.select("o_orderkey", "body", F.size(mail.sentences("body")).alias("sentences"))


@query(
    "q135_mail_headers",
    """SELECT o_orderkey, 'Budget ' || o_custkey AS subject, CASE WHEN o_orderkey % 2 = 0 THEN 'outbound' ELSE 'inbound' END AS direction, o_orderkey % 3 = 0 AS automated, 'Zoë' AS name FROM orders""",
)
def q135(spark, sf):
    """Subjects without marks, direction, automated senders and encoded names."""
    k = F.col("o_orderkey")
    mark = F.element_at(F.array(*(F.lit(m) for m in ("Re: ", "FWD: re: ", "AW: WG: ", "RE[2]: Antw: ", ""))), (k % 5 + 1).cast("int"))
    sender = F.concat(F.when(k % 3 == 0, "No-Reply+7").otherwise("ada"), F.lit("@"), F.when(k % 2 == 0, "Own.io").otherwise("x.io"))
    return table(spark, sf, "orders").select(
        "o_orderkey", mail.base_subject(F.concat(mark, F.lit("Budget "), F.col("o_custkey").cast("string"))).alias("subject"), mail.direction(sender, ["own.io"]).alias("direction"),
        mail.is_automated(sender).alias("automated"), mail.decode_header(F.lit("=?utf-8?q?Zo=C3=AB?=")).alias("name"),
    )


@query(
    "q136_profit_and_loss",
    """WITH m AS (SELECT o_custkey % 20 AS id, date_trunc('month', o_orderdate) AS month, sum(o_totalprice) FILTER (o_orderstatus = 'F') AS income, sum(o_totalprice) FILTER (o_orderstatus = 'O') AS cogs, sum(o_totalprice) FILTER (o_orderstatus = 'P') AS expenses FROM orders GROUP BY 1, 2)
       SELECT CAST(id AS VARCHAR) AS id, strftime(month, '%Y-%m') AS month, round(coalesce(income, 0), 2) AS income, round(coalesce(expenses, 0), 2) AS expenses, round(coalesce(income, 0) - coalesce(cogs, 0) - coalesce(expenses, 0), 2) AS net FROM m""",
)
def q136(spark, sf):
    """Months of report trees: income, cost of goods and expenses at their own depths, the net from these."""
    amount = lambda s: F.coalesce(F.sum(F.when(F.col("o_orderstatus") == s, F.col("o_totalprice"))), F.lit(0.0))
    month = F.trunc("o_orderdate", "MONTH")
    monthly = table(spark, sf, "orders").groupBy((F.col("o_custkey") % 20).alias("id"), month.alias("month")).agg(amount("F").alias("i"), amount("O").alias("c"), amount("P").alias("e"))
    each = monthly.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("month", "i", "c", "e"))).alias("m"))  # a row for each month
    meta = lambda x: F.struct(F.array(F.struct(F.lit("StartDate").alias("Name"), x["month"].cast("string").alias("Value")), F.struct(F.lit("EndDate").alias("Name"), F.last_day(x["month"]).cast("string").alias("Value"))).alias("MetaData"))
    summary = lambda group, f: F.struct(F.lit(group).alias("group"), F.transform("m", lambda x: F.format_number(x[f], 6)).alias("Summary"))
    deep = F.struct(F.array(summary("COGS", "c"), summary("Expenses", "e")).alias("Rows"))
    report = F.to_json(F.struct(F.transform("m", meta).alias("Columns"), F.array(F.struct(F.lit(None).cast("array<string>").alias("Summary"), F.array(summary("Income", "i")).alias("Rows")), F.struct(F.lit(None).cast("array<string>").alias("Summary"), deep["Rows"].alias("Rows"))).alias("Rows")))
    found = finance.profit_and_loss(each.select("id", report.alias("report")), "id", "report")
    return found.select("id", "month", F.round("income", 2).alias("income"), F.round("expenses", 2).alias("expenses"), F.round("net", 2).alias("net"))


@query(
    "q137_review_queue",
    """SELECT CAST(o_custkey AS VARCHAR) AS source, CAST(o_orderkey AS VARCHAR) AS fingerprint FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, CAST(o_orderkey AS VARCHAR)) <= 2""",
)
def q137(spark, sf):
    """The two drafts of each source that are looked at first; none is another's twin."""
    k = F.col("o_orderkey").cast("string")
    words = F.concat_ws(" ", F.transform(F.array(F.lit("a"), F.lit("b"), F.lit("c")), lambda p: F.concat(p, k)))
    drafts = table(spark, sf, "orders").select(
        F.col("o_custkey").cast("string").alias("source"), k.alias("fingerprint"), words.alias("title"), F.col("o_totalprice").alias("impact"), F.lit(False).alias("protected"), F.lit(0.5).alias("confidence"), F.lit(False).alias("pending")
    )
    return resolution.review_queue(drafts).select("source", "fingerprint")


@query(
    "q138_performance_groups",
    """WITH p AS (SELECT *, CASE WHEN l_shipdate >= TIMESTAMP '2000-07-01' THEN 'now' ELSE 'before' END AS period FROM lineitem WHERE l_shipdate >= TIMESTAMP '2000-01-01' AND l_shipdate < TIMESTAMP '2001-01-01')
       SELECT period, count(*) AS lines, count(DISTINCT l_orderkey) AS orders, count(DISTINCT l_suppkey) AS suppliers, round(sum(l_extendedprice), 2) AS revenue, round(avg(l_discount), 6) AS discount, round(sum(l_extendedprice * l_tax), 2) AS tax,
              count(*) FILTER (l_returnflag = 'R') AS returned, CAST(floor(count(*) FILTER (l_returnflag = 'R') * 100 / count(*) + 0.5) AS BIGINT) AS return_pct, round(quantile_cont(l_quantity, 0.5), 4) AS mid_quantity, round(quantile_cont(l_extendedprice, 0.9), 4) AS high_price, count(*) FILTER (l_linestatus = 'F') AS done FROM p GROUP BY 1""",
)
def q138(spark, sf):
    """Eleven figures of a half year beside those of the one before."""
    day = F.col("l_shipdate")
    rows = table(spark, sf, "lineitem").where((day >= "2000-01-01") & (day < "2001-01-01")).withColumn("period", F.when(day >= "2000-07-01", "now").otherwise("before"))
    returned = F.count_if(F.col("l_returnflag") == "R")
    figures = rows.groupBy("period").agg(
        F.count("*").alias("lines"), F.countDistinct("l_orderkey").alias("orders"), F.countDistinct("l_suppkey").alias("suppliers"), F.round(F.sum("l_extendedprice"), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("discount"),
        F.round(F.sum(F.col("l_extendedprice") * F.col("l_tax")), 2).alias("tax"), returned.alias("returned"), rounding.percent(returned, F.count("*")).alias("return_pct"), F.count_if(F.col("l_linestatus") == "F").alias("done"),
    )
    mid = percentiles.exact_percentiles(rows, ["period"], F.col("l_quantity"), {"mid": 0.5}).select("period", F.round("mid", 4).alias("mid_quantity"))
    high = percentiles.exact_percentiles(rows, ["period"], F.col("l_extendedprice"), {"high": 0.9}).select("period", F.round("high", 4).alias("high_price"))
    return figures.join(mid, "period").join(high, "period")
