"""What an assistant reads: filtered tasks, timelines, meeting notes, dossiers and answers with citations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import formats
from tidemark.operators import groups, search
from tidemark.plans.registry import query, table

TODAY = "2001-08-01"


def tasks(rows: DataFrame, status: list[str] | None = None, priority: str | None = None, least: float | None = None, segment: str | None = None, text: str | None = None, due_from: str | None = None, due_to: str | None = None, limit: int = 50) -> DataFrame:
    """rows (status, priority, value, segment, name, due, id) that pass every filter that is given, the most valuable first."""
    given = {
        "status": F.col("status").isin(status or []), "priority": F.col("priority") == priority, "least": F.col("value") >= least, "segment": F.col("segment") == segment,
        "text": F.contains(F.lower("name"), F.lit((text or "").lower())), "due_from": F.col("due") >= due_from, "due_to": F.col("due") <= due_to,
    }
    asked = {"status": status, "priority": priority, "least": least, "segment": segment, "text": text, "due_from": due_from, "due_to": due_to}
    return rows.where(search.all_of([given[k] for k, v in asked.items() if v is not None])).orderBy(F.desc("value"), "id").limit(limit)


@query(
    "q140_assistant_tasks",
    f"""SELECT o_orderkey AS id, c_name AS name, round(o_totalprice, 2) AS value FROM orders JOIN customer ON c_custkey = o_custkey
        WHERE o_orderstatus IN ('O', 'P') AND o_orderpriority = '2-HIGH' AND o_totalprice >= 100000 AND c_mktsegment = 'BUILDING' AND contains(lower(c_name), '1') AND CAST(o_orderdate AS DATE) + 60 >= DATE '1996-01-01' AND CAST(o_orderdate AS DATE) + 60 <= DATE '{TODAY}'
        ORDER BY o_totalprice DESC, o_orderkey LIMIT 50""",
)
def q140(spark, sf):
    """Tasks by seven filters and a limit."""
    both = table(spark, sf, "orders").join(table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    rows = both.select(
        F.col("o_orderkey").alias("id"), F.col("c_name").alias("name"), F.col("o_totalprice").alias("value"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), F.col("c_mktsegment").alias("segment"),
        F.date_add(F.to_date("o_orderdate"), 60).alias("due"),
    )
    found = tasks(rows, ["O", "P"], "2-HIGH", 100_000, "BUILDING", "1", "1996-01-01", TODAY)
    return found.select("id", "name", F.round("value", 2).alias("value"))


@query(
    "q141_meeting_notes",
    """SELECT conv_id AS note, 'Call ' || conv_id AS title, 'user' AS email, CAST(count(*) FILTER (role = 'user') AS BIGINT) AS said FROM conversations GROUP BY conv_id
       UNION ALL SELECT conv_id, 'Call ' || conv_id, 'assistant', CAST(count(*) FILTER (role = 'assistant') AS BIGINT) FROM conversations GROUP BY conv_id""",
)
def q141(spark, sf):
    """Meeting notes as a service sends them, JSON with attendees inside, taken apart into one row an attendee; broken notes are left out."""
    n = lambda role: F.count_if(F.col("role") == role)
    person = lambda role, count: F.struct(F.lit(role).alias("email"), count.alias("said"))
    notes = table(spark, sf, "conversations").groupBy("conv_id").agg(n("user").alias("u"), n("assistant").alias("a"))
    sent = notes.select(F.to_json(F.struct(F.col("conv_id").alias("id"), F.concat(F.lit("Call "), F.col("conv_id").cast("string")).alias("title"), F.array(person("user", F.col("u")), person("assistant", F.col("a"))).alias("attendees"))).alias("body"))
    broken = sent.limit(1).select(F.lit("{broken").alias("body"))
    parsed = sent.unionByName(broken).select(F.from_json("body", "id long, title string, attendees array<struct<email string, said long>>").alias("n")).where("n.id IS NOT NULL")
    return parsed.select(F.col("n.id").alias("note"), F.col("n.title").alias("title"), F.explode("n.attendees").alias("p")).select("note", "title", "p.email", "p.said")


@query(
    "q142_dossier",
    """WITH a AS (SELECT DISTINCT o_custkey AS who FROM orders WHERE o_orderstatus = 'P'), d AS (SELECT o_custkey AS who, 'deal' AS section, o_orderkey AS id, o_totalprice AS weight FROM orders WHERE o_orderstatus <> 'F'), r AS (SELECT o_custkey, 'recent', o_orderkey, epoch(o_orderdate) FROM orders),
            e AS (SELECT user_id, 'touch', event_id, epoch_us(ts) FROM events), l AS (SELECT o_custkey, 'supplier', l_suppkey, CAST(count(*) AS DOUBLE) FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 3),
            u AS (SELECT * FROM d UNION ALL SELECT * FROM r UNION ALL SELECT * FROM e UNION ALL SELECT * FROM l)
       SELECT who, section, id, CAST(row_number() OVER (PARTITION BY who, section ORDER BY weight DESC, id) AS INTEGER) AS place FROM u SEMI JOIN a USING (who) QUALIFY row_number() OVER (PARTITION BY who, section ORDER BY weight DESC, id) <= 5""",
)
def q142(spark, sf):
    """What to know before a meeting with each customer that has a pending order: the best five of each section."""
    each = {name: table(spark, sf, name) for name in ("orders", "lineitem", "events")}
    # Rows are dealt by number, so that a task's sorts stay as large as they are when tables grow.
    n = groups.parts(spark, max(df.count() for df in each.values()))
    every = each["orders"].repartition(n, "o_custkey")
    asked = every.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("who")).distinct()
    orders = every.join(asked, F.col("o_custkey") == F.col("who"), "left_semi")
    of_order = orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey").repartition(n, "l_orderkey")
    lines = each["lineitem"].select("l_orderkey", "l_suppkey").repartition(n, "l_orderkey").join(of_order, "l_orderkey")
    lines = lines.repartition(n, "o_custkey").groupBy("o_custkey", "l_suppkey").agg(F.count("*").alias("n"))
    touches = each["events"].select("user_id", "event_id", "ts").repartition(n, "user_id").join(asked, F.col("user_id") == F.col("who"), "left_semi")
    instant = lambda c: F.unix_micros(F.col(c).cast("timestamp"))

    def best(df, who, section, key, weight):
        rows = df.select(F.col(who).alias("who"), F.lit(section).alias("section"), F.col(key).alias("id"), weight.cast("double").alias("weight"))
        return groups.top_per_group(rows, ["who"], [F.desc("weight"), F.asc("id")], 5, "place").select("who", "section", "id", "place")

    return (
        best(orders.where("o_orderstatus <> 'F'"), "o_custkey", "deal", "o_orderkey", F.col("o_totalprice"))
        .unionByName(best(orders, "o_custkey", "recent", "o_orderkey", instant("o_orderdate")))
        .unionByName(best(touches, "user_id", "touch", "event_id", instant("ts")))
        .unionByName(best(lines, "o_custkey", "supplier", "l_suppkey", F.col("n")))
    )


@query(
    "q143_answers",
    """WITH o AS (SELECT c_mktsegment AS segment, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY c_mktsegment ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'O')
       SELECT segment, segment || ' has ' || count(*) || CASE WHEN count(*) = 1 THEN ' open order' ELSE ' open orders' END || ', the largest being ' || string_agg('#' || o_orderkey || ' [' || k || ']', ', ' ORDER BY k) FILTER (k <= 2) || '.' AS answer, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY k) FILTER (k <= 2) AS citations FROM o GROUP BY 1""",
)
def q143(spark, sf):
    """Answers put together by rules, with the rows that they cite."""
    opened = table(spark, sf, "orders").where("o_orderstatus = 'O'").select("o_orderkey", "o_custkey", "o_totalprice")
    rows = opened.join(table(spark, sf, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment")), F.col("o_custkey") == F.col("c_custkey"))
    counts = rows.groupBy("segment").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("segment").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    best = rows.withColumn("k", place).where("k <= 2").groupBy("segment").agg(F.array_sort(F.collect_list(F.struct("k", "o_orderkey"))).alias("best"))
    cited = F.array_join(F.transform("best", lambda b: F.concat(F.lit("#"), b["o_orderkey"].cast("string"), F.lit(" ["), b["k"].cast("string"), F.lit("]"))), ", ")
    answer = F.concat("segment", F.lit(" has "), formats.pluralize(F.col("n"), "open order"), F.lit(", the largest being "), cited, F.lit("."))
    return counts.join(best, "segment").select("segment", answer.alias("answer"), F.array_join(F.transform("best", lambda b: b["o_orderkey"].cast("string")), ",").alias("citations"))
