"""Boards and schedules: labels, outcomes of daily plans, promises to chase, next sync times, stable JSON."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import dates, formats, rounding
from tidemark.operators import upsert
from tidemark.plans.registry import query, table

NY = "America/New_York"
COMPACT = "CASE WHEN {v} >= 100 THEN CAST(CAST(floor({v} + 0.5) AS BIGINT) AS VARCHAR) ELSE regexp_replace(printf('%.1f', floor({v} * 10.0::DOUBLE + 0.5::DOUBLE) / 10.0::DOUBLE), '\\.0$', '') END"


@query(
    "q72_number_labels",
    f"""WITH o AS (SELECT o_orderkey, (o_totalprice - 150000) * CASE o_orderkey % 3 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.05::DOUBLE ELSE 1000.0::DOUBLE END AS amount, o_orderkey % 500 AS m FROM orders), a AS (SELECT *, abs(amount) AS size FROM o)
        SELECT o_orderkey, CASE WHEN amount < 0 THEN '-$' ELSE '$' END || CASE WHEN size < 10000 THEN format('{{:,}}', CAST(floor(size + 0.5::DOUBLE) AS BIGINT)) WHEN size >= 1e9 THEN {COMPACT.format(v="(size / 1e9)")} || 'B' WHEN size >= 1e6 THEN {COMPACT.format(v="(size / 1e6)")} || 'M' ELSE {COMPACT.format(v="(size / 1e3)")} || 'K' END AS amount,
               CASE WHEN m < 60 THEN m || 'm' WHEN m % 60 = 0 THEN (m // 60) || 'h' ELSE (m // 60) || 'h ' || (m % 60) || 'm' END AS took, (m % 3) || CASE WHEN m % 3 = 1 THEN ' reply' ELSE ' replies' END AS replies FROM a""",
)
def q72(spark, sf):
    """Amounts, durations and counts as labels."""
    scale = F.element_at(F.array(F.lit(1.0), F.lit(0.05), F.lit(1000.0)), (F.col("o_orderkey") % 3 + 1).cast("int"))
    minutes = F.col("o_orderkey") % 500
    return table(spark, sf, "orders").select("o_orderkey", formats.currency((F.col("o_totalprice") - 150000) * scale).alias("amount"), formats.minutes_label(minutes).alias("took"), formats.pluralize(minutes % 3, "reply", "replies").alias("replies"))


@query(
    "q73_name_labels",
    r"""SELECT p_partkey, array_to_string(list_transform(list_filter(regexp_split_to_array(p_name, '\s+'), lambda w: w <> '')[1:2], lambda w: upper(left(w, 1))), '') AS initials,
               CASE WHEN length(p_name) <= 12 THEN p_name ELSE rtrim(left(p_name, 11)) || '…' END AS short FROM part""",
)
def q73(spark, sf):
    """Initials and cut names."""
    return table(spark, sf, "part").select("p_partkey", formats.initials(F.col("p_name")).alias("initials"), formats.truncate(F.col("p_name"), 12).alias("short"))


@query(
    "q74_plan_outcomes",
    """WITH c AS (SELECT l_orderkey, min(l_shipdate) AS completed FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1),
            p AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, completed, timezone('UTC', timezone('America/New_York', CAST(CAST(o_orderdate AS DATE) + 2 AS TIMESTAMP))) AS deadline FROM orders LEFT JOIN c ON l_orderkey = o_orderkey),
            s AS (SELECT month, CASE WHEN completed <= deadline THEN 'done' WHEN deadline <= TIMESTAMP '2001-08-01' THEN 'missed' ELSE 'pending' END AS state FROM p),
            n AS (SELECT month, count(*) FILTER (state = 'done') AS done, count(*) FILTER (state = 'missed') AS missed, count(*) FILTER (state = 'pending') AS pending FROM s GROUP BY 1)
       SELECT *, CASE WHEN done + missed > 0 THEN CAST(floor(CAST(done AS DOUBLE) / (done + missed) * 100 + 0.5) AS BIGINT) END AS rate FROM n""",
)
def q74(spark, sf):
    """Planned work is done if completed by the start of the second day after, local time; then missed, or pending until that comes."""
    completed = table(spark, sf, "lineitem").where("l_linestatus = 'F'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_shipdate").alias("completed"))
    deadline = dates.day_start(F.date_add(F.to_date("o_orderdate"), 2), NY)
    now = F.lit("2001-08-01").cast("timestamp")
    done = F.coalesce(F.col("completed").cast("timestamp") <= deadline, F.lit(False))
    plans = table(spark, sf, "orders").select("o_orderkey", "o_orderdate").join(completed, "o_orderkey", "left")
    counted = plans.groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count_if(done).alias("done"), F.count_if(~done & (deadline <= now)).alias("missed"), F.count_if(~done & (deadline > now)).alias("pending"))
    return counted.withColumn("rate", rounding.percent(F.col("done"), F.col("done") + F.col("missed")))


@query(
    "q75_promise_sweep",
    """WITH l AS (SELECT l_suppkey, datediff('day', DATE '1998-08-02', CAST(l_shipdate AS DATE)) AS days FROM lineitem WHERE l_linestatus = 'O')
       SELECT l_suppkey, count(*) FILTER (days < 0) AS overdue, count(*) FILTER (days BETWEEN 0 AND 2) AS due_soon, CAST(max(-days) FILTER (days < 0) AS BIGINT) AS latest_by FROM l WHERE days <= 2 GROUP BY 1""",
)
def q75(spark, sf):
    """Open promises by who owes them: overdue, due within two days, and days that the latest one is late."""
    days = F.date_diff(F.to_date("l_shipdate"), F.lit("1998-08-02").cast("date"))
    due = table(spark, sf, "lineitem").where("l_linestatus = 'O' AND l_shipdate < '1998-08-05'").select("l_suppkey", days.alias("days"))
    late = F.col("days") < 0
    return due.groupBy("l_suppkey").agg(F.count_if(late).alias("overdue"), F.count_if(~late).alias("due_soon"), F.max(F.when(late, -F.col("days"))).cast("long").alias("latest_by"))


@query(
    "q76_next_sync",
    """WITH ok AS (SELECT user_id, max(ts) AS at FROM events WHERE event_type <> 'error' GROUP BY 1),
            f AS (SELECT e.user_id, max(e.ts) AS last, count(*) FILTER (event_type = 'error' AND (ok.at IS NULL OR e.ts > ok.at)) AS failures FROM events e LEFT JOIN ok USING (user_id) GROUP BY 1)
       SELECT user_id, failures, CAST(greatest(60, CASE WHEN failures > 0 THEN least(1440, 15 * pow(2, failures - 1)) ELSE 0 END) AS BIGINT) AS wait_minutes, strftime(last + to_minutes(CAST(greatest(60, CASE WHEN failures > 0 THEN least(1440, 15 * pow(2, failures - 1)) ELSE 0 END) AS BIGINT)), '%Y-%m-%d %H:%M') AS next_sync FROM f""",
)
def q76(spark, sf):
    """When each hourly connection syncs next: failures since its last success double the wait, up to a day.

    Two partial aggregations and a join on their few rows; no window sorts a hot connection's events.
    """
    events, failed = table(spark, sf, "events").select("user_id", "ts", "event_type"), F.col("event_type") == "error"
    last = events.groupBy("user_id").agg(F.max(F.when(~failed, F.col("ts"))).alias("ok"), F.max("ts").alias("last"))
    failures = events.where(failed).join(last.select("user_id", "ok"), "user_id").where("ok IS NULL OR ts > ok").groupBy("user_id").agg(F.count("*").alias("failures"))
    counted = last.join(failures, "user_id", "left").select("user_id", "last", F.coalesce("failures", F.lit(0)).cast("long").alias("failures"))
    wait = F.greatest(F.lit(60.0), F.when(F.col("failures") > 0, rounding.backoff(F.col("failures"), 15.0, 1440.0)).otherwise(0.0)).cast("long")
    return counted.select("user_id", "failures", wait.alias("wait_minutes"), F.date_format(F.col("last") + F.make_dt_interval(mins=wait.cast("int")), "yyyy-MM-dd HH:mm").alias("next_sync"))


@query(
    "q77_stable_json",
    """WITH j AS (SELECT event_id, '{"a":"' || event_type || '","k":"' || json_extract_string(props, '$.k') || '","z":"' || user_id || '"}' AS body FROM events) SELECT event_id, body, sha256(body) AS hash FROM j""",
)
def q77(spark, sf):
    """JSON whose keys are in order, so that equal contents have equal hashes."""
    held = F.map_concat(F.create_map(F.lit("z"), F.col("user_id").cast("string")), F.from_json("props", "map<string,string>"), F.create_map(F.lit("a"), F.col("event_type")))
    body = upsert.stable_json(held)
    return table(spark, sf, "events").select("event_id", body.alias("body"), F.sha2(body, 256).alias("hash"))
