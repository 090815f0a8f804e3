"""Search, change detection, windows, sessions, threads and extraction over the driver tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import dates, text
from tidemark.operators import groups, index, percentiles, search, security, upsert
from tidemark.operators.kept import shared_folder
from tidemark.plans.registry import query, table
from tidemark.sources import html

STEM = """regexp_replace(CASE WHEN regexp_matches(w, '^.{3,}ing$') THEN left(w, length(w) - 3) WHEN regexp_matches(w, '^.{2,}ie[ds]$') THEN left(w, length(w) - 3) || 'y'
  WHEN regexp_matches(w, '^.{3,}ed$') THEN left(w, length(w) - 2) WHEN regexp_matches(w, '^.{3,}es$') AND regexp_matches(w, '(ss|x|ch|sh)es$') THEN left(w, length(w) - 2)
  WHEN regexp_matches(w, '^.{3,}s$') AND NOT regexp_matches(w, '(ss|us|is)$') THEN left(w, length(w) - 1) ELSE w END, '^(.{3,})e$', '\\1')"""


#: Where the index of a folder's documents is kept, for each application.
INDEXES: dict[tuple[str, str], list[str]] = {}


def documents_index(spark, sf) -> list[str]:
    """The segments of the documents' index, which the first query of an application writes and the others read."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in INDEXES:
        path = shared_folder(spark)
        index.write_index(table(spark, sf, "documents"), path, "doc_id", ["source", "text"])
        INDEXES[key] = [path]
    return INDEXES[key]


@query(
    "q47_fts_match",
    f"""WITH t AS (SELECT doc_id, unnest(regexp_split_to_array(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'), ' ')) AS w FROM documents), s AS (SELECT doc_id, {STEM} AS term FROM t WHERE length(w) >= 2)
        SELECT doc_id AS id, count(*) AS rank FROM s WHERE term IN ('the', 'hainha') GROUP BY 1 HAVING count(DISTINCT term) = 2 AND doc_id NOT IN (SELECT doc_id FROM s WHERE term = 'tion')""",
)
def q47(spark, sf):
    """Documents with all stems that are asked for and without those that are not wanted, by weight."""
    plan = search.SearchPlan.parse("the hainha -tion")
    return index.match_stems(spark, documents_index(spark, sf), list(plan.terms), list(plan.without), ["text"]).select("id", F.col("found").alias("rank"))


@query(
    "q47b_tiers",
    f"""WITH q AS (SELECT unnest(['erth', 'therw', 'thain']) AS term), t AS (SELECT doc_id, unnest(regexp_split_to_array(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'), ' ')) AS w FROM documents),
             h AS (SELECT term, doc_id AS id, 1 AS tier FROM q JOIN (SELECT DISTINCT doc_id, {STEM} AS stem FROM t WHERE length(w) >= 2) ON stem = term
                   UNION ALL SELECT term, doc_id, 2 FROM documents, q WHERE regexp_matches(lower(text), '(^|[^a-z0-9])' || term)
                   UNION ALL SELECT term, doc_id, 3 FROM documents, q WHERE contains(lower(text), term))
        SELECT * FROM h WHERE (term, tier) IN (SELECT (term, min(tier)) FROM h GROUP BY term)""",
)
def q47b(spark, sf):
    """The fallback from whole words to beginnings to any text: the best tier that has hits, for a term of each kind."""
    return index.match_tiers(spark, documents_index(spark, sf), ["erth", "therw", "thain"], ["text"])


@query(
    "q48_search_groups",
    """WITH h AS (SELECT 'customer' AS type, c_custkey AS id, c_acctbal AS rank FROM customer WHERE c_name LIKE '%1%' UNION ALL SELECT 'part', p_partkey, p_retailprice FROM part WHERE p_name LIKE '%1%' UNION ALL SELECT 'supplier', s_suppkey, s_acctbal FROM supplier WHERE s_name LIKE '%1%'),
       r AS (SELECT *, row_number() OVER (PARTITION BY type ORDER BY rank DESC, id) AS place, count(*) OVER (PARTITION BY type) AS n FROM h)
       SELECT type, id, CAST(place AS INTEGER) AS place, n > 5 AS more FROM r WHERE place <= 5""",
)
def q48(spark, sf):
    """Hits of three record types, five each, with a flag for more."""
    hits = None
    for kind, key, name, rank in (("customer", "c_custkey", "c_name", "c_acctbal"), ("part", "p_partkey", "p_name", "p_retailprice"), ("supplier", "s_suppkey", "s_name", "s_acctbal")):
        one = table(spark, sf, kind).where(F.col(name).like(text.like_pattern("1"))).select(F.lit(kind).alias("type"), F.col(key).alias("id"), F.col(rank).alias("rank"))
        hits = one if hits is None else hits.unionByName(one)
    return search.grouped_results(hits, search.SearchPlan((), per_type=5), [F.desc("rank"), F.asc("id")]).select("type", "id", "place", "more")


@query("q49_hidden_exists", "SELECT EXISTS (SELECT 1 FROM documents WHERE contains(lower(text), 'the') AND NOT (source IN ('src1', 'src2'))) AS hidden")
def q49(spark, sf):
    """Whether there are hits that the reader may not see."""
    scope = security.Scope(sources=("src1", "src2"))
    hits = table(spark, sf, "documents").where(F.contains(F.lower("text"), F.lit("the")))
    unseen = ~security.readable(scope, F.lit("LOW"), F.col("source"), F.col("doc_id"))
    return hits.where(unseen).limit(1).agg((F.count("*") > 0).alias("hidden"))


@query(
    "q50_snippet",
    """WITH l AS (SELECT doc_id, text, instr(lower(text), 'ing') AS hit FROM documents), s AS (SELECT *, greatest(1, hit - 40) AS b FROM l)
       SELECT doc_id, CASE WHEN b > 1 THEN '…' ELSE '' END || substr(text, b, 120) || CASE WHEN length(text) >= b + 120 THEN '…' ELSE '' END AS snippet FROM s WHERE doc_id % 3 = 0""".replace(" WHERE doc_id % 3 = 0", ""),
)
def q50(spark, sf):
    """A window of text around the first hit."""
    return table(spark, sf, "documents").select("doc_id", text.excerpt(F.col("text"), "ing").alias("snippet"))


@query(
    "q50b_term_score",
    """SELECT doc_id, ((CASE WHEN regexp_matches(lower(source), '(^|[^a-z0-9])src1') THEN 1.0 WHEN regexp_matches(lower(text), '(^|[^\\p{L}\\p{N}])src1') THEN 0.5 ELSE 0 END) + (CASE WHEN contains(lower(source), 'tionthe') THEN 1.0 WHEN contains(lower(text), 'tionthe') THEN 0.5 ELSE 0 END)) / 2 AS score FROM documents""".replace("\\\\", "\\"),
)
def q50b(spark, sf):
    """How well terms fit title and body; short terms only at the start of a word."""
    return table(spark, sf, "documents").select("doc_id", text.term_score(F.col("source"), F.col("text"), ["src1", "tionthe"]).alias("score"))


@query(
    "q51_upsert_hash",
    """WITH o AS (SELECT o_orderkey AS k, o_orderstatus AS s, o_totalprice AS v FROM orders WHERE o_orderkey % 3 <> 0),
       n AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS s, o_totalprice AS v FROM orders)
       SELECT CASE WHEN o.k IS NULL THEN 'created' WHEN o.s = n.s AND o.v = n.v THEN 'unchanged' ELSE 'updated' END AS change, count(*) AS n FROM n LEFT JOIN o USING (k) GROUP BY 1""",
)
def q51(spark, sf):
    """Incoming rows against the current ones: created, updated or unchanged, by key and content hash."""
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s"), F.col("o_totalprice").alias("v"))
    incoming = orders.withColumn("s", F.when(F.col("k") % 5 == 0, "X").otherwise(F.col("s")))
    return upsert.classify_changes(orders.where("k % 3 <> 0"), incoming, ["k"], ["s", "v"]).groupBy("change").agg(F.count("*").alias("n"))


@query(
    "q51b_upsert_versions",
    """WITH o AS (SELECT o_orderkey AS k, o_orderstatus AS s, 1 AS version FROM orders WHERE o_orderkey % 3 <> 0), n AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS s FROM orders WHERE o_orderkey % 2 = 0)
       SELECT coalesce(o.k, n.k) AS k, coalesce(n.s, o.s) AS s, CASE WHEN o.k IS NULL THEN 1 WHEN n.k IS NULL OR n.s = o.s THEN 1 ELSE 2 END AS version FROM o FULL JOIN n ON o.k = n.k""",
)
def q51b(spark, sf):
    """The table after an upsert, versions counted up where content changed."""
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s"))
    incoming = orders.where("k % 2 = 0").withColumn("s", F.when(F.col("k") % 5 == 0, "X").otherwise(F.col("s")))
    return upsert.upsert(orders.where("k % 3 <> 0").withColumn("version", F.lit(1)), incoming, ["k"], ["s"])


@query("q52_cross_source_dedupe", "SELECT doc_id, source, first_value(doc_id) OVER (PARTITION BY text ORDER BY doc_id) AS original FROM documents")
def q52(spark, sf):
    """Each item with its earliest twin of any source. Rows meet by a digest of their text, not the text."""
    docs = table(spark, sf, "documents").select("doc_id", "source", F.sha2("text", 256).alias("digest"))
    first = docs.groupBy("digest").agg(F.min("doc_id").alias("original"))
    return docs.join(first, "digest").select("doc_id", "source", "original")


@query(
    "q53_tumbling_limit",
    """SELECT user_id, date_trunc('hour', ts) AS window_start, count(*) AS n, count(*) <= 2 AS ok, greatest(0, 2 - count(*)) AS remaining FROM events GROUP BY 1, 2""",
)
def q53(spark, sf):
    """Requests per user and hour against a limit of two."""
    hourly = table(spark, sf, "events").groupBy("user_id", F.window(F.col("ts").cast("timestamp"), "1 hour").alias("w")).agg(F.count("*").alias("n"))
    return hourly.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("window_start"), "n", (F.col("n") <= 2).alias("ok"), F.greatest(F.lit(0), 2 - F.col("n")).alias("remaining"))


@query(
    "q54_session_idle",
    """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM g)
       SELECT user_id, min(ts) AS began, max(ts) AS last_seen, count(*) AS n, least(max(ts) + INTERVAL 12 HOUR, min(ts) + INTERVAL 7 DAY) AS expires FROM s GROUP BY user_id, k""",
)
def q54(spark, sf):
    """Sessions that end after twelve idle hours, and expire after seven days at the latest."""
    sessions = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")).groupBy("user_id", F.session_window("ts", "12 hours").alias("w")).agg(F.min("ts").alias("began"), F.max("ts").alias("last_seen"), F.count("*").alias("n"))
    expires = F.least(F.expr("last_seen + interval 12 hours"), F.expr("began + interval 7 days"))
    plain = lambda c: c.cast("timestamp_ntz")
    return sessions.select("user_id", plain(F.col("began")).alias("began"), plain(F.col("last_seen")).alias("last_seen"), "n", plain(expires).alias("expires"))


@query(
    "q55_thread_state",
    """WITH l AS (SELECT conv_id, arg_max(role, turn) AS role, arg_max(text, turn) AS text, count(*) AS n FROM conversations GROUP BY 1)
       SELECT conv_id, n, CASE WHEN role = 'system' THEN 'FYI' WHEN role = 'user' AND text LIKE '%?%' THEN 'AWAITING_US' WHEN role = 'assistant' AND text LIKE '%?%' THEN 'AWAITING_THEM' WHEN role = 'assistant' THEN 'RESOLVED' ELSE 'ACTIVE' END AS state FROM l""",
)
def q55(spark, sf):
    """A conversation's state, from who spoke last and whether they asked."""
    last = table(spark, sf, "conversations").groupBy("conv_id").agg(F.max_by(F.struct("role", "text"), "turn").alias("last"), F.count("*").alias("n"))
    role, asks = F.col("last.role"), F.contains(F.col("last.text"), F.lit("?"))
    state = F.when(role == "system", "FYI").when((role == "user") & asks, "AWAITING_US").when((role == "assistant") & asks, "AWAITING_THEM").when(role == "assistant", "RESOLVED").otherwise("ACTIVE")
    return last.select("conv_id", "n", state.alias("state"))


@query(
    "q56_daily_cap",
    """WITH d AS (SELECT event_id, event_type, strftime(timezone('America/New_York', timezone('UTC', ts)), '%Y-%m-%d') AS day, ts FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY ts, event_id) AS k FROM d)
       SELECT event_id, day FROM r WHERE k <= 8 OR event_type = 'error'""",
)
def q56(spark, sf):
    """At most eight a local day, urgent ones besides."""
    day = dates.local_day(F.col("ts"), "America/New_York")
    rows = table(spark, sf, "events").select("event_id", "event_type", "ts", dates.day_key(day).alias("day"))
    capped = groups.top_per_group(rows, ["day"], [F.asc("ts"), F.asc("event_id")], 8).select("event_id", "day")
    return capped.unionByName(rows.where("event_type = 'error'").select("event_id", "day")).distinct()


@query(
    "q57_html_to_text",
    r"""WITH a AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<head\b.*?</head\s*>|<title\b.*?</title\s*>|<noscript\b.*?</noscript\s*>|<template\b.*?</template\s*>', ' ', 'g') AS t FROM pages),
        s AS (SELECT page_id, regexp_replace(t, '\s+', ' ', 'g') AS t FROM a),
        b AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '(?i)<li\b[^>]*>', chr(10) || '- ', 'g'), '(?i)</?(br|p|div|ul|ol|table|tr|section|article|header|footer|main|nav|aside|blockquote|pre|form|h[1-6])\b[^>]*>|</li\s*>', chr(10), 'g'), '(?i)</?(td|th)\b[^>]*>', ' ', 'g'), '<[^>]*>', '', 'g') AS t FROM s),
        c AS (SELECT page_id, replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;', '&') AS t FROM b)
        SELECT page_id, trim(regexp_replace(regexp_replace(t, '[ \t]+', ' ', 'g'), ' ?\n[ \n]*', chr(10), 'g'), ' ' || chr(10)) AS text FROM c""",
)
def q57(spark, sf):
    """The text of HTML pages, a line for each block."""
    return table(spark, sf, "pages").select("page_id", html.to_text(F.col("html")).alias("text"))


def window_hashes(sizes: list[int]):
    """Hashes of each run of so many words of ``w``, with the number of words."""
    each = lambda size: lambda place: F.xxhash64(F.lit(size), F.array_join(F.slice("w", place, size), " "))
    return F.flatten(F.array(*(F.when(F.size("w") >= size, F.transform(F.sequence(F.lit(1), F.size("w") - size + 1), each(size))).otherwise(F.array().cast("array<bigint>")) for size in sizes)))


@query(
    "q58_evidence_contains",
    r"""WITH b AS (SELECT item_id, trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')) AS q FROM benchmark), d AS (SELECT doc_id, trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')) AS t FROM documents)
        SELECT item_id, doc_id FROM b JOIN d ON contains(' ' || t || ' ', ' ' || q || ' ')""",
)
def q58(spark, sf):
    """Which documents hold a benchmark passage, after normalisation.

    A passage's first eight words find the documents that may hold it, by an equi-join on their
    hash; only these pairs are compared in full. Passages of fewer words use all of theirs. One
    scan hashes runs of all sizes that passages have; of the runs only those that are a passage's
    are shuffled.
    """
    n = 8
    form = text.evidence_form(F.col("text"))
    quotes = table(spark, sf, "benchmark").select("item_id", form.alias("q")).withColumn("w", F.split("q", " ")).withColumn("n", F.least(F.size("w"), F.lit(n)))
    quotes = quotes.select("item_id", "q", "n", F.xxhash64(F.col("n"), F.array_join(F.slice("w", 1, F.col("n")), " ")).alias("h"))
    found = quotes.groupBy("n").agg(F.count("*").alias("rows")).collect()  # 1 to 8
    small = sum(r["rows"] for r in found) <= 1_000_000
    docs = table(spark, sf, "documents").select("doc_id", form.alias("t"))
    keys = docs.select("doc_id", F.split("t", " ").alias("w")).select("doc_id", F.explode(F.array_distinct(window_hashes(sorted(r["n"] for r in found)))).alias("h"))
    wanted = quotes.select("h", "item_id")
    hits = keys.join(F.broadcast(wanted) if small else wanted, "h").select("item_id", "doc_id").distinct()
    padded = lambda c: F.concat(F.lit(" "), F.col(c), F.lit(" "))
    pairs = hits.join(quotes.select("item_id", "q"), "item_id").join(docs, "doc_id")
    return pairs.where(F.contains(padded("t"), padded("q"))).select("item_id", "doc_id").distinct()


@query(
    "q59_embedding_neighbours",
    """WITH a AS (SELECT vec_id, label, embedding FROM embeddings WHERE vec_id % 50 = 0), p AS (SELECT a.vec_id AS a, b.vec_id AS b, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS c FROM a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id)
       SELECT a, b, round(c, 5) AS likeness FROM p QUALIFY row_number() OVER (PARTITION BY a ORDER BY round(c, 9) DESC, b) <= 3""",
)
def q59(spark, sf):
    """The three likest vectors of the same label for each vector whose id is divisible by 50.

    The queries are a stated, small share of the rows; each is compared with its label's rows.
    """
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    vectors = table(spark, sf, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    vectors = vectors.withColumn("size", norm(F.col("v")))
    asked = vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("a"), "label", F.col("v").alias("av"), F.col("size").alias("an"))
    pairs = vectors.join(asked, "label").where("a <> vec_id")
    dot = F.aggregate(F.zip_with("v", "av", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    scored = pairs.select("a", F.col("vec_id").alias("b"), (dot / F.col("size") / F.col("an")).alias("c"))
    return groups.top_per_group(scored, ["a"], [F.desc(F.round("c", 9)), F.asc("b")], 3).select("a", "b", F.round("c", 5).alias("likeness"))


@query(
    "q60_money_dates_regex",
    r"""SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z0-9]+@[A-Za-z0-9]+\.[a-z]+')) AS emails, len(regexp_extract_all(text, '[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}')) AS addresses,
               regexp_extract(text, '([0-9]{16})', 1) AS card, len(regexp_extract_all(text, '\+1 \([0-9]{3}\) [0-9]{3}-[0-9]{4}')) AS phones FROM documents""",
)
def q60(spark, sf):
    """Facts in running text found by patterns."""
    found = lambda p: F.size(F.regexp_extract_all("text", F.lit(p), F.lit(0))).cast("long")
    return table(spark, sf, "documents").select(
        "doc_id", found(r"[A-Za-z0-9]+@[A-Za-z0-9]+\.[a-z]+").alias("emails"), found(r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}").alias("addresses"),
        F.regexp_extract("text", r"([0-9]{16})", 1).alias("card"), found(r"\+1 \([0-9]{3}\) [0-9]{3}-[0-9]{4}").alias("phones"),
    )


@query(
    "q61_relationship_merge",
    """WITH e AS (SELECT user_id - user_id % 2 AS a, event_type AS r, CAST(json_extract_string(props, '$.k') AS BIGINT) AS b, value, event_id, ts FROM events)
       SELECT a AS from_id, r AS relation, b - b % 2 AS to_id, max(value) AS confidence, count(DISTINCT event_id) AS evidence, min(ts) AS first_seen, max(ts) AS last_seen FROM e WHERE a <> b - b % 2 GROUP BY 1, 2, 3""",
)
def q61(spark, sf):
    """Edges after every odd entity was merged into the even one before it."""
    events = table(spark, sf, "events")
    edges = events.select(
        F.col("user_id").alias("from_id"), F.col("event_type").alias("relation"), F.get_json_object("props", "$.k").cast("long").alias("to_id"),
        F.col("value").alias("confidence"), F.col("event_id").alias("source_id"), F.col("ts").alias("seen_at"),
    )
    ids = edges.select(F.col("from_id").alias("id")).union(edges.select("to_id")).distinct().where("id % 2 = 1")
    return upsert.repoint(edges, ids.select(F.col("id").alias("old_id"), (F.col("id") - 1).alias("new_id")))


@query(
    "q62_job_health",
    """WITH j AS (SELECT event_type AS kind, CASE WHEN value > 90 THEN 'failed' WHEN value > 70 THEN 'retrying' ELSE 'done' END AS state, value, ts, event_id FROM events)
       SELECT kind, count(*) FILTER (state = 'done') AS done, count(*) FILTER (state = 'retrying') AS retrying, count(*) FILTER (state = 'failed') AS failed, round(avg(value) FILTER (state = 'done'), 4) AS mean, round(quantile_cont(value, 0.95) FILTER (state = 'done'), 4) AS p95, last(state ORDER BY ts, event_id) AS latest FROM j GROUP BY 1""",
)
def q62(spark, sf):
    """Ingestion health by kind of job: counts by state, mean and p95 of those done, the latest state."""
    state = F.when(F.col("value") > 90, "failed").when(F.col("value") > 70, "retrying").otherwise("done")
    jobs = table(spark, sf, "events").select(F.col("event_type").alias("kind"), state.alias("state"), "value", "ts", "event_id")
    n = lambda s: F.count_if(F.col("state") == s).alias(s)
    done = F.when(F.col("state") == "done", F.col("value"))
    p95 = percentiles.exact_percentiles(jobs, ["kind"], done, {"p95": 0.95}).select("kind", F.round("p95", 4).alias("p95"))
    totals = jobs.groupBy("kind").agg(n("done"), n("retrying"), n("failed"), F.round(F.avg(done), 4).alias("mean"), F.max_by("state", F.struct("ts", "event_id")).alias("latest"))
    return totals.join(p95, "kind", "left")


@query(
    "q63_document_versions",
    """WITH v AS (SELECT conv_id, turn, regexp_replace(text, '\\s+', '', 'g') AS body, lag(regexp_replace(text, '\\s+', '', 'g')) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations)
       SELECT conv_id, turn, CAST(sum(CASE WHEN before IS NULL OR body <> before THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS version FROM v""".replace("\\\\", "\\"),
)
def q63(spark, sf):
    """Versions of a document: the same text but for white space makes no new one."""
    body = F.regexp_replace("text", r"\s+", "")
    order = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, sf, "conversations").select("conv_id", "turn", body.alias("body")).withColumn("before", F.lag("body").over(order))
    fresh = (F.col("before").isNull() | (F.col("body") != F.col("before"))).cast("long")
    return rows.withColumn("fresh", fresh).select("conv_id", "turn", F.sum("fresh").over(order).alias("version"))
