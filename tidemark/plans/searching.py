"""Search over all record types: full text with choices and phrases, fetchers with their ranks, headlines, groups, time ranges."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from tidemark.functions import rounding, text
from tidemark.operators import groups, index, ranks, search
from tidemark.plans.ingestion import STEM, documents_index
from tidemark.plans.registry import query, table

AS_OF = "2001-08-01"
EVENTS_AS_OF = "2024-02-01"
WORDS = "SELECT doc_id, lang, unnest(ws) AS w, generate_subscripts(ws, 1) AS \"at\" FROM (SELECT doc_id, lang, regexp_split_to_array(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'), ' ') AS ws FROM documents)"


@query(
    "q80_fts_choices_and_phrases",
    f"""WITH w AS ({WORDS}), s AS (SELECT doc_id, lang, "at", {STEM} AS term FROM w), k AS (SELECT * FROM s WHERE term IN ('and', 'to', 'of', 'is', 'die')),
             p AS (SELECT DISTINCT a.doc_id FROM k a JOIN k b ON a.doc_id = b.doc_id AND b."at" = a."at" + 1 WHERE a.term = 'of' AND b.term = 'and'),
             d AS (SELECT doc_id, any_value(lang) AS lang, count(*) FILTER (term <> 'die') AS n, count(*) FILTER (term = 'to') AS t, count(*) FILTER (term = 'is') AS i, count(*) FILTER (term = 'die') AS x FROM k GROUP BY 1)
        SELECT doc_id AS id, CAST(n * CASE WHEN lang <> 'en' THEN 0.3 ELSE 1 END AS DOUBLE) AS rank FROM d WHERE (t > 0 OR i > 0) AND x = 0 AND doc_id IN (SELECT doc_id FROM p)""",
)
def q80(spark, sf):
    """A query with a phrase, a choice and a word to leave out; documents that aren't English count as noise."""
    asked = search.Query.parse('"of and" to OR is -die')
    foreign = table(spark, sf, "documents").where("lang <> 'en'").select(F.col("doc_id").alias("id"))
    return index.match_index(spark, documents_index(spark, sf), asked, foreign, ["text"]).select("id", F.col("rank").cast("double").alias("rank"))


@query(
    "q81_headlines",
    f"""WITH h AS (SELECT doc_id, count(*) AS n FROM (SELECT doc_id, {STEM} AS term FROM ({WORDS}) WHERE length(w) >= 2) WHERE term = 'and' GROUP BY 1 ORDER BY n DESC, doc_id LIMIT 40),"""
    + r"""
        t AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \t\n\r\f\v]+'), lambda w: w <> '') AS ws FROM documents SEMI JOIN h USING (doc_id)),
        m AS (SELECT doc_id, ws, list_transform(ws, lambda w: regexp_replace(lower(w), '[^a-z0-9]+', '', 'g') IN ('and', 'ands', 'anded')) AS hit FROM t),
        p AS (SELECT doc_id, list_transform(ws, lambda w, i: CASE WHEN hit[i] THEN '[' || w || ']' ELSE w END) AS k, list_filter(range(1, len(ws) + 1), lambda i: hit[i]) AS "at" FROM m),
        q AS (SELECT *, greatest(1, coalesce("at"[1], 1) - 4) AS a FROM p), u AS (SELECT *, list_filter("at", lambda i: i >= a + 16)[1] AS b FROM q)
        SELECT doc_id, array_to_string(k[a:a + 15], ' ') || CASE WHEN b IS NOT NULL THEN ' … ' || array_to_string(k[b:b + 15], ' ') ELSE '' END AS headline FROM u""",
)
def q81(spark, sf):
    """The forty documents with most hits, told by the index, with two fragments of sixteen words in which these are marked."""
    best = index.match_stems(spark, documents_index(spark, sf), ["and"], fields=["text"]).orderBy(F.desc("found"), "id").limit(40)
    docs = table(spark, sf, "documents").select("doc_id", "text").join(F.broadcast(best), F.col("doc_id") == F.col("id"))
    return search.headlines(docs, "text", ["and"]).select("doc_id", "headline")


CLOSE = ["and", "the", "of"]


@query(
    "q149_ranked_by_closeness",
    f"""WITH w AS (SELECT doc_id, 'text' AS field, unnest(ws) AS w, generate_subscripts(ws, 1) AS "at" FROM (SELECT doc_id, regexp_split_to_array(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'), ' ') AS ws FROM documents)
               UNION ALL SELECT doc_id, 'source', unnest(ws), generate_subscripts(ws, 1) FROM (SELECT doc_id, regexp_split_to_array(regexp_replace(lower(source), '[^a-z0-9]+', ' ', 'g'), ' ') AS ws FROM documents)),
             s AS (SELECT doc_id, field, "at", {STEM} AS term FROM w), k AS (SELECT *, CASE field WHEN 'source' THEN 1.0::DOUBLE ELSE 0.4::DOUBLE END AS weight FROM s WHERE term IN ('and', 'the', 'of')),
             c AS (SELECT doc_id, field, term, any_value(weight) AS weight, count(*) AS n FROM k GROUP BY 1, 2, 3), p AS (SELECT doc_id, sum(weight * n / (n + 1)) AS presence FROM c GROUP BY 1 HAVING count(DISTINCT term) = 3),
             l AS (SELECT doc_id, field, weight, "at", max("at") FILTER (term = 'and') OVER o AS l1, max("at") FILTER (term = 'the') OVER o AS l2, max("at") FILTER (term = 'of') OVER o AS l3 FROM k WINDOW o AS (PARTITION BY doc_id, field ORDER BY "at")),
             v AS (SELECT doc_id, field, any_value(weight) AS weight, least(l1, l2, l3) AS b, min("at") AS e FROM l WHERE l1 IS NOT NULL AND l2 IS NOT NULL AND l3 IS NOT NULL GROUP BY doc_id, field, b),
             d AS (SELECT doc_id, sum(weight / (e - b + 1)) AS density, min(e - b + 1) AS shortest FROM v GROUP BY 1)
        SELECT p.doc_id AS id, round(presence + coalesce(density, 0), 6) AS rank, shortest FROM p LEFT JOIN d ON d.doc_id = p.doc_id""",
)
def q149(spark, sf):
    """Documents with three words, ranked by how often these stand close together; a source's name weighs more than the text."""
    found = index.closeness(spark, documents_index(spark, sf), CLOSE, {"source": 1.0, "text": 0.4})
    return found.select("id", F.round("rank", 6).alias("rank"), F.col("shortest").cast("long").alias("shortest"))


def nearness(days):
    return rounding.clamp(1 - F.abs(days) / 90, 0.0, 1.0)


FETCH_SQL = f"""
    task AS (SELECT 'task' AS type, p_partkey AS id, 0.6 * (CAST(contains(p_name, 'small') AS INT) + CAST(contains(p_name, 'bolt') AS INT)) / 2 + CASE WHEN p_size > 10 THEN 0.25 ELSE 0 END + least(0.15, p_retailprice / 7000) AS rank,
                    NULL::DATE AS "at", NULL::DATE AS due, p_size > 10 AS open FROM part WHERE contains(p_name, 'small') OR contains(p_name, 'bolt')),
    deal AS (SELECT 'deal', o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 0.5 ELSE 0.1 END + 0.3 * CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'P' THEN 0.5 ELSE 0.2 END + 0.2 * CAST(c_mktsegment = 'BUILDING' AS INT), CAST(o_orderdate AS DATE), NULL::DATE, o_orderstatus = 'O'
             FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')),
    commitment AS (SELECT 'commitment', o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 0.6 ELSE 0.2 END + CASE WHEN o_orderstatus = 'O' AND due < DATE '{AS_OF}' THEN 0.3 ELSE 0 END + 0.1 * greatest(0, least(1, 1 - abs(datediff('day', DATE '{AS_OF}', due)) / 90.0)), CAST(o_orderdate AS DATE), due, o_orderstatus = 'O'
                   FROM (SELECT *, CAST(o_orderdate AS DATE) + 60 AS due FROM orders WHERE o_orderpriority = '1-URGENT')),
    meeting AS (SELECT 'meeting', event_id, 0.6 + 0.4 * greatest(0, 1 - abs(epoch(TIMESTAMP '{EVENTS_AS_OF}') - epoch(ts)) / 86400 / 60), CAST(ts AS DATE), NULL::DATE, false FROM events WHERE event_type = 'signup'),
    risk AS (SELECT 'risk', s_suppkey, 0.5 * CAST(contains(s_name, '1') AS INT) + (s_suppkey % 6) / 10.0, NULL::DATE, NULL::DATE, s_acctbal < 0 FROM supplier),
    h AS (SELECT * FROM task UNION ALL SELECT * FROM deal UNION ALL SELECT * FROM commitment UNION ALL SELECT * FROM meeting UNION ALL SELECT * FROM risk)"""


def fetchers(spark, sf) -> dict:
    """What each record type answers to the words small, bolt, building or 1, with its own rank formula."""
    none = F.lit(None).cast("date")

    def task():
        part = table(spark, sf, "part").where(F.contains("p_name", F.lit("small")) | F.contains("p_name", F.lit("bolt")))
        has = lambda w: F.contains("p_name", F.lit(w)).cast("int")
        rank = 0.6 * (has("small") + has("bolt")) / 2 + F.when(F.col("p_size") > 10, 0.25).otherwise(0.0) + F.least(F.lit(0.15), F.col("p_retailprice") / 7000)
        return part.select(F.col("p_partkey").alias("id"), rank.alias("rank"), none.alias("at"), none.alias("due"), (F.col("p_size") > 10).alias("open"))

    def deal():
        is_open = F.col("o_orderstatus") == "O"
        chance = F.when(F.col("o_orderstatus") == "F", 1.0).when(F.col("o_orderstatus") == "P", 0.5).otherwise(0.2)
        both = table(spark, sf, "orders").join(table(spark, sf, "customer").where("c_mktsegment IN ('BUILDING', 'MACHINERY')").select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
        rank = F.when(is_open, 0.5).otherwise(0.1) + 0.3 * chance + 0.2 * (F.col("c_mktsegment") == "BUILDING").cast("int")
        return both.select(F.col("o_orderkey").alias("id"), rank.alias("rank"), F.to_date("o_orderdate").alias("at"), none.alias("due"), is_open.alias("open"))

    def commitment():
        is_open, due = F.col("o_orderstatus") == "O", F.date_add(F.to_date("o_orderdate"), 60)
        today = F.lit(AS_OF).cast("date")
        rank = F.when(is_open, 0.6).otherwise(0.2) + F.when(is_open & (due < today), 0.3).otherwise(0.0) + 0.1 * nearness(F.datediff(due, today))
        return table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("id"), rank.alias("rank"), F.to_date("o_orderdate").alias("at"), due.alias("due"), is_open.alias("open"))

    def meeting():
        age = (F.unix_micros(F.lit(EVENTS_AS_OF).cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / 86_400_000_000
        return table(spark, sf, "events").where("event_type = 'signup'").select(F.col("event_id").alias("id"), (0.6 + 0.4 * rounding.recency(age, 60.0)).alias("rank"), F.to_date("ts").alias("at"), none.alias("due"), F.lit(False).alias("open"))

    def risk():
        rank = 0.5 * F.contains("s_name", F.lit("1")).cast("int") + (F.col("s_suppkey") % 6) / 10
        return table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), rank.alias("rank"), none.alias("at"), none.alias("due"), (F.col("s_acctbal") < 0).alias("open"))

    return {"task": task, "deal": deal, "commitment": commitment, "meeting": meeting, "risk": risk}


HIT = ["id", "rank", "at", "due", "open"]


@query(
    "q82_search_everything",
    f"""WITH {FETCH_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY type ORDER BY CASE type WHEN 'commitment' THEN coalesce(strftime(due, '%Y-%m-%d'), '9999') WHEN 'task' THEN CASE WHEN open THEN '0' ELSE '1' END WHEN 'meeting' THEN CAST(20000 - datediff('day', DATE '1990-01-01', "at") AS VARCHAR) ELSE '' END,
                 CASE WHEN type = 'meeting' THEN 0 ELSE round(rank, 9) END DESC, id) AS place FROM h),
             t AS (SELECT * FROM r WHERE place <= 5), g AS (SELECT type, row_number() OVER (ORDER BY CASE type WHEN 'risk' THEN 0 WHEN 'deal' THEN 1 ELSE 2 END, max(round(rank, 9)) DESC, type) AS group_place FROM t GROUP BY 1)
        SELECT t.type, id, CAST(place AS INTEGER) AS place, CAST(group_place AS INTEGER) AS group_place, round(rank, 6) AS rank FROM t JOIN g ON g.type = t.type""",
)
def q82(spark, sf):
    """Hits of five record types by their own rank formulas, five each in each type's own order, groups by intent and best hit."""
    hits, _ = search.fetch_all(fetchers(spark, sf), HIT)
    hits = hits.withColumn("rank", F.round("rank", 9))
    found = search.ordered_groups(hits, 5, {"commitment": "due", "task": "open_first", "meeting": "newest"}, ["risk", "deal"])
    return found.select("type", "id", "place", "group_place", F.round("rank", 6).alias("rank"))


@query(
    "q83_thread_hits",
    r"""WITH m AS (SELECT conv_id, turn, len(regexp_extract_all(lower(text), '[a-z]*the[a-z]*')) AS fts, left(text, 60) AS head FROM conversations), t AS (SELECT conv_id, sum(fts) AS fts, arg_max(head, fts * 1000 - turn) AS snippet FROM m WHERE fts > 0 GROUP BY 1)
        SELECT conv_id, snippet, round(0.8 * least(1, 6 * fts / 60.0) + 0.2 * greatest(0, 1 - (conv_id % 120) / 90.0), 6) AS rank FROM t""",
)
def q83(spark, sf):
    """Threads by their messages' hits and recency; the message with most hits gives the snippet."""
    fts = F.size(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]*the[a-z]*)"), 1))
    hits = table(spark, sf, "conversations").select("conv_id", "turn", fts.alias("fts"), F.left("text", F.lit(60)).alias("head")).where("fts > 0")
    threads = hits.groupBy("conv_id").agg(F.sum("fts").alias("fts"), F.max_by("head", F.struct("fts", -F.col("turn"))).alias("snippet"))
    rank = 0.8 * F.least(F.lit(1.0), 6 * F.col("fts") / 60) + 0.2 * rounding.recency(F.col("conv_id") % 120, 90.0)
    return threads.select("conv_id", "snippet", F.round(rank, 6).alias("rank"))


RANGES = ["last 30 days", "next 2 weeks", "this month", "last week", "this quarter", "since monday", "today", "last 2 months", "since 2001-05-15"]
RANGE_SQL = [
    ("DATE '2001-07-02'", "DATE '2001-08-01'"), ("DATE '2001-08-01'", "DATE '2001-08-15'"), ("DATE '2001-08-01'", "DATE '2001-08-31'"), ("DATE '2001-07-23'", "DATE '2001-07-29'"), ("DATE '2001-07-01'", "DATE '2001-09-30'"),
    ("DATE '2001-07-30'", "DATE '2001-08-01'"), ("DATE '2001-08-01'", "DATE '2001-08-01'"), ("DATE '2001-06-01'", "DATE '2001-08-01'"), ("DATE '2001-05-15'", "DATE '2001-08-01'"),
]


@query(
    "q84_time_ranges",
    "WITH r AS (SELECT * FROM (VALUES " + ", ".join(f"('{name}', {a}, {b})" for name, (a, b) in zip(RANGES, RANGE_SQL, strict=True)) + ") v(range, a, b)) SELECT range, count(l_shipdate) AS lines FROM r LEFT JOIN lineitem ON CAST(l_shipdate AS DATE) BETWEEN a AND b GROUP BY 1",
)
def q84(spark, sf):
    """Lines shipped in each of nine ranges of time that a question may name, in one pass."""
    ranges = {name: search.time_range(name, date.fromisoformat(AS_OF)) for name in RANGES}
    day = F.to_date("l_shipdate")
    counts = table(spark, sf, "lineitem").agg(*(F.count_if(day.between(F.lit(a), F.lit(b))).alias(name) for name, (a, b) in ranges.items()))
    return counts.unpivot([], RANGES, "range", "lines")


@query(
    "q85_membership",
    r"""SELECT doc_id, list_contains(string_split(source || '|' || lang, '|'), 'en') AS tagged, (lang = 'de' OR source = 'src2') AS invited FROM documents""",
)
def q85(spark, sf):
    """Whether an array has a tag, and whether a JSON array of participants has one of a given address or name."""
    docs = table(spark, sf, "documents")
    people = F.to_json(F.array(F.struct(F.concat("lang", F.lit("@x.io")).alias("email"), F.lit("a").alias("name")), F.struct(F.lit("b@x.io").alias("email"), F.col("source").alias("name"))))
    parsed = F.from_json("people", "array<struct<email string, name string>>")
    rows = docs.select("doc_id", F.split(F.concat_ws("|", "source", "lang"), r"\|").alias("tags"), people.alias("people"))
    invited = F.exists(parsed, lambda p: (p["email"] == "de@x.io") | (p["name"] == "src2"))
    return rows.select("doc_id", F.array_contains("tags", "en").alias("tagged"), invited.alias("invited"))


@query(
    "q86_keyword_retry",
    "SELECT 'keyword' AS how, p_partkey AS id FROM part WHERE contains(p_name, 'bolt')",
)
def q86(spark, sf):
    """A focused plan that finds nothing is asked again as plain keywords; both are planned, the first that has rows counts."""
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), "p_name", "p_size")
    focused = part.where(F.contains("p_name", F.lit("bolt")) & (F.col("p_size") > 1000)).select(F.lit("focused").alias("how"), "id")
    keyword = part.where(F.contains("p_name", F.lit("bolt"))).select(F.lit("keyword").alias("how"), "id")
    return groups.first_that_has_rows([focused, keyword])


@query(
    "q87_entity_items",
    """WITH a AS (SELECT c_custkey AS entity FROM customer WHERE c_acctbal < 0), i AS (SELECT user_id AS entity, event_id AS item, ts AS "at" FROM events UNION SELECT CAST(json_extract_string(props, '$.k') AS BIGINT), event_id, ts FROM events UNION SELECT o_custkey, o_orderkey + 1000000000, o_orderdate FROM orders)
       SELECT entity, item, "at", CAST(row_number() OVER (PARTITION BY entity ORDER BY "at" DESC, item) AS INTEGER) AS place FROM i WHERE entity IN (SELECT entity FROM a) QUALIFY row_number() OVER (PARTITION BY entity ORDER BY "at" DESC, item) <= 50""",
)
def q87(spark, sf):
    """The items that touch each customer in debt, by authorship, mention or order, the fifty newest of each."""
    asked = table(spark, sf, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("entity"))
    events = table(spark, sf, "events").select("event_id", "ts", "user_id", F.get_json_object("props", "$.k").cast("long").alias("k"))
    touching = events.select(F.explode(F.array_distinct(F.array("user_id", "k"))).alias("entity"), F.col("event_id").alias("item"), F.col("ts").alias("at"))
    orders = table(spark, sf, "orders").select(F.col("o_custkey").alias("entity"), (F.col("o_orderkey") + 1_000_000_000).alias("item"), F.col("o_orderdate").alias("at"))
    return groups.newest_items(asked, touching.unionByName(orders), 50)


ROUTES = [("overview", r"\b(overview|summary|status)\b"), ("deadlines", r"\b(due|deadline|overdue)\b"), ("money", r"\b(cash|revenue|burn|runway)\b"), ("people", r"\b(who|owner|team)\b")]


@query(
    "q88_intent_router",
    "WITH q AS (SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'Give me a status overview' WHEN 1 THEN 'What is due this week?' WHEN 2 THEN 'How much runway is left' WHEN 3 THEN 'Who is the owner?' WHEN 4 THEN 'who has the deadline' ELSE 'hello' END AS q FROM orders) SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'overview' WHEN 1 THEN 'deadlines' WHEN 2 THEN 'money' WHEN 3 THEN 'people' WHEN 4 THEN 'deadlines' ELSE 'search' END AS intent FROM q",
)
def q88(spark, sf):
    """A question's intent: the first pattern of a list that fits."""
    k = F.col("o_orderkey") % 6
    asked = F.when(k == 0, "Give me a status overview").when(k == 1, "What is due this week?").when(k == 2, "How much runway is left").when(k == 3, "Who is the owner?").when(k == 4, "who has the deadline").otherwise("hello")
    intent = F.coalesce(*(F.when(F.lower(asked).rlike(pattern), name) for name, pattern in ROUTES), F.lit("search"))
    return table(spark, sf, "orders").select("o_orderkey", intent.alias("intent"))


KINDS = ["commitment", "task", "meeting", "decision", "milestone", "goal", "deal", "risk", "opportunity", "company", "person", "project", "report", "note", "insight"]


@query(
    "q156_rank_formulas",
    """WITH p AS (SELECT p_partkey AS id, lower(p_name) AS title, lower(p_type) AS body, CASE p_size % 5 WHEN 0 THEN 'OPEN' WHEN 1 THEN 'NEEDED' WHEN 2 THEN 'BLOCKED' WHEN 3 THEN 'PURSUING' ELSE 'DONE' END AS status, DATE '2001-06-01' + CAST(p_size * 3 AS INT) AS due, p_size AS number, CASE WHEN p_partkey < 4 THEN p_partkey END AS place FROM part),
            f AS (SELECT *, (CASE WHEN contains(title, 'widget') THEN 1.0 WHEN contains(body, 'widget') THEN 0.5 ELSE 0 END + CASE WHEN regexp_matches(title, '(^|[^a-z0-9])ring') THEN 1.0 WHEN regexp_matches(body, '(^|[^a-z0-9])ring') THEN 0.5 ELSE 0 END) / 2 AS fit,
                         datediff('day', DATE '2001-08-01', due) AS days, abs(datediff('day', DATE '2001-08-01', due)) AS apart FROM p),
            k AS (SELECT unnest(['commitment', 'task', 'meeting', 'decision', 'milestone', 'goal', 'deal', 'risk', 'opportunity', 'company', 'person', 'project', 'report', 'note', 'insight']) AS type)
       SELECT type, id, round(CAST(CASE type
           WHEN 'commitment' THEN 0.3 * fit + CASE WHEN status = 'OPEN' THEN 0.6 ELSE 0.2 END + greatest(0, 0.1 - apart / 300) + CASE WHEN days < 0 AND status = 'OPEN' THEN 0.3 ELSE 0 END
           WHEN 'task' THEN 0.6 * fit + CASE WHEN status = 'OPEN' THEN 0.25 ELSE 0 END + least(0.15, number / 700)
           WHEN 'meeting' THEN 0.6 * fit + 0.4 * greatest(0, 1 - apart / 60)
           WHEN 'decision' THEN 0.6 * fit + CASE WHEN status = 'NEEDED' THEN 0.3 ELSE 0.1 END
           WHEN 'milestone' THEN 0.6 * fit + CASE WHEN status = 'BLOCKED' THEN 0.3 ELSE 0.15 END
           WHEN 'goal' THEN coalesce(1 - place * 0.05, fit)
           WHEN 'deal' THEN 0.2 * fit + CASE WHEN status = 'OPEN' THEN 0.5 ELSE 0.1 END + 0.3 * number / 100
           WHEN 'risk' THEN 0.5 * fit + number / 10
           WHEN 'opportunity' THEN 0.5 * fit + CASE WHEN status IN ('OPEN', 'PURSUING') THEN 0.3 ELSE 0.1 END
           WHEN 'project' THEN coalesce(place * 0 + 1, fit)
           WHEN 'report' THEN 0.8 * fit + 0.1
           WHEN 'note' THEN 0.6 * fit + 0.4 * greatest(0, 1 - apart / 90)
           WHEN 'insight' THEN 0.4 * fit + number / 10 + 0.1 * greatest(0, 1 - apart / 30)
           ELSE coalesce(place * 0 + 1, 0.8 * fit + 0.1) END AS DOUBLE), 6) AS rank
       FROM f, k WHERE fit > 0 OR (place IS NOT NULL AND type IN ('goal', 'company', 'person', 'project'))""",
)
def q156(spark, sf):
    """The ranks that all parts have under two terms, taken as records of each of fifteen kinds."""
    size = F.col("p_size")
    status = F.element_at(F.array(*map(F.lit, ("OPEN", "NEEDED", "BLOCKED", "PURSUING", "DONE"))), (size % 5 + 1).cast("int"))
    due = F.date_add(F.lit("2001-06-01").cast("date"), (size * 3).cast("int"))
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_type").alias("body"), status.alias("status"), due.alias("due"), due.alias("at"), size.alias("number"), F.when(F.col("p_partkey") < 4, F.col("p_partkey")).alias("place"))
    found = ranks.ranked(dict.fromkeys(KINDS, rows), ["widget", "ring"], F.lit(AS_OF).cast("timestamp"))
    return found.select("type", "id", F.round("rank", 6).alias("rank"))
