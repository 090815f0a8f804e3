"""Intake: shapes of sources, participants, deletions, stages, noise, mentions, validation and changes, over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import dates, finance, scoring, text
from tidemark.operators import intake, resolution, spotting
from tidemark.plans.registry import query, table


@query(
    "q110_chat_as_mail",
    r"""SELECT 'chat:' || conv_id || ':' || turn AS item, CAST(conv_id AS VARCHAR) AS thread, CASE WHEN conv_id % 2 = 0 THEN 'Topic ' || conv_id ELSE CASE WHEN length(line) > 60 THEN left(regexp_replace(left(line, 61), '\s+\S*$', ''), 60) ELSE line END END AS subject, role AS sender, 'chat' AS kind FROM (SELECT *, trim(regexp_extract(text, '^\s*([^\n]*)', 1)) AS line FROM conversations)
       UNION ALL SELECT 'mail:' || doc_id, 'm' || doc_id, source, lang, 'mail' FROM documents""",
)
def q110(spark, sf):
    """Chat messages in the shape of mail, united with mail."""
    chat = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    topic = F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit("Topic "), F.col("conv_id").cast("string"))).otherwise(" ")
    mail = table(spark, sf, "documents").select(
        F.concat(F.lit("mail:"), F.col("doc_id").cast("string")).alias("item"), F.concat(F.lit("m"), F.col("doc_id").cast("string")).alias("thread"), F.col("source").alias("subject"), F.col("lang").alias("sender"), F.lit("mail").alias("kind")
    )
    as_mail = intake.chat_as_mail(chat, "conv_id", "role", "text", "turn", topic).select("item", "thread", "subject", "sender", F.lit("chat").alias("kind"))
    return as_mail.unionByName(mail)


@query(
    "q111_calendar_window",
    """SELECT event_id, CASE WHEN value > 90 THEN 'CANCELLED' ELSE 'CONFIRMED' END AS status, strftime(timezone('UTC', timezone('Europe/Berlin', ts)), '%Y-%m-%d %H:%M') AS starts FROM events WHERE ts >= TIMESTAMP '2024-01-20' - INTERVAL 9 DAY AND ts < TIMESTAMP '2024-01-20' + INTERVAL 18 DAY""",
)
def q111(spark, sf):
    """Calendar events within a window around a day, wall-clock times of a named zone read as instants; cancelled ones say so."""
    zones = F.create_map(*(F.lit(x) for x in ("W. Europe Standard Time", "Europe/Berlin", "Eastern Standard Time", "America/New_York")))
    zone = F.coalesce(zones[F.lit("W. Europe Standard Time")], F.lit("UTC"))
    ts = F.col("ts").cast("timestamp_ntz")
    inside = table(spark, sf, "events").where((F.col("ts") >= "2024-01-11") & (F.col("ts") < "2024-02-07"))
    return inside.select("event_id", F.when(F.col("value") > 90, "CANCELLED").otherwise("CONFIRMED").alias("status"), F.date_format(F.convert_timezone(zone, F.lit("UTC"), ts), "yyyy-MM-dd HH:mm").alias("starts"))


@query(
    "q112_participants",
    """SELECT o_orderkey, CASE WHEN o_custkey % 10 = o_orderkey % 10 THEN 'u' || (o_custkey % 10) || '@x.io=Ada' ELSE 'u' || (o_custkey % 10) || '@x.io=|u' || (o_orderkey % 10) || '@x.io=Ada' END AS people FROM orders""",
)
def q112(spark, sf):
    """Participants of each item, one an address, with the better name."""
    a, b = (F.concat(F.lit("u"), (F.col(k) % 10).cast("string"), F.lit("@x.io")) for k in ("o_custkey", "o_orderkey"))
    person = lambda e, n: F.struct(e.alias("email"), n.alias("name"))
    people = F.array(person(F.upper(a), a), person(b, F.lit("Ada ")), person(F.lit(None).cast("string"), F.lit("nobody")), person(b, F.lit("Bob")))
    found = intake.unique_participants(people)
    return table(spark, sf, "orders").select("o_orderkey", F.array_join(F.transform(found, lambda p: F.concat(p["email"], F.lit("="), F.coalesce(p["name"], F.lit("")))), "|").alias("people"))


@query(
    "q113_newest_evidence",
    """WITH d AS (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k, ts FROM events)
       SELECT user_id, event_type, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY ts, event_id) AS evidence FROM d WHERE k <= 20 GROUP BY 1, 2""",
)
def q113(spark, sf):
    """The twenty newest items behind each relation, oldest first."""
    rows = table(spark, sf, "events").select("user_id", "event_type", "event_id", "ts")
    found = intake.newest_evidence(rows, ["user_id", "event_type"], "event_id", "ts")
    return found.select("user_id", "event_type", F.array_join(F.transform("evidence", lambda e: e.cast("string")), ",").alias("evidence"))


@query(
    "q114_debounce",
    """WITH g AS (SELECT event_type, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY event_type ORDER BY ts) < INTERVAL 600 SECOND THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT event_type, ts, sum(fresh) OVER (PARTITION BY event_type ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
       SELECT event_type, max(ts) + INTERVAL 600 SECOND AS due, count(*) AS n FROM s GROUP BY event_type, k""",
)
def q114(spark, sf):
    """Requests that follow each other within ten minutes make one run, due ten minutes after the last."""
    rows = table(spark, sf, "events").select("event_type", F.col("ts").cast("timestamp").alias("ts"))
    return intake.debounced(rows, "event_type", "ts", 600).withColumn("due", F.col("due").cast("timestamp_ntz"))


@query(
    "q115_deletions",
    """SELECT doc_id, coalesce(source, 'none') = 'src1' OR (coalesce(source, 'none') = 'src2' AND coalesce(lang, 'none') = 'de') OR doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS gone FROM documents""",
)
def q115(spark, sf):
    """Items that a deletion upstream takes along: their own path or a folder above."""
    docs = table(spark, sf, "documents").select("doc_id", F.coalesce("source", F.lit("none")).alias("source"), F.coalesce("lang", F.lit("none")).alias("lang"))
    items = docs.select("doc_id", F.concat_ws("/", F.lit(""), "source", "lang", F.col("doc_id").cast("string")).alias("path"))
    toxic = items.join(table(spark, sf, "labels").where("toxic = 1").select("doc_id"), "doc_id", "left_semi").select("path")
    deleted = spark.createDataFrame([("/src1/",), ("/src2/de",), ("/src",)], "path string").unionByName(toxic)
    return intake.with_deletions(items, deleted, "path").select("doc_id", "gone")


@query(
    "q116_merged_parts",
    """SELECT o_custkey, min(o_orderkey) AS o_orderkey, o_orderpriority FROM orders GROUP BY o_custkey, o_orderpriority""",
)
def q116(spark, sf):
    """What the parts of one source yielded, each title once, whatever the order and form of its words."""
    k = F.col("o_orderkey")
    level = F.regexp_replace(F.substring("o_orderpriority", 3, 20), " ", "")
    title = F.when(k % 2 == 0, F.concat(F.lit("Signing contract "), level)).otherwise(F.concat(level, F.lit(" contracts: sign!")))
    parts = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderpriority", title.alias("title"))
    return intake.merged_parts(parts, "o_custkey", "o_orderkey", "title").select("o_custkey", "o_orderkey", "o_orderpriority")


@query(
    "q117_titles_and_labels",
    """SELECT o_orderkey, 'Plan ' || o_custkey || ' costs' AS title, strftime(o_orderdate, '%b ') || day(o_orderdate) AS short, strftime(o_orderdate, '%B %Y') AS month, strftime(o_orderdate, '%a, %b ') || day(o_orderdate) || strftime(o_orderdate, ', %Y') AS long FROM orders""",
)
def q117(spark, sf):
    """Titles without endings and version marks, and days as people write them."""
    k = F.col("o_orderkey") % 4
    ending = F.when(k == 0, "_v2.docx").when(k == 1, " (final).pdf").when(k == 2, " - draft").otherwise("")
    title = intake.clean_title(F.concat(F.lit("Plan_"), F.col("o_custkey").cast("string"), F.lit("_costs"), ending))
    day = F.to_date("o_orderdate")
    return table(spark, sf, "orders").select("o_orderkey", title.alias("title"), F.date_format(day, "MMM d").alias("short"), F.date_format(day, "MMMM yyyy").alias("month"), F.date_format(day, "EEE, MMM d, yyyy").alias("long"))


@query(
    "q118_noise_gate",
    """WITH f AS (SELECT doc_id, 0.5 + CASE WHEN n_chars < 300 THEN -0.3 ELSE 0 END + CASE WHEN source = 'src1' THEN 0.2 ELSE 0 END + CASE WHEN lang <> 'en' THEN -0.15 ELSE 0 END + CASE WHEN contains(lower(text), '@') THEN 0.1 ELSE 0 END + CASE WHEN contains(lower(text), 'unsubscribe') THEN -0.4 ELSE 0 END AS s FROM documents)
       SELECT doc_id, CAST(greatest(0, least(1, round(s, 6))) AS DOUBLE) AS relevance, CASE WHEN round(s, 6) < 0.4 THEN 'noise' ELSE 'kept' END AS verdict FROM f""",
)
def q118(spark, sf):
    """A document's relevance from what is known of it, and whether it is noise."""
    low = F.lower("text")
    facts = {"short": F.col("n_chars") < 300, "known": F.col("source") == "src1", "foreign": F.col("lang") != "en", "address": F.contains(low, F.lit("@")), "bulk": F.contains(low, F.lit("unsubscribe"))}
    gate = intake.noise_gate(facts, {"short": -0.3, "known": 0.2, "foreign": -0.15, "address": 0.1, "bulk": -0.4}, 0.5, 0.4)
    return table(spark, sf, "documents").select("doc_id", *(v.alias(k) for k, v in gate.items()))


@query(
    "q119_mentions",
    r"""WITH w AS (SELECT conv_id, turn, ' ' || trim(regexp_replace(lower(role || ' said ' || conv_id || ': red widget, small  bolt. Red-widget ' || turn), '[^a-z0-9]+', ' ', 'g')) || ' ' AS t FROM conversations), n AS (SELECT DISTINCT p_name FROM part)
        SELECT conv_id * 100 + turn AS item, p_name AS entity, (length(t) - length(replace(t, ' ' || p_name || ' ', ' '))) // (length(p_name) + 1) AS n FROM w JOIN n ON contains(t, ' ' || p_name || ' ')""",
)
def q119(spark, sf):
    """Names of a lexicon in texts, as whole words, whatever stands between the words."""
    said = F.concat("role", F.lit(" said "), F.col("conv_id").cast("string"), F.lit(": red widget, small  bolt. Red-widget "), F.col("turn").cast("string"))
    items = table(spark, sf, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("item"), said.alias("text"))
    lexicon = table(spark, sf, "part").select(F.col("p_name").alias("entity"), F.col("p_name").alias("name")).distinct()
    return spotting.mentions(items, "item", "text", lexicon)


@query(
    "q120_validation",
    """SELECT o_orderkey, CASE WHEN o_custkey % 11 = 0 THEN 'title' WHEN o_totalprice < 20000 THEN 'evidence' WHEN o_orderdate < TIMESTAMP '1995-06-01' OR o_orderdate > TIMESTAMP '2001-01-01' THEN 'date' END AS reason FROM orders""",
)
def q120(spark, sf):
    """Extracted records with the first check that they fail."""
    title = F.when(F.col("o_custkey") % 11 == 0, None).otherwise("x")
    checks = {"title": F.length(title) > 0, "evidence": F.col("o_totalprice") >= 20000, "date": F.col("o_orderdate").between("1995-06-01", "2001-01-01")}
    return intake.validated(table(spark, sf, "orders"), checks).select("o_orderkey", "reason")


@query(
    "q121_change_detection",
    """WITH o AS (SELECT o_orderkey AS k, o_orderstatus AS status, CAST(o_orderdate AS DATE) AS due, o_totalprice AS amount FROM orders), a AS (SELECT * FROM o WHERE k % 7 <> 0),
            b AS (SELECT k, CASE WHEN k % 5 = 0 THEN 'F' ELSE status END AS status, CASE WHEN k % 3 = 0 THEN due + 10 WHEN k % 3 = 1 AND k % 4 = 0 THEN due - 2 ELSE due END AS due, CASE WHEN k % 8 = 0 THEN amount * 1.2 WHEN k % 8 = 1 THEN amount * 0.8 ELSE amount END AS amount FROM o WHERE k % 11 <> 0)
       SELECT coalesce(a.k, b.k) AS k, kind FROM a FULL JOIN b ON a.k = b.k, (VALUES ('added'), ('removed'), ('won'), ('delayed'), ('pulled_in'), ('grew'), ('shrank')) v(kind)
       WHERE CASE kind WHEN 'added' THEN a.k IS NULL WHEN 'removed' THEN b.k IS NULL WHEN 'won' THEN a.status <> 'F' AND b.status = 'F' WHEN 'delayed' THEN b.due > a.due WHEN 'pulled_in' THEN b.due < a.due WHEN 'grew' THEN b.amount > a.amount * 1.1 ELSE b.amount < a.amount * 0.9 END""",
)
def q121(spark, sf):
    """Seven kinds of change from one state of the deals to the next."""
    deals = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("status"), F.to_date("o_orderdate").alias("due"), F.col("o_totalprice").alias("amount"))
    k = F.col("k")
    after = deals.where(k % 11 != 0).select(
        "k", F.when(k % 5 == 0, "F").otherwise(F.col("status")).alias("status"),
        F.when(k % 3 == 0, F.date_add("due", 10)).when((k % 3 == 1) & (k % 4 == 0), F.date_sub("due", 2)).otherwise(F.col("due")).alias("due"),
        F.when(k % 8 == 0, F.col("amount") * 1.2).when(k % 8 == 1, F.col("amount") * 0.8).otherwise(F.col("amount")).alias("amount"),
    )
    old, new = (lambda c: F.col(f"old.{c}")), (lambda c: F.col(f"new.{c}"))
    return intake.changes(deals.where(k % 7 != 0), after, "k", {
        "added": F.col("old").isNull(), "removed": F.col("new").isNull(), "won": (old("status") != "F") & (new("status") == "F"), "delayed": new("due") > old("due"),
        "pulled_in": new("due") < old("due"), "grew": new("amount") > old("amount") * 1.1, "shrank": new("amount") < old("amount") * 0.9,
    })


@query(
    "q122_stage_chain",
    """WITH d AS (SELECT doc_id % 5 AS done, text IS NOT NULL AND length(text) > 0 AS parsed, lang IS NOT NULL AS known FROM documents)
       SELECT 'parse' AS stage, count(*) FILTER (done <= 0) AS waiting, count(*) FILTER (done > 0) AS finished FROM d
       UNION ALL SELECT 'resolve', count(*) FILTER (parsed AND done <= 1), count(*) FILTER (parsed AND done > 1) FROM d UNION ALL SELECT 'write', count(*) FILTER (parsed AND known AND done <= 2), count(*) FILTER (parsed AND known AND done > 2) FROM d""",
)
def q122(spark, sf):
    """How many items each stage of a chain has finished and how many wait for it."""
    docs = table(spark, sf, "documents")
    stages = {"parse": F.coalesce(F.length("text") > 0, F.lit(False)), "resolve": F.col("lang").isNotNull(), "write": F.lit(True)}
    return intake.staged(docs, stages, F.col("doc_id") % 5)


@query(
    "q123_text_decoding",
    "SELECT doc_id, 'Zoë ' || doc_id AS decoded FROM documents",
)
def q123(spark, sf):
    """Bytes in UTF-8, UTF-16 with a mark, and Latin-1, as text without the mark."""
    said = F.concat(F.lit("Zoë "), F.col("doc_id").cast("string"))
    k = F.col("doc_id") % 3
    raw = F.when(k == 0, F.concat(F.unhex(F.lit("EFBBBF")), F.encode(said, "UTF-8"))).when(k == 1, F.encode(said, "UTF-16")).otherwise(F.encode(said, "ISO-8859-1"))
    return table(spark, sf, "documents").select("doc_id", raw.alias("raw")).select("doc_id", text.decoded(F.col("raw")).alias("decoded"))


@query(
    "q124_strict_days_and_money",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS day, CAST(CASE o_orderkey % 4 WHEN 0 THEN (o_orderkey % 1000) * 1000.0 WHEN 1 THEN (o_orderkey % 1000) * 1000000.0 WHEN 2 THEN 1000.0 + o_orderkey % 1000 END AS DOUBLE) AS amount FROM orders""",
)
def q124(spark, sf):
    """Days in the one form that counts, and amounts of money in prose."""
    k = F.col("o_orderkey")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    written = F.when(k % 3 == 0, day).when(k % 3 == 1, F.concat(day, F.lit(" "))).otherwise("2001-02-30")
    n = (k % 1000).cast("string")
    prose = F.when(k % 4 == 0, F.concat(F.lit("about $"), n, F.lit("k or so"))).when(k % 4 == 1, F.concat(F.lit("$ "), n, F.lit("M"))).when(k % 4 == 2, F.concat(F.lit("paid $1,"), F.lpad(n, 3, "0"), F.lit("."))).otherwise(F.concat(n, F.lit(" euros")))
    return table(spark, sf, "orders").select("o_orderkey", dates.day_key(dates.parse_day(written)).alias("day"), text.money_value(prose).alias("amount"))


@query(
    "q125_balances",
    "SELECT sum(CAST(round(c_acctbal * 100) AS BIGINT)) FILTER (c_custkey % 3 < 2) / 100 AS usd, CASE WHEN count(*) FILTER (c_custkey % 3 = 2) > 0 THEN 'EUR' ELSE '' END AS others FROM customer",
)
def q125(spark, sf):
    """The sum of dollar balances in minor units, and the currencies besides."""
    k = F.col("c_custkey") % 3
    accounts = table(spark, sf, "customer").select(F.round(F.col("c_acctbal") * 100).cast("long").alias("amount"), F.when(k == 1, "usd").when(k == 2, "eur").alias("currency"))
    return finance.balances(accounts).select("usd", F.array_join("others", ",").alias("others"))


@query(
    "q126_contract_signals",
    """WITH e AS (SELECT o_orderkey AS k, o_orderdate AS sent, CASE o_orderkey % 4 WHEN 0 THEN 'sent' WHEN 1 THEN 'completed' WHEN 2 THEN 'declined' ELSE 'draft' END AS status FROM orders)
       SELECT k, 'awaiting' AS signal FROM e WHERE status = 'sent' AND k % 8 = 0 UNION ALL SELECT k, 'stalled' FROM e WHERE status = 'sent' AND epoch(TIMESTAMP '2001-08-01') - epoch(sent) > 86400 * 700
       UNION ALL SELECT k, status FROM e WHERE status IN ('completed', 'declined') AND epoch(TIMESTAMP '2001-08-01') - epoch(sent) <= 86400 * 14""",
)
def q126(spark, sf):
    """What contracts out for signature call for, on a first sync."""
    k = F.col("o_orderkey")
    status = F.when(k % 4 == 0, "Sent").when(k % 4 == 1, "completed").when(k % 4 == 2, "declined").otherwise("draft")
    signer = lambda email, s: F.struct(F.lit(email).alias("email"), F.lit(s).alias("status"))
    signers = F.when(k % 8 == 0, F.array(signer("Me@x.io", "sent"), signer("you@x.io", "delivered"))).otherwise(F.array(signer("me@x.io", "completed"), signer("you@x.io", "sent")))
    at = F.col("o_orderdate").cast("timestamp")
    rows = table(spark, sf, "orders").select(k.alias("envelope_id"), status.alias("status"), F.lit("me@x.io").alias("sender"), at.alias("sent_at"), at.alias("done_at"), signers.alias("signers"))
    return resolution.envelope_signals(rows, "me@x.io", F.lit("2001-08-01"), 700, True).select(F.col("envelope_id").alias("k"), "signal")


@query(
    "q127_insight_upsert",
    """WITH c AS (SELECT c_custkey AS k, 'old' AS title, CASE WHEN c_custkey % 5 = 0 THEN 'DISMISSED' ELSE 'NEW' END AS status FROM customer WHERE c_custkey % 2 = 0), n AS (SELECT o_custkey AS k, first(o_orderkey ORDER BY o_totalprice DESC, 'o' || o_orderkey) AS o FROM orders GROUP BY 1)
       SELECT coalesce(c.k, n.k) AS k, CASE WHEN c.status = 'DISMISSED' THEN c.title ELSE coalesce('o' || n.o, c.title) END AS title, coalesce(c.status, 'NEW') AS status, CASE WHEN c.k IS NULL THEN 0 ELSE 1 END + CASE WHEN n.k IS NULL THEN 0 ELSE 1 END AS seen FROM c FULL JOIN n ON c.k = n.k""",
)
def q127(spark, sf):
    """Fresh insights folded into the current ones: the most important of a fingerprint counts, what was dismissed stays so."""
    k = F.col("c_custkey")
    current = table(spark, sf, "customer").where("c_custkey % 2 = 0").select(k.alias("fingerprint"), F.lit("old").alias("title"), F.lit(None).cast("string").alias("link"), F.when(k % 5 == 0, "DISMISSED").otherwise("NEW").alias("status"), F.lit(1).alias("seen"))
    fresh = table(spark, sf, "orders").select(F.col("o_custkey").alias("fingerprint"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("title"), F.lit(None).cast("string").alias("link"), F.col("o_totalprice").alias("importance"))
    return resolution.merge_insights(current, fresh).select(F.col("fingerprint").alias("k"), "title", "status", "seen")


@query(
    "q128_duplicate_actions",
    """SELECT o_orderkey + 1000000000 AS new_id, o_orderkey AS old_id FROM orders WHERE o_orderkey % 2 = 0""",
)
def q128(spark, sf):
    """New actions that say the same as an existing one of their context."""
    k = F.col("o_orderkey")
    rows = table(spark, sf, "orders")
    of = lambda title, shift: rows.select((k + shift).alias("id"), title.alias("title"), k.cast("string").alias("context"), F.concat(F.lit("owner"), k.cast("string")).alias("owner"))
    old = of(F.concat(F.lit("Send the signed contract "), k.cast("string"), F.lit(" to Vantage")), 0)
    new = of(F.when(k % 2 == 0, F.concat(F.lit("vantage: contracts "), k.cast("string"), F.lit(" signed, sending"))).otherwise("Hire a cook"), 1_000_000_000)
    return resolution.duplicate_actions(new, old).select("new_id", "old_id")


@query(
    "q129_weights",
    """WITH w AS (SELECT c_nationkey AS grp, c_mktsegment AS factor, sum(c_acctbal) AS weight FROM customer GROUP BY 1, 2), f AS (SELECT n_nationkey AS grp, factor FROM nation, (SELECT DISTINCT c_mktsegment AS factor FROM customer)),
             v AS (SELECT f.grp, f.factor, greatest(0, coalesce(weight, 1000)) AS v FROM f LEFT JOIN w ON w.grp = f.grp AND w.factor = f.factor)
        SELECT grp, factor, round(CASE WHEN sum(v) OVER (PARTITION BY grp) > 0 THEN v * 100 / sum(v) OVER (PARTITION BY grp) ELSE 20.0 END, 6) AS weight FROM v""",
)
def q129(spark, sf):
    """Each nation's weights of the segments, brought to a sum of a hundred; what is negative counts as 0 and what is missing as the default."""
    customer = table(spark, sf, "customer")
    given = customer.groupBy(F.col("c_nationkey").alias("grp"), F.col("c_mktsegment").alias("factor")).agg(F.sum("c_acctbal").alias("weight"))
    defaults = customer.select(F.col("c_mktsegment").alias("factor")).distinct().withColumn("weight", F.lit(1000.0))
    found = scoring.normalised(given, table(spark, sf, "nation").select(F.col("n_nationkey").alias("grp")), defaults)
    return found.select("grp", "factor", F.round("weight", 6).alias("weight"))
