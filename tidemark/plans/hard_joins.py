"""As-of, range, recursive, fuzzy and greedy joins, and ranked selections, over the driver tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import rounding, text
from tidemark.operators import groups, joins, similar, upsert
from tidemark.plans.registry import query, table


@query(
    "q25_asof_backward",
    """SELECT a.event_id, (SELECT max(b.value) FROM events b WHERE b.user_id = a.user_id AND b.event_type = 'purchase' AND b.ts =
         (SELECT max(c.ts) FROM events c WHERE c.user_id = a.user_id AND c.event_type = 'purchase' AND c.ts <= a.ts)) AS last_purchase
       FROM events a WHERE a.event_type = 'error'""",
)
def q25(spark, sf):
    """For each error, the value of the user's last purchase up to then."""
    events = table(spark, sf, "events").select("event_id", "user_id", "ts", "event_type", "value")
    asked = events.where("event_type = 'error'").select("event_id", "user_id", "ts")
    return joins.asof_backward(asked, events.where("event_type = 'purchase'").select("user_id", "ts", "value"), "user_id", "ts", "ts", "value", "last_purchase").select("event_id", "last_purchase")


@query(
    "q26_asof_forward",
    """SELECT a.event_id, coalesce((SELECT min(b.value) FROM events b WHERE b.user_id = a.user_id AND b.event_type = 'signup' AND b.ts =
         (SELECT min(c.ts) FROM events c WHERE c.user_id = a.user_id AND c.event_type = 'signup' AND c.ts > a.ts)), -1.0) AS held
       FROM events a WHERE a.event_type = 'error'""",
)
def q26(spark, sf):
    """The value that held at an instant: what the first later change replaced, else the current one."""
    events = table(spark, sf, "events").select("event_id", "user_id", "ts", "event_type", "value")
    asked = events.where("event_type = 'error'").select("event_id", "user_id", "ts")
    changes = events.where("event_type = 'signup'").select("user_id", "ts", "value")
    return joins.asof_forward(asked, changes, "user_id", "ts", "ts", "value", F.lit(-1.0), "held").select("event_id", "held")


@query(
    "q27_range_best_match",
    """WITH p AS (SELECT a.event_id AS note_id, b.event_id AS meeting_id, 0.5 * CAST(a.event_type = b.event_type AS INT) + 0.25 * (1 - abs(epoch(a.ts) - epoch(b.ts)) / 2700.0) AS score
         FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_id <> b.event_id AND abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 2700000000)
       SELECT note_id, meeting_id, round(score, 6) AS score FROM p QUALIFY row_number() OVER (PARTITION BY note_id ORDER BY round(score, 9) DESC, meeting_id) = 1""",
)
def q27(spark, sf):
    """Each event's best match among the same user's events within 45 minutes, by kind and closeness."""
    events = table(spark, sf, "events")
    a = events.select("user_id", F.col("event_id").alias("note_id"), F.col("ts").alias("a_ts"), F.col("event_type").alias("a_type"))
    b = events.select("user_id", F.col("event_id").alias("meeting_id"), F.col("ts").alias("b_ts"), F.col("event_type").alias("b_type"))
    near = joins.within_range(a, b, ["user_id"], F.col("a_ts"), F.col("b_ts"), 2700).where("note_id <> meeting_id")
    gap = F.abs(F.unix_micros(F.col("a_ts").cast("timestamp")) - F.unix_micros(F.col("b_ts").cast("timestamp"))) / 1e6
    scored = near.withColumn("score", 0.5 * (F.col("a_type") == F.col("b_type")).cast("int") + 0.25 * (1 - gap / 2700.0))
    best = groups.top_per_group(scored, ["note_id"], [F.desc(F.round("score", 9)), F.asc("meeting_id")])
    return best.select("note_id", "meeting_id", F.round("score", 6).alias("score"))


@query(
    "q28_recursive_family",
    """WITH RECURSIVE e AS (SELECT p_partkey AS child, p_partkey // 3 AS parent FROM part WHERE p_partkey // 3 <> p_partkey),
       f AS (SELECT 1::BIGINT AS root, 1::BIGINT AS node, 0 AS depth UNION SELECT 2::BIGINT, 2::BIGINT, 0 UNION SELECT f.root, e.child, f.depth + 1 FROM f JOIN e ON e.parent = f.node WHERE f.depth < 4)
       SELECT root, node, depth FROM f""",
)
def q28(spark, sf):
    """All parts below two roots of a hierarchy, four levels down."""
    part = table(spark, sf, "part")
    edges = part.select(F.floor(F.col("p_partkey") / 3).alias("parent"), F.col("p_partkey").alias("child")).where("parent <> child")
    return joins.family(edges, spark.createDataFrame([(1,), (2,)], "root long"), 4)


@query(
    "q28b_recursive_sql",
    """WITH RECURSIVE up AS (SELECT p_partkey AS node, p_partkey AS place, 0 AS steps FROM part UNION ALL SELECT node, place // 3, steps + 1 FROM up WHERE place > 2 AND steps < 6)
       SELECT node, min(place) AS top, max(steps) AS steps FROM up GROUP BY 1""",
)
def q28b(spark, sf):
    """The climb of every part to the top of the hierarchy, at most six levels, as a recursive query.

    Spark bounds the rows of a recursion by a setting, a million by default; the levels bound this one.
    """
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")
    table(spark, sf, "part").select("p_partkey").createOrReplaceTempView("tidemark_part")
    return spark.sql("""
        WITH RECURSIVE up (node, at, steps) AS (
            SELECT p_partkey, p_partkey, 0 FROM tidemark_part
            UNION ALL SELECT node, at DIV 3, steps + 1 FROM up WHERE at > 2 AND steps < 6)
        SELECT node, min(at) AS top, max(steps) AS steps FROM up GROUP BY node""")


@query(
    "q29_neighbours",
    """SELECT 'out' AS direction, event_type AS relation, CAST(json_extract_string(props, '$.k') AS BIGINT) AS other, count(DISTINCT event_id) AS evidence, max(ts) AS last_seen
       FROM events WHERE user_id = 7 GROUP BY 1, 2, 3
       UNION ALL SELECT 'in', event_type, user_id, count(DISTINCT event_id), max(ts) FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) = 7 GROUP BY 1, 2, 3
       ORDER BY evidence DESC, direction, relation, other LIMIT 25""",
)
def q29(spark, sf):
    """A node's neighbours in both directions, with evidence, strongest first."""
    events = table(spark, sf, "events")
    edges = events.select(
        F.col("user_id").alias("from_id"), F.col("event_type").alias("relation"), F.get_json_object("props", "$.k").cast("long").alias("to_id"),
        F.col("value").alias("confidence"), F.col("event_id").alias("source_id"), F.col("ts").alias("seen_at"),
    )
    touching = edges.where((F.col("from_id") == 7) | (F.col("to_id") == 7))
    return joins.neighbours(upsert.fold_edges(touching), F.lit(7), 25)


@query(
    "q29b_fold_edges",
    """SELECT user_id AS from_id, event_type AS relation, CAST(json_extract_string(props, '$.k') AS BIGINT) AS to_id, max(value) AS confidence, count(DISTINCT event_id) AS evidence, min(ts) AS first_seen, max(ts) AS last_seen FROM events GROUP BY 1, 2, 3""",
)
def q29b(spark, sf):
    """Relation upsert: the strongest confidence, distinct evidence, first and last sighting of each edge."""
    events = table(spark, sf, "events")
    return upsert.fold_edges(events.select(
        F.col("user_id").alias("from_id"), F.col("event_type").alias("relation"), F.get_json_object("props", "$.k").cast("long").alias("to_id"),
        F.col("value").alias("confidence"), F.col("event_id").alias("source_id"), F.col("ts").alias("seen_at"),
    ))


@query(
    "q30_fuzzy_levenshtein",
    """WITH n AS (SELECT p_name, count(*) AS parts FROM part GROUP BY 1)
       SELECT a.p_name AS a, b.p_name AS b, levenshtein(a.p_name, b.p_name) AS distance, a.parts AS a_parts, b.parts AS b_parts FROM n a JOIN n b ON a.p_name < b.p_name
       WHERE 1 - levenshtein(a.p_name, b.p_name) / greatest(length(a.p_name), length(b.p_name)) >= 0.75""",
)
def q30(spark, sf):
    """Names of parts that are alike by edit distance, with the parts that bear them; each distinct name counts once."""
    names = table(spark, sf, "part").groupBy("p_name").agg(F.count("*").alias("parts"))
    pairs = similar.edit_pairs(names, "p_name", 0.75)
    parts = lambda side: names.select(F.col("p_name").alias(side), F.col("parts").alias(f"{side}_parts"))
    return pairs.join(parts("a"), "a").join(parts("b"), "b").select("a", "b", "distance", "a_parts", "b_parts")


@query(
    "q31_jaro_winkler",
    """WITH n AS (SELECT DISTINCT p_name FROM part)
       SELECT a.p_name AS a, b.p_name AS b FROM n a JOIN n b ON a.p_name < b.p_name AND left(a.p_name, 2) = left(b.p_name, 2) WHERE jaro_winkler_similarity(a.p_name, b.p_name) >= 0.88""",
)
def q31(spark, sf):
    """Distinct names that begin alike and have a Jaro-Winkler likeness of 0.88 or more."""
    return similar.jaro_winkler_pairs(table(spark, sf, "part").select("p_name"), "p_name", 0.88, 2)


@query(
    "q32_title_similarity",
    r"""WITH w AS (SELECT conv_id, turn, list_distinct(list_filter(regexp_split_to_array(lower(regexp_replace(text, '[^A-Za-z0-9]+', ' ', 'g')), ' '), lambda x: length(x) > 2)) AS ws FROM conversations),
       p AS (SELECT a.conv_id, a.turn AS a, b.turn AS b, len(list_intersect(a.ws, b.ws)) AS n, len(list_distinct(list_concat(a.ws, b.ws))) AS u FROM w a JOIN w b ON a.conv_id = b.conv_id AND a.turn < b.turn)
       SELECT conv_id, a, b, round(CASE WHEN u > 0 THEN n / u ELSE 0 END, 6) AS likeness FROM p WHERE u > 0 AND n / u >= 0.1""",
)
def q32(spark, sf):
    """Turns of a conversation that share words of three letters or more: Jaccard 0.1 and up."""
    words = F.array_distinct(F.filter(F.split(F.lower(F.regexp_replace("text", "[^A-Za-z0-9]+", " ")), " "), lambda w: F.length(w) > 2))
    rows = table(spark, sf, "conversations").select("conv_id", "turn", words.alias("ws"))
    return joins.jaccard_pairs(rows, "conv_id", "turn", "ws", 0.1).withColumn("likeness", F.round("likeness", 6))


@query(
    "q33_transfer_pairs",
    """WITH l AS (SELECT l_orderkey * 100000 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS id, l_quantity AS size, l_returnflag AS flag, strftime(l_shipdate, '%Y-%m-%d') AS day FROM lineitem WHERE l_returnflag IN ('A', 'R')),
       n AS (SELECT *, row_number() OVER (PARTITION BY day, size, flag ORDER BY id) AS k FROM l)
       SELECT a.id AS out_id, b.id AS in_id FROM n a JOIN n b ON a.day = b.day AND a.size = b.size AND a.k = b.k AND a.flag = 'A' AND b.flag = 'R'""",
)
def q33(spark, sf):
    """Legs of opposite sign, equal size and day, in different accounts, paired greedily in order of id."""
    line = table(spark, sf, "lineitem").where("l_returnflag IN ('A', 'R')")
    number = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"))
    legs = line.select(
        (F.col("l_orderkey") * 100000 + number).alias("id"), F.when(F.col("l_returnflag") == "A", -F.col("l_quantity")).otherwise(F.col("l_quantity")).alias("amount"),
        F.col("l_returnflag").alias("account"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("day"),
    )
    return joins.opposite_pairs(legs, ["day"], "amount", "account", "id")


@query(
    "q34_bag_difference",
    """WITH a AS (SELECT l_suppkey AS k, l_returnflag AS v, row_number() OVER (PARTITION BY l_suppkey, l_returnflag) AS c FROM lineitem WHERE year(l_shipdate) = 1996),
       b AS (SELECT l_suppkey AS k, l_returnflag AS v, row_number() OVER (PARTITION BY l_suppkey, l_returnflag) AS c FROM lineitem WHERE year(l_shipdate) = 1997),
       g AS (SELECT k, v AS old, row_number() OVER (PARTITION BY k ORDER BY v, c) AS n FROM a ANTI JOIN b USING (k, v, c)),
       h AS (SELECT k, v AS new, row_number() OVER (PARTITION BY k ORDER BY v, c) AS n FROM b ANTI JOIN a USING (k, v, c))
       SELECT coalesce(g.k, h.k) AS k, g.old, h.new FROM g FULL JOIN h ON g.k = h.k AND g.n = h.n""",
)
def q34(spark, sf):
    """What changed in a key's bag of values from one year to the next, changed values paired by position."""
    line = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("k"), F.col("l_returnflag").alias("v"), F.year("l_shipdate").alias("y"))
    return joins.bag_difference(line.where("y = 1996").drop("y"), line.where("y = 1997").drop("y"), "k", "v")


@query(
    "q34b_multiset_overlap",
    r"""WITH w AS (SELECT conv_id, turn, unnest(regexp_split_to_array(lower(text), '\s+')) AS t FROM conversations WHERE turn IN (0, 1)), c AS (SELECT conv_id, turn, t, count(*) AS n FROM w WHERE t <> '' GROUP BY 1, 2, 3),
       j AS (SELECT coalesce(a.conv_id, b.conv_id) AS conv_id, length(coalesce(a.t, b.t)) AS size, coalesce(a.n, 0) AS x, coalesce(b.n, 0) AS y FROM (SELECT * FROM c WHERE turn = 0) a FULL JOIN (SELECT * FROM c WHERE turn = 1) b ON a.conv_id = b.conv_id AND a.t = b.t)
       SELECT conv_id, round(1 - 2 * sum(least(x, y) * size) / sum((x + y) * size), 6) AS changed FROM j GROUP BY 1""",
)
def q34b(spark, sf):
    """The share of text that differs between the first two turns: 1 - 2 common / total, by length."""
    tokens = F.filter(F.split(F.lower("text"), r"\s+"), lambda t: t != "")
    each = table(spark, sf, "conversations").where("turn IN (0, 1)").select("conv_id", "turn", F.explode(tokens).alias("t"))
    counts = each.groupBy("conv_id", "t").agg(F.count_if(F.col("turn") == 0).alias("x"), F.count_if(F.col("turn") == 1).alias("y"))
    size = F.length("t")
    return counts.groupBy("conv_id").agg(F.round(1 - 2 * F.sum(F.least("x", "y") * size) / F.sum((F.col("x") + F.col("y")) * size), 6).alias("changed"))


@query(
    "q35_top5_cap",
    """WITH r AS (SELECT o_orderkey, o_custkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders WHERE o_orderstatus = 'O')
       SELECT o_orderkey, o_custkey, CAST(row_number() OVER (ORDER BY k > 2, o_totalprice DESC, o_orderkey) AS INTEGER) AS place FROM r ORDER BY place LIMIT 5""",
)
def q35(spark, sf):
    """The top five, at most two of a customer, filled up with the next best."""
    opened = table(spark, sf, "orders").where("o_orderstatus = 'O'").select("o_orderkey", "o_custkey", "o_totalprice")
    return groups.capped_top(opened, "o_custkey", [F.desc("o_totalprice"), F.asc("o_orderkey")], 5, 2).select("o_orderkey", "o_custkey", "place")


@query("q36_ordered_dedupe", "SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY 1, 2")
def q36(spark, sf):
    """The first occurrence of each key stays."""
    return groups.first_occurrences(table(spark, sf, "events").select("user_id", "event_type", "event_id"), ["user_id", "event_type"], [F.asc("event_id")])


@query(
    "q36b_since_last_reply",
    """SELECT conv_id, count(*) AS waiting FROM (SELECT conv_id, turn, max(CASE WHEN role = 'assistant' THEN turn END) OVER (PARTITION BY conv_id) AS last FROM conversations) WHERE last IS NULL OR turn > last GROUP BY 1""",
)
def q36b(spark, sf):
    """Messages since the last reply in each conversation."""
    rows = groups.since_last(table(spark, sf, "conversations").select("conv_id", "turn", "role"), ["conv_id"], "turn", F.col("role") == "assistant")
    return rows.groupBy("conv_id").agg(F.count("*").alias("waiting"))


@query(
    "q36c_polymorphic_lookup",
    """WITH r AS (SELECT event_id, CASE WHEN event_type = 'purchase' THEN 'customer' WHEN event_type = 'click' THEN 'part' ELSE 'supplier' END AS type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS id FROM events),
       t AS (SELECT 'customer' AS type, c_custkey AS id, c_name AS label FROM customer UNION ALL SELECT 'part', p_partkey, p_name FROM part UNION ALL SELECT 'supplier', s_suppkey, s_name FROM supplier)
       SELECT r.event_id, r.type, r.id, t.label FROM r LEFT JOIN t ON r.type = t.type AND r.id = t.id""",
)
def q36c(spark, sf):
    """References of a type and an id resolved to labels: typed projections united, then one join."""
    kind = F.when(F.col("event_type") == "purchase", "customer").when(F.col("event_type") == "click", "part").otherwise("supplier")
    references = table(spark, sf, "events").select("event_id", kind.alias("type"), F.get_json_object("props", "$.k").cast("long").alias("id"))
    named = [("customer", "c_custkey", "c_name"), ("part", "p_partkey", "p_name"), ("supplier", "s_suppkey", "s_name")]
    targets = None
    for t, key, label in named:
        one = table(spark, sf, t).select(F.lit(t).alias("type"), F.col(key).alias("id"), F.col(label).alias("label"))
        targets = one if targets is None else targets.unionByName(one)
    return references.join(targets, ["type", "id"], "left").select("event_id", "type", "id", "label")


@query(
    "q36d_mode_vote",
    """SELECT user_id, event_type AS primary_type, n FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) = 1""",
)
def q36d(spark, sf):
    """The most frequent kind for each user; of equals, the first by name."""
    votes = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return groups.top_per_group(votes, ["user_id"], [F.desc("n"), F.asc("event_type")]).select("user_id", F.col("event_type").alias("primary_type"), "n")


@query(
    "q36e_entity_cascade",
    """WITH m AS (SELECT event_id, 'Customer#' || lpad(CAST(CAST(json_extract_string(props, '$.k') AS BIGINT) AS VARCHAR), 9, '0') AS raw FROM events),
       d AS (SELECT c_custkey, c_name, right(c_name, 9) AS alias FROM customer)
       SELECT m.event_id, coalesce(a.c_custkey, b.c_custkey) AS entity, CASE WHEN a.c_custkey IS NOT NULL THEN 'exact' WHEN b.c_custkey IS NOT NULL THEN 'alias' ELSE 'none' END AS how
       FROM m LEFT JOIN d a ON lower(a.c_name) = lower(m.raw) LEFT JOIN d b ON b.alias = right(m.raw, 9)""",
)
def q36e(spark, sf):
    """Mentions resolved by a cascade of equi-joins: exact name, then alias."""
    raw = F.concat(F.lit("Customer#"), F.lpad(F.get_json_object("props", "$.k"), 9, "0"))
    mentions = table(spark, sf, "events").select("event_id", raw.alias("raw"))
    directory = table(spark, sf, "customer").select("c_custkey", "c_name")
    exact = directory.select(F.lower("c_name").alias("k1"), F.col("c_custkey").alias("by_name"))
    alias = directory.select(F.expr("right(c_name, 9)").alias("k2"), F.col("c_custkey").alias("by_alias"))
    found = mentions.join(exact, F.lower("raw") == F.col("k1"), "left").join(alias, F.expr("right(raw, 9)") == F.col("k2"), "left")
    how = F.when(F.col("by_name").isNotNull(), "exact").when(F.col("by_alias").isNotNull(), "alias").otherwise("none")
    return found.select("event_id", F.coalesce("by_name", "by_alias").alias("entity"), how.alias("how"))


@query(
    "q36f_confidence_gate",
    """SELECT event_id, CASE WHEN value / 100 >= 0.8 THEN 'WRITE' WHEN value / 100 >= 0.55 THEN 'REVIEW' ELSE 'DROP' END AS verdict FROM events""",
)
def q36f(spark, sf):
    """Proposals written, reviewed or dropped by their confidence."""
    return table(spark, sf, "events").select("event_id", rounding.bands(F.col("value") / 100, [(0.8, "WRITE"), (0.55, "REVIEW")], "DROP").alias("verdict"))
