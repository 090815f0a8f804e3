"""A kept positional index of documents: postings by stem and word, written once, read by every search."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.text import light_stem
from tidemark.operators.search import Query, all_of

#: Folders that postings are dealt into by their stem, and files of a folder at most.
BUCKETS, FILES = 64, 8
#: Places of a word in one posting; a longer text has several postings of a word.
PLACES = 1 << 16


def bucket_of(stem: Column) -> Column:
    return F.pmod(F.xxhash64(stem), F.lit(BUCKETS)).cast("int")


def postings(docs: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    """(bucket, stem, word, id, field, places): where each word stands in each field of a document, counted from 1.

    Words are runs of ASCII letters and digits of the lower-cased text. A text is taken apart and
    its words are gathered within its row, PLACES words at a time: nothing is shuffled. A stem is
    worked out once for each word of a document, and a place is four bytes.
    """
    each = None
    for field in fields:
        words = F.split(F.regexp_replace(F.lower(F.col(field)), "[^a-z0-9]+", " "), " ")
        one = docs.select(F.col(id_col).alias("id"), F.lit(field).alias("field"), words.alias("words"))
        each = one if each is None else each.unionByName(one)
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size("words") - 1) / PLACES).cast("int")), lambda p: F.slice("words", p * PLACES + 1, F.lit(PLACES)))
    each = each.select("id", "field", F.posexplode(parts).alias("part", "words"))
    # Sorted by word and place, a word's places are a run; a run ends where the next begins.
    met = F.filter(F.transform("words", lambda w, k: F.struct(w.alias("word"), (F.col("part") * PLACES + k + 1).alias("at"))), lambda x: x["word"] != "")
    each = each.select("id", "field", F.sort_array(met).alias("met")).where(F.size("met") > 0)
    begins = F.filter(F.sequence(F.lit(0), F.size("met") - 1), lambda k: (k == 0) | (F.get("met", k)["word"] != F.get("met", k - 1)["word"]))
    each = each.select("id", "field", "met", begins.alias("begins"))
    run = lambda b, k: F.slice("met", b + 1, F.coalesce(F.get("begins", k + 1), F.size("met")) - b)
    found = F.transform("begins", lambda b, k: F.struct(F.get("met", b)["word"].alias("word"), F.transform(run(b, k), lambda x: x["at"]).alias("places")))
    each = each.select("id", "field", F.explode(found).alias("found")).select("found.word", "id", "field", "found.places")
    return each.select(bucket_of(light_stem(F.col("word"))).alias("bucket"), light_stem(F.col("word")).alias("stem"), "word", "id", "field", "places")


def write_index(docs: DataFrame, path: str, id_col: str, fields: list[str]) -> None:
    """Writes the postings of docs as a segment at path: a folder a bucket, sorted by stem and word, and the ids that it covers.

    A search reads the buckets of its stems and, in these, the row groups that hold them. A
    stem that every document has is dealt over FILES files. Postings are shuffled once, and
    partitions that would be large are split, so that a sort fits in a task's memory.
    """
    rows = postings(docs, id_col, fields).withColumn("file", F.pmod(F.xxhash64("id"), F.lit(FILES))).hint("rebalance", "bucket", "file").drop("file")
    rows.sortWithinPartitions("bucket", "stem", "word", "id").write.partitionBy("bucket").parquet(f"{path}/postings")
    docs.select(F.col(id_col).alias("id")).distinct().write.parquet(f"{path}/ids")


def read_index(spark: SparkSession, paths: list[str], stems: list[str] | None = None, fields: list[str] | None = None) -> DataFrame:
    """The postings of segments, the last written of a document counting: (stem, word, id, field, places).

    Only the buckets of ``stems`` are read. A later segment stands for all that it covers, also
    for documents that have no words any more.
    """
    out = None
    for k, path in enumerate(paths):
        rows = spark.read.parquet(f"{path}/postings")
        if stems is not None:
            keys = spark.createDataFrame([(s,) for s in stems] or [], "stem string").select(bucket_of(F.col("stem"))).distinct().collect()  # the query's own terms
            rows = rows.where(F.col("bucket").isin([r[0] for r in keys]) & F.col("stem").isin(stems))
        if fields is not None:
            rows = rows.where(F.col("field").isin(fields))
        for later in paths[k + 1 :]:
            rows = rows.join(spark.read.parquet(f"{later}/ids"), "id", "left_anti")
        rows = rows.select("stem", "word", "id", "field", "places")
        out = rows if out is None else out.unionByName(rows)
    return out


def merge_index(spark: SparkSession, paths: list[str], path: str) -> None:
    """Writes one segment that stands for all of paths, without taking any text apart again."""
    rows = read_index(spark, paths).withColumn("bucket", bucket_of(F.col("stem")))
    rows = rows.repartition("bucket", F.pmod(F.xxhash64("id"), F.lit(FILES)))
    rows.sortWithinPartitions("bucket", "stem", "word", "id").write.partitionBy("bucket").parquet(f"{path}/postings")
    ids = reduce(DataFrame.unionByName, (spark.read.parquet(f"{p}/ids") for p in paths))
    ids.distinct().write.parquet(f"{path}/ids")


def stems_of(spark: SparkSession, words: list[str]) -> dict[str, str]:
    """The stem of each word of a query."""
    return {r[0]: r[1] for r in spark.createDataFrame([(w,) for w in words] or [], "word string").select("word", light_stem(F.col("word"))).collect()}


def match_stems(spark: SparkSession, paths: list[str], words: list[str], without: list[str] = (), fields: list[str] | None = None, least: int = 2) -> DataFrame:
    """(id, found): how often a document has the stems of words, for those that have all of them and none of those to leave out. Words of under ``least`` letters don't count."""
    stems = stems_of(spark, [*words, *without])
    wanted, unwanted = sorted({stems[w] for w in words}), sorted({stems[w] for w in without})
    rows = read_index(spark, paths, wanted + unwanted, fields).where(F.length("word") >= least)
    per = rows.groupBy("id").agg(
        F.sum(F.when(F.col("stem").isin(wanted), F.size("places"))).cast("long").alias("found"),
        *(F.max((F.col("stem") == s).cast("int")).alias(f"has{k}") for k, s in enumerate(wanted + unwanted)),
    )
    fits = all_of([F.col(f"has{k}") == (1 if k < len(wanted) else 0) for k in range(len(wanted) + len(unwanted))])
    return per.where(fits).select("id", "found")


def closeness(spark: SparkSession, paths: list[str], words: list[str], weights: dict[str, float]) -> DataFrame:
    """(id, rank, shortest): documents with all stems of words, ranked by how close these stand.

    A cover is a run of a field that holds every stem and no shorter run within it does; it adds
    its field's weight over its length. Besides, a stem that a field has n times adds the
    field's weight times n / (n + 1), so documents whose words are in different fields rank as
    well. shortest is the length of the shortest cover, null if no field has all. Covers are
    found in one pass along the places of the query's words, for each document and field.
    """
    stems = sorted(set(stems_of(spark, words).values()))
    rows = read_index(spark, paths, stems, list(weights))
    weight = F.element_at(F.create_map(*(F.lit(x) for kv in weights.items() for x in kv)), F.col("field"))
    counts = rows.groupBy("id", "field", "stem").agg(F.sum(F.size("places")).alias("n"))
    presence = counts.groupBy("id").agg(F.sum(weight * F.col("n") / (F.col("n") + 1)).alias("presence"), F.count_distinct("stem").alias("kinds")).where(F.col("kinds") == len(stems))
    at = rows.join(presence.select("id"), "id", "left_semi").select("id", "field", "stem", F.explode("places").alias("at"))
    so_far = Window.partitionBy("id", "field").orderBy("at")
    last = [F.max(F.when(F.col("stem") == s, F.col("at"))).over(so_far) for s in stems]
    ends = at.select("id", "field", "at", *(c.alias(f"l{k}") for k, c in enumerate(last)))
    complete = ends.where(all_of([F.col(f"l{k}").isNotNull() for k in range(len(stems))]))
    start = F.least(*(F.col(f"l{k}") for k in range(len(stems)))) if len(stems) > 1 else F.col("l0")
    covers = complete.select("id", "field", "at", start.alias("start")).groupBy("id", "field", "start").agg(F.min("at").alias("end"))
    size = F.col("end") - F.col("start") + 1
    density = covers.groupBy("id").agg(F.sum(weight / size).alias("density"), F.min(size).alias("shortest"))
    return presence.join(density, "id", "left").select("id", (F.col("presence") + F.coalesce("density", F.lit(0.0))).alias("rank"), "shortest")


def match_index(spark: SparkSession, paths: list[str], query: Query, noise: DataFrame | None = None, fields: list[str] | None = None) -> DataFrame:
    """(id, rank) of the documents that a query fits, by places in the index; rank is the number of wanted words, 0.3 of that for documents in noise (id)."""
    stems = stems_of(spark, query.words())
    rows = read_index(spark, paths, sorted(set(stems.values())), fields)
    found = rows.groupBy("id", "field").agg(F.collect_list(F.struct("stem", "places")).alias("hits"))
    places = lambda w: F.flatten(F.transform(F.filter("hits", lambda h: h["stem"] == stems[w]), lambda h: h["places"]))

    def back_by(k: int):
        return lambda at: at - k

    def has(phrase: tuple[str, ...]) -> Column:
        return F.size(reduce(F.array_intersect, [F.transform(places(w), back_by(k)) for k, w in enumerate(phrase)])) > 0

    fits = all_of([reduce(lambda a, b: a | b, map(has, clause)) for clause in query.clauses]) & all_of([~has(p) for p in query.without])
    asked = sorted({w for c in query.clauses for p in c for w in p})
    weight = sum((F.size(places(w)) for w in asked), F.lit(0))
    hits = found.where(fits).groupBy("id").agg(F.sum(weight).alias("rank"))
    if noise is None:
        return hits
    quiet = noise.select("id").withColumn("quiet", F.lit(0.3))
    return hits.join(quiet, "id", "left").select("id", (F.col("rank") * F.coalesce("quiet", F.lit(1.0))).alias("rank"))


def match_tiers(spark: SparkSession, paths: list[str], terms: list[str], fields: list[str] | None = None, least: int = 2) -> DataFrame:
    """(term, id, tier): 1 for whole stems, 2 for words that begin with the term, 3 for words that contain it; for each term only its best tier that has any.

    Terms are runs of letters and digits. They meet the index's words, not the texts, in two passes: one tells the
    best tier of each term, a row a term, the other the documents of that tier's words; no other posting is shuffled.
    """
    stems = stems_of(spark, terms)
    rows = read_index(spark, paths, None, fields)

    def tier(term: str) -> Column:
        whole = (F.col("stem") == stems[term]) & (F.length("word") >= least)
        return F.when(whole, 1).when(F.startswith("word", F.lit(term)), 2).when(F.contains("word", F.lit(term)), 3)

    # Few words have any tier; the others go before anything is built of them.
    some = rows.where(reduce(lambda a, b: a | b, ((F.col("stem") == stems[t]) | F.contains("word", F.lit(t)) for t in terms), F.lit(False)))
    hits = F.array(*(F.struct(F.lit(t).alias("term"), tier(t).alias("tier")) for t in terms))
    each = some.select("id", F.explode(hits).alias("hit")).where("hit.tier IS NOT NULL").select("hit.term", "id", "hit.tier")
    best = each.groupBy("term").agg(F.min("tier").alias("tier"))
    # What a better tier finds, worse ones find as well; a tier's documents are those of its own words.
    return each.join(F.broadcast(best), ["term", "tier"]).select("term", "id", "tier").distinct()
