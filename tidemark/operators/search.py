"""Full-text search over an inverted index table, with tiers, groups and snippets."""

from __future__ import annotations

import calendar
import re
from collections.abc import Callable
from dataclasses import dataclass
from datetime import date, timedelta
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import like_pattern, light_stem


@dataclass(frozen=True)
class SearchPlan:
    """What is asked, taken apart: stems that must all occur, that must not, and bounds on type and number."""

    terms: tuple[str, ...]
    without: tuple[str, ...] = ()
    types: tuple[str, ...] = ()
    per_type: int = 10

    @staticmethod
    def parse(text: str, **rest) -> SearchPlan:
        """Words, and -words to leave out, at most eight of two letters or more."""
        found = [w for w in text.lower().split() if len(w.strip("-")) >= 2][:8]
        return SearchPlan(tuple(w for w in found if w[0] != "-"), tuple(w[1:] for w in found if w[0] == "-"), **rest)


def postings(docs: DataFrame, id_col: str, fields: dict[str, float], plan: SearchPlan | None = None) -> DataFrame:
    """(term, id, weight): each stem of a document once, weighted by field and number.

    Terms are the stems of runs of two or more ASCII letters and digits. Words are exploded
    before they are stemmed, so that the stemmer is compiled with the rest of the stage. To be
    written sorted and bucketed by term; a search then reads its terms' rows only. For a search
    without such a table, plan leaves out words that can't have its stems: a stem keeps a word's
    first two letters.
    """
    each = None
    for name, weight in fields.items():
        word = F.explode(F.split(F.regexp_replace(F.lower(F.col(name)), "[^a-z0-9]+", " "), " "))
        one = docs.select(F.col(id_col).alias("id"), word.alias("word"), F.lit(weight).alias("weight"))
        each = one if each is None else each.unionByName(one)
    if plan:
        begins = sorted({t[:2] for t in plan.terms + plan.without})
        each = each.where(F.left("word", F.lit(2)).isin(begins))
    return each.where(F.length("word") >= 2).groupBy(light_stem(F.col("word")).alias("term"), "id").agg(F.sum("weight").alias("weight"))


def stems_of(spark, terms: tuple[str, ...]) -> DataFrame:
    return spark.createDataFrame([(t,) for t in terms] or [], "raw string").select(light_stem(F.col("raw")).alias("term")).distinct()


def match_all(index: DataFrame, plan: SearchPlan) -> DataFrame:
    """(id, rank) of documents with all of the plan's stems and none of those to leave out."""
    spark = index.sparkSession
    wanted = stems_of(spark, plan.terms)  # eight at most
    n = wanted.agg(F.count("*").alias("n"))
    hits = index.join(F.broadcast(wanted), "term").groupBy("id").agg(F.sum("weight").alias("rank"), F.count("*").alias("found"))
    hits = hits.join(F.broadcast(n), F.col("found") == F.col("n")).select("id", "rank")
    if plan.without:
        hits = hits.join(index.join(F.broadcast(stems_of(spark, plan.without)), "term").select("id"), "id", "left_anti")
    return hits


def best_tiers(docs: DataFrame, id_col: str, text_col: str, terms: list[str]) -> DataFrame:
    """(term, id, tier): 1 for whole stems, 2 for words that begin with the term, 3 for text that contains it; for each term only its best tier that has any.

    One scan tells the tiers of all terms; the best ones, a row a term, are broadcast.
    """
    low = F.lower(F.col(text_col))
    words = F.split(F.regexp_replace(low, "[^a-z0-9]+", " "), " ")

    def tier(term: str) -> Column:
        near = F.filter(words, lambda w: F.startswith(w, F.lit(term[:2])))  # a stem keeps the first two letters
        whole = F.exists(near, lambda w: light_stem(w) == light_stem(F.lit(term)))
        return F.when(whole, 1).when(low.rlike(rf"(^|[^a-z0-9])\Q{term}\E"), 2).when(F.contains(low, F.lit(term)), 3)

    each = docs.select(F.col(id_col).alias("id"), F.explode(F.array(*(F.struct(F.lit(t).alias("term"), tier(t).alias("tier")) for t in terms))).alias("hit"))
    hits = each.select("hit.term", "id", "hit.tier").where("tier IS NOT NULL")
    best = hits.groupBy("term").agg(F.min("tier").alias("tier"))
    return hits.join(F.broadcast(best), ["term", "tier"]).select("term", "id", "tier")


def all_of(predicates: list[Column]) -> Column:
    out = F.lit(True)
    for p in predicates:
        out = out & p
    return out


def grouped_results(hits: DataFrame, plan: SearchPlan, order: list[Column]) -> DataFrame:
    """hits (type, ...) cut to per_type of each type, with ``place``, and ``more`` if the type had others."""
    per = min(25, max(1, plan.per_type))
    chosen = hits.where(F.col("type").isin(*plan.types)) if plan.types else hits
    ranked = chosen.withColumn("place", F.row_number().over(Window.partitionBy("type").orderBy(*order))).where(F.col("place") <= per + 1)
    return ranked.withColumn("more", F.max("place").over(Window.partitionBy("type")) > per).where(F.col("place") <= per)


@dataclass(frozen=True)
class Query:
    """A web-style query: clauses that must all hold, each a choice of phrases (tuples of stems), and phrases that must not."""

    clauses: tuple[tuple[tuple[str, ...], ...], ...]
    without: tuple[tuple[str, ...], ...] = ()

    @staticmethod
    def parse(text: str) -> Query:
        """Words and "phrases"; OR between two makes them a choice, a leading - excludes. Words are stemmed when matched."""
        clauses: list[list[tuple[str, ...]]] = []
        without: list[tuple[str, ...]] = []
        joins = False
        for minus, quoted, word in re.findall(r'(-?)(?:"([^"]*)"|(\S+))', text):
            if word == "OR" and clauses:
                joins = True
                continue
            phrase = tuple(re.findall(r"[a-z0-9]+", (quoted or word).lower()))
            if not phrase:
                continue
            if minus:
                without.append(phrase)
            elif joins:
                clauses[-1].append(phrase)
            else:
                clauses.append([phrase])
            joins = False
        return Query(tuple(map(tuple, clauses)), tuple(without))

    def words(self) -> list[str]:
        return sorted({w for c in (*self.clauses, self.without) for p in c for w in p})


def match_query(docs: DataFrame, id_col: str, text_col: str, query: Query, noise: Column | None = None) -> DataFrame:
    """(id, rank) of the documents that a query fits; rank is the number of wanted words in it, 0.3 of that for noise.

    One scan: words are exploded with their places, and only those whose stem the query has (a
    few, broadcast) are shuffled, to their document. Phrases are told by the places.
    """
    spark = docs.sparkSession
    wanted = spark.createDataFrame([(w,) for w in query.words()] or [], "raw string").select("raw", light_stem(F.col("raw")).alias("term"))
    each = docs.select(F.col(id_col).alias("id"), (noise if noise is not None else F.lit(False)).alias("noise"), F.posexplode(F.split(F.regexp_replace(F.lower(F.col(text_col)), "[^a-z0-9]+", " "), " ")).alias("at", "word"))
    hits = each.select("id", "noise", "at", light_stem(F.col("word")).alias("term")).join(F.broadcast(wanted), "term")
    found = hits.groupBy("id", "noise").agg(F.collect_set(F.struct("raw", "at")).alias("hits"))
    places = lambda w: F.transform(F.filter("hits", lambda h: h["raw"] == w), lambda h: h["at"])

    def back_by(k: int) -> Callable[[Column], Column]:
        return lambda at: at - k

    def has(phrase: tuple[str, ...]) -> Column:
        starts = [F.transform(places(w), back_by(k)) for k, w in enumerate(phrase)]
        return F.size(reduce(F.array_intersect, starts)) > 0

    fits = all_of([reduce(lambda a, b: a | b, map(has, clause)) for clause in query.clauses])
    fits = fits & all_of([~has(p) for p in query.without])
    asked = [w for c in query.clauses for p in c for w in p]
    weight = sum((F.size(places(w)) for w in sorted(set(asked))), F.lit(0))
    return found.where(fits).select("id", (weight * F.when(F.col("noise"), 0.3).otherwise(1.0)).alias("rank"))


def headlines(hits: DataFrame, text_col: str, stems: list[str], name: str = "headline", words: int = 16, fragments: int = 2) -> DataFrame:
    """hits with up to two fragments of ``words`` words around what was found, in brackets, joined by an ellipsis. For the few best hits only.

    Words are told apart once, and only those that begin like a stem are stemmed (a stem keeps the first two letters).
    """
    begins = "^[^a-z0-9]*(?:" + "|".join(sorted({s[:2] for s in stems})) + ")"
    is_hit = lambda w: F.lower(w).rlike(begins) & light_stem(F.regexp_replace(F.lower(w), "[^a-z0-9]+", "")).isin(stems)
    told = hits.withColumn("__words", F.filter(F.split(text_col, r"\s+"), lambda w: w != ""))
    told = told.withColumn("__at", F.filter(F.transform("__words", lambda w, k: F.when(is_hit(w), k + 1)), lambda k: k.isNotNull()))
    told = told.withColumn("__from", F.greatest(F.lit(1), F.coalesce(F.get("__at", F.lit(0)), F.lit(1)) - words // 4))
    told = told.withColumn("__then", F.get(F.filter("__at", lambda k: k >= F.col("__from") + words), F.lit(0)))
    marked = lambda start: F.transform(F.slice("__words", start, words), lambda w, k: F.when(F.array_contains("__at", k + start), F.concat(F.lit("["), w, F.lit("]"))).otherwise(w))
    fragment = lambda start: F.array_join(marked(start), " ")
    second = [F.when(F.col("__then").isNotNull(), fragment(F.coalesce("__then", F.lit(1))))] if fragments > 1 else []
    return told.withColumn(name, F.concat_ws(" … ", fragment(F.col("__from")), *second)).drop("__words", "__at", "__from", "__then")


def result_order(mode: str) -> list[Column]:
    """How results of a type are put in order: by relevance, newest, due (a missing date last) or open_first; hits have rank, at, due, open and id."""
    return {
        "relevance": [F.desc("rank"), F.asc("id")],
        "newest": [F.desc_nulls_last("at"), F.asc("id")],
        "due": [F.asc_nulls_last("due"), F.desc("rank"), F.asc("id")],
        "open_first": [F.desc("open"), F.desc("rank"), F.asc("id")],
    }[mode]


def fetch_all(fetchers: dict[str, Callable[[], DataFrame]], columns: list[str]) -> tuple[DataFrame | None, dict[str, str]]:
    """The hits of every fetcher with their type, and the errors of those that can't be planned; one failing leaves the others be."""
    hits, failed = None, {}
    for kind, fetch in fetchers.items():
        try:
            one = fetch().select(F.lit(kind).alias("type"), *columns)
        except AnalysisException as error:
            failed[kind] = error.getCondition() or "error"
            continue
        hits = one if hits is None else hits.unionByName(one)
    return hits, failed


def ordered_groups(hits: DataFrame, per_type: int, modes: dict[str, str], intents: list[str], default: str = "relevance") -> DataFrame:
    """hits cut to per_type of each type in the type's own order, with ``place``, and ``group_place``: types of the intent list first, in its order, then by best hit."""
    parts = None
    for mode in sorted({default, *modes.values()}):
        own = [t for t, m in modes.items() if m == mode]
        rows = hits.where(F.col("type").isin(own) if mode != default else (~F.col("type").isin([t for t, m in modes.items() if m != default]) | F.col("type").isin(own)))
        placed = rows.withColumn("place", F.row_number().over(Window.partitionBy("type").orderBy(*result_order(mode)))).where(F.col("place") <= per_type)
        parts = placed if parts is None else parts.unionByName(placed)
    best = parts.groupBy("type").agg(F.max("rank").alias("best"))
    ordinal = F.coalesce(F.create_map(*(F.lit(x) for k, t in enumerate(intents) for x in (t, k)))[F.col("type")] if intents else F.lit(None).cast("int"), F.lit(len(intents)))
    groups = best.withColumn("group_place", F.row_number().over(Window.orderBy(ordinal, F.desc("best"), "type"))).drop("best")  # a row for each type
    return parts.join(F.broadcast(groups), "type")


def time_range(phrase: str, today: date) -> tuple[date, date] | None:
    """First and last day of "last 7 days", "next 2 weeks", "this month", "since monday", "today" and the like; None if it names none."""
    words = phrase.lower().split()
    monday = today - timedelta(today.weekday())
    first = lambda d: d.replace(day=1)
    shift = lambda d, n: date(d.year + (d.month - 1 + n) // 12, (d.month - 1 + n) % 12 + 1, 1)
    if words in (["today"], ["yesterday"], ["tomorrow"]):
        day = today + timedelta({"today": 0, "yesterday": -1, "tomorrow": 1}[words[0]])
        return day, day
    if words == ["recent"] or words == ["recently"]:
        return today - timedelta(30), today
    if len(words) == 3 and words[0] in ("last", "past", "next") and words[1].isdigit():
        n, unit = int(words[1]), words[2].rstrip("s")
        if unit not in ("day", "week", "month"):
            return None
        if unit == "month":
            other = shift(today, n if words[0] == "next" else -n)
            edge = other.replace(day=min(today.day, (shift(other, 1) - timedelta(1)).day))
        else:
            edge = today + timedelta((n if words[0] == "next" else -n) * (7 if unit == "week" else 1))
        return (today, edge) if words[0] == "next" else (edge, today)
    if len(words) == 2 and words[0] in ("this", "next", "last"):
        n = {"last": -1, "this": 0, "next": 1}[words[0]]
        if words[1] == "week":
            return monday + timedelta(7 * n), monday + timedelta(7 * n + 6)
        if words[1] == "month":
            return shift(first(today), n), shift(first(today), n + 1) - timedelta(1)
        if words[1] == "quarter":
            start = shift(first(today), -((today.month - 1) % 3) + 3 * n)
            return start, shift(start, 3) - timedelta(1)
    if len(words) == 2 and words[0] == "since":
        names = [n.lower() for n in calendar.day_name]
        if words[1] in names:
            return today - timedelta((today.weekday() - names.index(words[1])) % 7 or 7), today
        if re.fullmatch(r"\d{4}-\d\d-\d\d", words[1]):
            return date.fromisoformat(words[1]), today
    return None
