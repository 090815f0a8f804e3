"""Figures in documents, and what changed in them from one version to the next."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

from tidemark.functions.date_phrases import find_days
from tidemark.functions.rounding import half_up
from tidemark.sources.mail import split_sentences

# Categories in which a changed figure is material, and their order of importance.
MATERIAL = ["fundraising", "financial", "contract"]
CATEGORIES = ["fundraising", "financial", "contract", "timeline", "scientific", "operational", "other"]
# Words near a figure that name its category.
NAMES = {
    "fundraising": "raise|raising|round|series|close|investor|valuation", "financial": "burn|runway|revenue|cash|margin|budget|cost|price", "contract": "contract|proposal|agreement|fee|term|renewal",
    "timeline": "launch|deadline|milestone|delivery|start", "scientific": "donor|sample|auc|accuracy|patients?|hearts?", "operational": "team|hires?|headcount|users|customers",
}
SCALE = {"": 1.0, "k": 1e3, "m": 1e6, "b": 1e9}
SHAPES = [
    ("money", re.compile(r"\$\s?(\d[\d,]*(?:\.\d+)?)\s?([kmb])?\b", re.I)), ("percent", re.compile(r"(\d+(?:\.\d+)?)\s?%()")),
    ("duration", re.compile(r"(\d+(?:\.\d+)?)\s+(?:days?|weeks?|months?|years?)\b()", re.I)), ("count", re.compile(r"(?<![\d.$/])(\d[\d,]*)\s+(?=[a-z])()(?!days?|weeks?|months?|years?)", re.I)),
]
FACT = StructType([StructField(n, StringType()) for n in ("key", "kind", "category", "value")] + [StructField("numeric", DoubleType())])


def facts_in(text: str | None) -> list[dict]:
    """Figures in reading order, each with the words that name it: those before it in its sentence, or after it for counts."""
    out: list[dict] = []
    for sentence in split_sentences(text) or []:
        taken: list[tuple[int, int]] = []

        def add(kind: str, start: int, end: int, value: str, numeric: float, sentence: str = sentence, taken: list = taken) -> None:
            if any(start < b and a < end for a, b in taken):
                return
            taken.append((start, end))
            near = sentence[end:] if kind == "count" else sentence[:start]
            words = [w for w in re.findall(r"[a-z]{3,}", near.lower()) if w not in {"the", "and", "for", "with", "from", "our", "are", "was", "current", "now", "about"}]
            label = " ".join(words[:2] if kind == "count" else words[-2:]) or "figure"
            category = next((c for c, names in NAMES.items() if re.search(rf"\b({names})\b", sentence[:start].lower() + " " + near.lower()[:30])), "other")
            out.append({"key": f"{kind}:{label}", "kind": kind, "category": category, "value": value, "numeric": numeric})

        for day, phrase, _ in find_days(sentence, pd.Timestamp("2000-01-01").date()):
            if re.search(r"\d{4}", phrase):
                at = max(0, sentence.find(phrase))
                add("date", at, at + len(phrase), day.isoformat(), float(day.toordinal()))
        for kind, shape in SHAPES:
            for m in shape.finditer(sentence):
                add(kind, m.start(), m.end(), m[0].strip(), float(m[1].replace(",", "")) * SCALE[(m[2] or "").lower()])
    return out


@F.pandas_udf(ArrayType(FACT))
def extract_facts(texts: pd.Series) -> pd.Series:
    return texts.map(facts_in)


def significance(change: Column, kind: Column, category: Column, percent: Column, days: Column) -> Column:
    """HIGH, MEDIUM or LOW: material dates that move a week, material amounts that move a tenth are high."""
    material = category.isin(MATERIAL)
    of_date = F.when((material | (category == "timeline")) & (days.isNull() | (F.abs(days) >= 7)), "HIGH").otherwise("MEDIUM")
    of_amount = F.when(F.abs(percent) >= 10, "HIGH").when(F.abs(percent) < 1, "LOW").otherwise("MEDIUM")
    return (
        F.when(change != "changed", F.when(material, "MEDIUM").otherwise("LOW")).when(kind == "date", of_date)
        .when(kind.isin("money", "duration") & material & percent.isNotNull(), of_amount)
        .when(F.abs(percent) < 1, "LOW").otherwise("MEDIUM")
    )


def fact_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """What changed in each document's facts (doc_id, place, key, kind, category, value, numeric).

    A value on both sides under its key is no change. The rest is paired by place within the key:
    changed; what is left over was removed or added. A document without a version before has no
    changes. Each key of a document is numbered by itself, so the join is on document, key and place.
    """
    keys = ["doc_id", "key"]

    def unique(df: DataFrame) -> DataFrame:
        first = Window.partitionBy(*keys, "value").orderBy("place")
        return df.withColumn("__k", F.row_number().over(first)).where("__k = 1").drop("__k")

    def numbered(df: DataFrame, other: DataFrame, side: str) -> DataFrame:
        left = df.join(other.select(*keys, "value"), [*keys, "value"], "left_anti")
        place = F.row_number().over(Window.partitionBy(*keys).orderBy("place"))
        return left.select(*keys, place.alias("__n"), F.struct("kind", "category", "value", "numeric").alias(side))

    a, b = unique(before), unique(after.join(before.select("doc_id").distinct(), "doc_id", "left_semi"))
    both = numbered(a, b, "old").join(numbered(b, a, "new"), [*keys, "__n"], "full")
    one = F.coalesce("new", "old")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("changed")
    delta = F.col("new.numeric") - F.col("old.numeric")
    rows = both.select(*keys, change.alias("change"), one["kind"].alias("kind"), one["category"].alias("category"), F.col("old.value").alias("from_value"), F.col("new.value").alias("to_value"), delta.alias("delta"), F.col("old.numeric").alias("was"))
    percent = F.when((F.col("kind") != "date") & (F.col("was") != 0), half_up(F.col("delta") / F.abs(F.col("was")) * 100, 1))
    days = F.when(F.col("kind") == "date", F.col("delta"))
    return rows.withColumn("delta_pct", percent).withColumn("delta_days", days).withColumn("significance", significance(F.col("change"), F.col("kind"), F.col("category"), F.col("delta_pct"), F.col("delta_days"))).drop("delta", "was")


def text_change_ratio(before: DataFrame, after: DataFrame) -> DataFrame:
    """(doc_id, ratio): the share of text that differs, sentence by sentence, weighted by length. Both sides (doc_id, sentence)."""
    norm = F.lower(F.regexp_replace("sentence", r"\s+", " "))
    each = before.select("doc_id", norm.alias("s"), F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(after.select("doc_id", norm.alias("s"), F.lit(0).alias("a"), F.lit(1).alias("b")))
    counts = each.groupBy("doc_id", "s").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    size = F.length("s")
    total = F.sum((F.col("a") + F.col("b")) * size)
    return counts.groupBy("doc_id").agg(F.when(total > 0, 1 - 2 * F.sum(F.least("a", "b") * size) / total).otherwise(0.0).alias("ratio"))


def significant_documents(changes: DataFrame, ratios: DataFrame) -> DataFrame:
    """doc_id of documents with a high change, two of medium weight, or 0.3 of their text changed."""
    counts = changes.groupBy("doc_id").agg(F.count_if(F.col("significance") == "HIGH").alias("high"), F.count_if(F.col("significance") == "MEDIUM").alias("medium"))
    both = counts.join(ratios, "doc_id", "full")
    return both.where((F.col("high") > 0) | (F.col("medium") >= 2) | (F.col("ratio") >= 0.3)).select("doc_id")
