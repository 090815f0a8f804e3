"""Pairs of like names without comparing all with all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.operators import likeness

GRAM = 2


def grams(name: Column) -> Column:
    """A name's GRAM-grams, numbered by occurrence, in one order of all."""
    padded = F.concat(F.lit("^"), name, F.lit("$"))
    each = F.transform(F.sequence(F.lit(1), F.length(padded) - GRAM + 1), lambda k: F.substring(padded, k, F.lit(GRAM)))
    numbered = F.transform(each, lambda g, k: F.concat(g, F.size(F.filter(F.slice(each, 1, k + 1), lambda o: o == g)).cast("string")))
    return F.array_sort(numbered)


def edit_pairs(names: DataFrame, column: str, least: float) -> DataFrame:
    """(a, b, distance) of distinct names, a < b, whose Levenshtein ratio is ``least`` or more.

    Names within distance d share a gram among the first GRAM * d + 1 of each in one order, since
    an edit changes GRAM of them at most; d follows from the longest partner that the ratio
    allows. Lengths are bounded as well, and only pairs that are left are compared. Names too
    short for a shared gram to be sure meet by their length alone.
    """
    own = names.select(F.col(column).alias("name")).where("name IS NOT NULL").distinct()
    reach = F.floor(F.length("name") / F.lit(least) * F.lit(1 - least) + F.lit(1e-9)).cast("int")  # of the longest partner
    found = own.select("name", F.length("name").alias("n"), grams(F.col("name")).alias("grams"), (GRAM * reach + 1).alias("first"))
    short = F.when(F.size("grams") <= F.col("first"), F.array(F.lit("short"))).otherwise(F.array().cast("array<string>"))
    keyed = found.select("name", "n", F.explode(F.concat(F.slice("grams", 1, F.col("first")), short)).alias("key"))
    a, b = keyed.toDF("a", "a_n", "key"), keyed.toDF("b", "b_n", "key")
    near = (F.least("a_n", "b_n") >= F.greatest("a_n", "b_n") * F.lit(least) - 1e-9) & (F.col("a") < F.col("b"))
    pairs = a.join(b, "key").where(near).select("a", "b").distinct()
    return pairs.where(text.levenshtein_ratio(F.col("a"), F.col("b")) >= least).select("a", "b", F.levenshtein("a", "b").alias("distance"))


def jaro_winkler_pairs(names: DataFrame, column: str, least: float, prefix: int) -> DataFrame:
    """(a, b) of distinct names, a < b, that begin with the same ``prefix`` letters and are alike by Jaro-Winkler, ``least`` being 0.85 or more. Names meet in tiles (see likeness), not by their beginning."""
    own = names.select(F.col(column).alias("name")).where("name IS NOT NULL").distinct()
    found = likeness.jaro_winkler_matches(own, own, least).where("a < b")
    return found.where(F.left("a", F.lit(prefix)) == F.left("b", F.lit(prefix))).select("a", "b")
