"""Numbers and names as people read them (US English); nulls stay null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.rounding import half_up


def compact(size: Column) -> Column:
    """A size of 1,000 or more with K, M, B or T: three digits before the point, or one after it that isn't 0."""

    def shown(unit: float, letter: str) -> Column:
        x = size / unit
        short = F.regexp_replace(F.format_string("%.1f", half_up(x, 1)), r"\.0$", "")
        return F.concat(F.when(x >= 100, half_up(x).cast("long").cast("string")).otherwise(short), F.lit(letter))

    return F.when(size >= 1e12, shown(1e12, "T")).when(size >= 1e9, shown(1e9, "B")).when(size >= 1e6, shown(1e6, "M")).when(size >= 1e3, shown(1e3, "K"))


def currency(amount: Column) -> Column:
    """Whole dollars with commas; from 10,000 on in compact form. The sign comes before the dollar sign."""
    size = F.abs(amount)
    whole = half_up(size).cast("long")
    # A negative amount that rounds to nothing keeps its sign.
    return F.concat(F.when(amount < 0, "-$").otherwise("$"), F.when(size >= 10_000, compact(size)).otherwise(F.format_number(whole, 0)))


def minutes_label(minutes: Column) -> Column:
    """45m, 2h, 1h 30m."""
    hours, rest = F.floor(minutes / 60).cast("string"), (minutes % 60).cast("string")
    return F.when(minutes < 60, F.concat(minutes.cast("string"), F.lit("m"))).when(minutes % 60 == 0, F.concat(hours, F.lit("h"))).otherwise(F.concat(hours, F.lit("h "), rest, F.lit("m")))


def pluralize(count: Column, singular: str, plural: str | None = None) -> Column:
    return F.concat(count.cast("string"), F.lit(" "), F.when(count == 1, singular).otherwise(plural or f"{singular}s"))


def initials(name: Column) -> Column:
    """The first letters of the first two words, in upper case."""
    return F.array_join(F.transform(F.slice(F.filter(F.split(name, r"\s+"), lambda w: w != ""), 1, 2), lambda w: F.upper(F.left(w, F.lit(1)))), "")


def truncate(text: Column, most: int) -> Column:
    """At most so many characters; a cut text ends in an ellipsis, without a blank before it."""
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.regexp_replace(F.left(text, F.lit(most - 1)), r"\s+$", ""), F.lit("…")))
