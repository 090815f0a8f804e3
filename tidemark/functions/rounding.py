"""Rounding as the read models do it: halves go up, towards plus infinity."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column, digits: int = 0) -> Column:
    """x rounded to so many decimals, halves towards plus infinity (-2.5 -> -2)."""
    scale = float(10**digits)
    return F.floor(x * scale + 0.5) / scale


def half_away(x: Column, digits: int = 0) -> Column:
    """x rounded to so many decimals as C and SQL engines do it: scaled, halves away from zero, and what is less than half a step below zero is -0.0. F.round goes by the shortest decimal form of x instead, which differs where x is a hair off a half, and knows one zero."""
    scale = float(10**digits)
    whole = F.round(x * scale)
    return F.when(whole == 0, x * 0.0).otherwise(whole / scale)


def percent(part: Column, whole: Column) -> Column:
    """part in whole as an integer percentage; null if whole is null, zero or less."""
    return F.when(whole > 0, F.floor(part / whole * 100 + 0.5)).cast("long")


def clamp(x: Column, low, high) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def recency(age: Column, window: float) -> Column:
    """1 for no age, falling in a straight line to 0 at the window's end."""
    return F.greatest(F.lit(0.0), 1 - F.abs(age) / window)


def backoff(attempt: Column, base: float, cap: float) -> Column:
    """Seconds to wait after the given failed attempt, the first being 1: doubling, capped."""
    return F.least(F.lit(cap), base * F.pow(F.lit(2.0), F.greatest(attempt - 1, F.lit(0))))


def steps(x: Column, ladder: list[tuple[float, float]], otherwise: float) -> Column:
    """The value beside the first bound that x is not above; nulls take otherwise."""
    out = None
    for bound, value in ladder:
        out = F.when(x <= bound, F.lit(value)) if out is None else out.when(x <= bound, F.lit(value))
    return out.otherwise(F.lit(otherwise))


def bands(x: Column, ladder: list[tuple[float, str]], otherwise: str) -> Column:
    """The name beside the first bound that x reaches."""
    out = None
    for bound, name in ladder:
        out = F.when(x >= bound, F.lit(name)) if out is None else out.when(x >= bound, F.lit(name))
    return out.otherwise(F.lit(otherwise))
