"""Who may read what: predicates and joins that every scan of source items goes through."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Levels of sensitivity, each above those before.
LEVELS = ["LOW", "MEDIUM", "HIGH", "CRITICAL"]


@dataclass(frozen=True)
class Scope:
    """What a reader may see: levels up to a clearance, and sources and items granted besides."""

    clearance: str | None = None
    sources: tuple[str, ...] = field(default=())
    items: tuple[int, ...] = field(default=())
    everything: bool = False

    def levels(self) -> list[str]:
        return LEVELS[: LEVELS.index(self.clearance) + 1] if self.clearance else []


def readable(scope: Scope, level: Column, source: Column, item: Column) -> Column:
    """True for rows in the scope; an empty scope sees nothing, whatever is null."""
    if scope.everything:
        return F.lit(True)
    tests = [(level, scope.levels()), (source, scope.sources), (item, scope.items)]
    out = F.lit(False)
    for column, allowed in tests:
        if allowed:
            out = out | F.coalesce(column.isin(*allowed), F.lit(False))
    return out


def granted(items: DataFrame, grants: DataFrame, on: str) -> DataFrame:
    """Items of a grant table: for scopes too large to be listed in a predicate."""
    return items.join(grants.select(on).distinct(), on, "left_semi")


def hide_by_provenance(records: DataFrame, references: DataFrame, on: str, is_readable: Column) -> DataFrame:
    """Records none of whose sources is unreadable; a record without sources is shown."""
    hidden = references.where(~F.coalesce(is_readable, F.lit(False))).select(on).distinct()
    return records.join(hidden, on, "left_anti")


def masked_by_provenance(records: DataFrame, references: DataFrame, on: str, is_readable: Column, text: str) -> DataFrame:
    """All records, the text of those null that have hidden sources and no readable one."""
    seen = references.groupBy(on).agg(F.bool_or(F.coalesce(is_readable, F.lit(False))).alias("__seen"))
    return records.join(seen, on, "left").withColumn(text, F.when(F.coalesce("__seen", F.lit(True)), F.col(text))).drop("__seen")
