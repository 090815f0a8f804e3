"""How well a record of each kind answers a search: what of its title and text fits, how it stands, how near it is in time."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text


@dataclass(frozen=True)
class Rank:
    """A kind's parts: the weight of the fit, what a status adds (else ``other``), nearness of ``at`` in days, and a number's share up to a limit.

    ``due`` adds nearness of the due day and a bonus once it is past and the status is the first of ``adds``. A
    record in focus ranks 1, less ``step`` for each place in the focus after the first.
    """

    fit: float = 0.0
    base: float = 0.0
    adds: dict[str, float] = field(default_factory=dict)
    other: float = 0.0
    near: float = 0.0
    days: int = 90
    number: float = 0.0
    limit: float | None = None
    due: bool = False
    focus: bool = False
    step: float = 0.0


# The ranks of the kinds.
RANKS = {
    "commitment": Rank(fit=0.3, adds={"OPEN": 0.6}, other=0.2, due=True),
    "task": Rank(fit=0.6, adds={"OPEN": 0.25}, number=1 / 700, limit=0.15),
    "meeting": Rank(fit=0.6, near=0.4, days=60),
    "decision": Rank(fit=0.6, adds={"NEEDED": 0.3, "WAITING_INFO": 0.3}, other=0.1),
    "milestone": Rank(fit=0.6, adds={"AT_RISK": 0.3, "BLOCKED": 0.3}, other=0.15),
    "goal": Rank(fit=1.0, focus=True, step=0.05),
    "deal": Rank(fit=0.2, adds={"OPEN": 0.5}, other=0.1, number=0.3 / 100),
    "risk": Rank(fit=0.5, number=1 / 10),
    "opportunity": Rank(fit=0.5, adds={"OPEN": 0.3, "PURSUING": 0.3}, other=0.1),
    "company": Rank(fit=0.8, base=0.1, focus=True),
    "person": Rank(fit=0.8, base=0.1, focus=True),
    "project": Rank(fit=1.0, focus=True),
    "report": Rank(fit=0.8, base=0.1),
    "note": Rank(fit=0.6, near=0.4, days=90),
    "insight": Rank(fit=0.4, number=1 / 10, near=0.1, days=30),
}


def rank_of(kind: str, terms: list[str], now: Column) -> Column:
    """A record's rank from its columns title, body, status, due (a day), at (an instant), number and place (in the focus, from 0; null outside)."""
    r = RANKS[kind]
    fit = text.term_score(F.coalesce("title", F.lit("")), F.coalesce("body", F.lit("")), terms) if terms else F.lit(0.0)
    rank = F.lit(r.base) + fit * r.fit
    if r.adds or r.other:
        added = F.lit(r.other)
        for status, bonus in r.adds.items():
            added = F.when(F.col("status") == status, bonus).otherwise(added)
        rank = rank + added
    if r.near:
        apart = F.abs(F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("at").cast("timestamp"))) / (r.days * 86_400e6)
        rank = rank + r.near * F.coalesce(F.greatest(F.lit(0.0), 1 - apart), F.lit(0.0))
    if r.number:
        share = F.coalesce(F.col("number") * r.number, F.lit(0.0))
        rank = rank + (share if r.limit is None else F.least(F.lit(r.limit), share))
    if r.due:
        days = F.datediff("due", F.to_date(now))
        rank = rank + F.coalesce(F.greatest(F.lit(0.0), 0.1 - F.abs(days) / 300), F.lit(0.0)) + F.when((days < 0) & (F.col("status") == next(iter(r.adds))), 0.3).otherwise(0.0)
    return F.when(F.col("place").isNotNull(), 1 - F.col("place") * r.step).otherwise(rank) if r.focus else rank


def ranked(kinds: dict[str, DataFrame], terms: list[str], now: Column, per_kind: int | None = None) -> DataFrame:
    """(type, id, rank, at, due, status) of the records of all kinds that fit a term or are in focus; with per_kind the best of each.

    Each frame has id and any of the columns of rank_of. Without terms every record is a hit. A
    kind's best are cut in its own tasks before they meet.
    """
    types = {"title": "string", "body": "string", "status": "string", "due": "date", "at": "timestamp", "number": "double", "place": "int"}
    out = None
    for kind, rows in kinds.items():
        whole = rows.select("id", *(F.col(c).cast(t).alias(c) if c in rows.columns else F.lit(None).cast(t).alias(c) for c, t in types.items()))
        if terms:
            fits = text.term_score(F.coalesce("title", F.lit("")), F.coalesce("body", F.lit("")), terms) > 0
            whole = whole.where(fits | (F.col("place").isNotNull() if RANKS[kind].focus else F.lit(False)))
        one = whole.select(F.lit(kind).alias("type"), "id", rank_of(kind, terms, now).alias("rank"), "at", "due", "status")
        if per_kind:
            one = one.orderBy(F.desc("rank"), "id").limit(per_kind)
        out = one if out is None else out.unionByName(one)
    return out
