"""Steps from what sources send to what is kept: shapes, participants, deletions, stages, noise, mentions, validation, changes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.operators import ranking

#: Evidence ids that an edge keeps, the newest.
EVIDENCE = 20


def chat_as_mail(messages: DataFrame, thread: str, sender: str, body: str, sent: str, topic: Column) -> DataFrame:
    """Chat messages in the shape of mail (item, thread, subject, sender, body, sent), so that both can be united."""
    subject = F.coalesce(F.nullif(F.trim(topic), F.lit("")), text_head(F.col(body), 60))
    return messages.select(F.concat(F.lit("chat:"), F.col(thread).cast("string"), F.lit(":"), F.col(sent).cast("string")).alias("item"), F.col(thread).cast("string").alias("thread"), subject.alias("subject"), F.col(sender).alias("sender"), F.col(body).alias("body"), F.col(sent).alias("sent"))


def text_head(body: Column, most: int) -> Column:
    """The first line of a text, cut at a word so that it has ``most`` characters at most."""
    line = F.trim(F.regexp_extract(body, r"^\s*([^\n]*)", 1))
    short = F.regexp_replace(F.substring(line, 1, most + 1), r"\s+\S*$", "")
    return F.when(F.length(line) > most, F.substring(short, 1, most)).otherwise(line)


def unique_participants(people: Column) -> Column:
    """An array of (email, name): one an address, in the order they came; a name is kept where the first has none or only its address."""
    keyed = F.transform(people, lambda p: F.struct(F.lower(F.trim(p["email"])).alias("email"), F.nullif(F.trim(p["name"]), F.lit("")).alias("name")))
    known = F.filter(keyed, lambda p: p["email"].isNotNull() & (p["email"] != ""))
    addresses = F.array_distinct(F.transform(known, lambda p: p["email"]))
    named = lambda e: F.filter(known, lambda p: (p["email"] == e) & p["name"].isNotNull() & (F.lower(p["name"]) != e))
    return F.transform(addresses, lambda e: F.struct(e.alias("email"), F.get(F.transform(named(e), lambda p: p["name"]), F.lit(0)).alias("name")))


def pushed(evidence: Column, item: Column, most: int = EVIDENCE) -> Column:
    """The newest ``most`` ids after item was pushed to the end; one that is there already stays where it is."""
    longer = F.array_union(evidence, F.array(item))
    return F.slice(longer, F.greatest(F.lit(1), F.size(longer) - (most - 1)), most)


def newest_evidence(rows: DataFrame, keys: list[str], item: str, at: str, most: int = EVIDENCE) -> DataFrame:
    """(keys, evidence): the newest ``most`` distinct items of each key, oldest first. Only these reach an array."""
    last = rows.groupBy(*keys, item).agg(F.max(at).alias("__at"))
    best = last.withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("__at"), F.desc(item)))).where(F.col("__k") <= most)
    return best.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("__at", item))), lambda s: s[item]).alias("evidence"))


def debounced(requests: DataFrame, key: str, at: str, seconds: int) -> DataFrame:
    """(key, due, n): requests of one key less than ``seconds`` apart make one run, due that long after the last of them. A key of any size is several slices of time (see ranking.gap_runs)."""
    return ranking.gap_runs(requests, key, at, seconds).select(key, (F.col("last") + F.make_dt_interval(secs=F.lit(seconds))).alias("due"), "n")


def with_deletions(items: DataFrame, deleted: DataFrame, path: str) -> DataFrame:
    """items with ``gone``: deleted (path) names an item or a folder, and then all below it.

    A path's own folders, a few, are looked up; so deletions are joined by equality.
    """
    parts = F.split(F.col(path), "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    names = deleted.select(F.regexp_replace(F.col("path"), "/+$", "").alias("__deleted")).distinct()
    hit = items.select(path, F.explode(F.array_distinct(above)).alias("__deleted")).join(names, "__deleted", "left_semi").select(path).distinct()
    return items.join(hit.withColumn("gone", F.lit(True)), path, "left").withColumn("gone", F.coalesce("gone", F.lit(False)))


def merged_parts(parts: DataFrame, doc: str, order: str, title: str) -> DataFrame:
    """What several chunks of a document yielded, each title once: the first chunk's, by the tokens of the title."""
    keyed = parts.withColumn("__key", text.action_key(F.col(title)))
    first = keyed.withColumn("__k", F.row_number().over(Window.partitionBy(doc, "__key").orderBy(order, title)))
    return first.where("__k = 1").drop("__k", "__key")


# Words at the end of a title that say which state a document is in.
STATES = ["final", "draft", "copy"]


def clean_title(title: Column) -> Column:
    """A document's title without file ending, underscores and one mark at its end: a state, a version, or a number in brackets.

    The last piece of the title, after a space, a dash or a bracket, is looked at. A state is one of
    STATES; a version is a number that v or version stands before, with or without a space. A
    bare number stays. A title that is nothing but a mark stays as it is.
    """
    plain = F.trim(F.replace(F.regexp_replace(title, r"\.[A-Za-z0-9]{2,5}$", ""), F.lit("_"), F.lit(" ")))
    closed = F.endswith(plain, F.lit(")"))
    body = F.rtrim(F.when(closed, F.left(plain, F.length(plain) - 1)).otherwise(plain))
    last = lambda c: F.regexp_extract(c, r"([^\s(–-]*)$", 1)
    without = lambda c, piece: F.left(c, F.length(c) - F.length(piece))
    piece = last(body)
    before = without(body, piece)
    word = F.lower(piece)
    spoken = last(F.rtrim(before))
    number = word.rlike(r"^[0-9]+(\.[0-9]+)*$")
    counted = number & F.lower(spoken).isin("v", "version")
    bracketed = closed & word.rlike("^[0-9]+$") & F.endswith(before, F.lit("("))
    marked = word.isin(STATES) | word.rlike(r"^v(ersion)?[0-9]+(\.[0-9]+)*$") | bracketed
    rest = F.when(counted, without(F.rtrim(before), spoken)).when(marked, before)
    cut = F.trim(F.regexp_replace(F.rtrim(rest), "[(–-]$", ""))
    return F.coalesce(F.nullif(F.coalesce(cut, plain), F.lit("")), title)


def noise_gate(facts: dict[str, Column], weights: dict[str, float], base: float, keep: float) -> dict[str, Column]:
    """relevance, the clamped sum of base and the weights of the facts that hold, and verdict: noise below keep."""
    total = reduce(lambda a, b: a + b, (F.when(facts[k], w).otherwise(0.0) for k, w in weights.items()), F.lit(base))
    relevance = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.round(total, 6)))
    return {"relevance": relevance, "verdict": F.when(relevance < keep, "noise").otherwise("kept")}


def validated(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """rows with ``reason``: the first check, by order, that fails; null if all hold. A check that is null fails."""
    return rows.withColumn("reason", F.coalesce(*(F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in checks.items())))


def changes(before: DataFrame, after: DataFrame, key: str, detectors: dict[str, Column]) -> DataFrame:
    """(key, kind) of what changed from one state to the next: detectors see the old row as ``old`` and the new as ``new``, structs that are null where there is none."""
    a = before.select(key, F.struct(*before.columns).alias("old"))
    b = after.select(key, F.struct(*after.columns).alias("new"))
    kinds = F.array_compact(F.array(*(F.when(F.coalesce(holds, F.lit(False)), kind) for kind, holds in detectors.items())))
    return a.join(b, key, "full").select(key, F.explode(kinds).alias("kind"))


def staged(rows: DataFrame, stages: dict[str, Column], done: Column) -> DataFrame:
    """(stage, waiting, finished) of a chain: an item waits at the first stage that it hasn't finished; done is how many it has."""
    names = list(stages)
    counted = rows.select(done.alias("__done"), *(ok.alias(name) for name, ok in stages.items()))
    reached = [reduce(lambda a, b: a & b, (F.col(n) for n in names[:k]), F.lit(True)) for k in range(len(names))]
    out = counted.agg(*(F.struct(F.count_if(reached[k] & (F.col("__done") <= k)).alias("waiting"), F.count_if(reached[k] & (F.col("__done") > k)).alias("finished")).alias(n) for k, n in enumerate(names)))
    return out.select(F.explode(F.array(*(F.struct(F.lit(n).alias("stage"), F.col(f"{n}.waiting").alias("waiting"), F.col(f"{n}.finished").alias("finished")) for n in names))).alias("s")).select("s.*")
