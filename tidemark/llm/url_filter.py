"""Allow and block rules over URLs, indexed by each rule's rarest literal token."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ascii_lower, cut

#: Rules up to this number are broadcast (each is a few hundred bytes); more are joined by a shuffle.
BROADCAST_RULES = 10_000


@dataclass(frozen=True)
class Rule:
    """A pattern over host and path, joined as they stand.

    ``*`` is any run of characters, ``^`` one character other than a letter or digit, or either
    end; a leading ``||`` holds the pattern to the start of the host or of one of its labels.
    All else is literal; ASCII case counts only if ``case`` says so. Of the rules that fit, the one of the highest tier wins, then the
    longest, then block before allow, then the first by name.
    """

    name: str
    pattern: str
    verdict: str
    tier: int = 0
    case: bool = True

    def regex(self) -> str:
        body = self.pattern.removeprefix("||")
        parts = [{"*": ".*", "^": "(?:^|$|[^A-Za-z0-9])"}.get(c, re.sub(r"([^A-Za-z0-9])", r"\\\1", c)) for c in body]
        return ("" if self.case else "(?i)") + (r"^(?:[^/]*\.)?" if body != self.pattern else "") + "".join(parts)

    def tokens(self) -> list[str]:
        """The literal tokens that every URL which the rule fits has as whole tokens."""
        text = self.pattern.replace("||", "^").lower()
        return sorted({m[0] for m in re.finditer(r"[a-z0-9]+", text) if text[: m.start()][-1:] not in ("", "*") and text[m.end() :][:1] not in ("", "*")})


def read_rules(lines: list[str]) -> list[Rule]:
    """Rules from lines of verdict, pattern and, where case counts, the word "case"; named by their pattern. # begins a comment."""
    parts = [p for line in lines if (p := line.split()) and not line.startswith("#")]
    return [Rule(pattern, pattern, verdict, 0, "case" in more) for verdict, pattern, *more in parts]


def host_and_path(url: Column) -> dict[str, Column]:
    """host: from the first :// up to /, ? or #, A-Z lower-cased; path: from there up to ? or #."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return {"host": ascii_lower(F.coalesce(host, F.lit(""))), "path": F.coalesce(path, F.lit(""))}


def url_tokens(host_path: Column) -> Column:
    """The distinct runs of letters and digits, and the empty token, which every URL has."""
    return F.array_union(F.array(F.lit("")), F.split(ascii_lower(host_path), "[^a-z0-9]+"))


def index_rules(urls: DataFrame, rules: list[Rule]) -> list[tuple]:
    """(token, regex, tier, length, order, name, verdict) of each rule.

    A rule's token is the one of its literal tokens that the fewest of ``urls`` have, so that
    few URLs fetch it. A rule without one has the empty token. Counted are only tokens of rules,
    so the counts are as many as those at most.
    """
    wanted = sorted({t for r in rules for t in r.tokens()})
    known = urls.sparkSession.createDataFrame([(t,) for t in wanted], "token string")
    seen = urls.select(F.explode(url_tokens(F.concat("host", "path"))).alias("token")).join(F.broadcast(known) if len(wanted) <= 4 * BROADCAST_RULES else known, "token").groupBy("token").count()
    count = {row["token"]: row["count"] for row in seen.collect()} if wanted else {}
    rarest = lambda r: min(r.tokens(), key=lambda t: (count.get(t, 0), -len(t), t), default="")
    ranked = sorted(rules, key=lambda r: (r.verdict != "block", r.name))
    return [(rarest(r), r.regex(), r.tier, len(r.pattern.removeprefix("||")), -k, r.name, r.verdict) for k, r in enumerate(ranked)]


def judge_urls(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url", otherwise: str = "allow") -> DataFrame:
    """page_id, host, path, fitted (the winning rule's name, or null), tier and verdict of each row.

    A null URL or one without :// has an empty host and path and, unless a rule without
    literals fits, the verdict ``otherwise``. Each distinct host and path is judged once,
    however many rows have it; rows then fetch the verdict by a join that AQE can split.
    Only rules whose token the URL has run their regular expression. Repeated and null ids are
    kept as they are; other columns are not read. An empty table gives an empty result.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url")).withColumns(host_and_path(F.col("url"))).drop("url")
    urls = cut(rows.select("host", "path").distinct())
    schema = "token string, regex string, tier int, length int, place int, name string, verdict string"
    index = spark.createDataFrame(index_rules(urls, rules), schema)
    candidates = urls.select("host", "path", F.explode(url_tokens(F.concat("host", "path"))).alias("token"))
    hits = candidates.join(F.broadcast(index) if len(rules) <= BROADCAST_RULES else index, "token").where(F.regexp_like(F.concat("host", "path"), F.col("regex")))
    best = hits.groupBy("host", "path").agg(F.max(F.struct("tier", "length", "place", "name", "verdict")).alias("best"))
    return rows.join(cut(best), ["host", "path"], "left").select(
        "page_id", "host", "path", F.col("best.name").alias("fitted"), F.col("best.tier").alias("tier"), F.coalesce("best.verdict", F.lit(otherwise)).alias("verdict")
    )
