"""Priority of tasks, attention for incoming items and the confidence gate, as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.rounding import clamp, half_up, steps

# Weights of a task's eleven factors, which sum to 100.
PRIORITY_WEIGHTS = {"strategic": 16, "urgency": 12, "revenue": 10, "fundraising": 10, "customer": 7, "scientific": 6, "risk": 8, "dependency": 7, "uniqueness": 13, "deadline": 5, "opportunity": 6}
# Urgency (0 to 5) by days until due.
URGENCY = [(0, 5.0), (1, 4.5), (3, 4.0), (7, 3.0), (14, 2.0), (30, 1.0)]
# What multiplies a task's score, by manual priority and by status.
BY_PRIORITY = {"P0": 1.1, "P1": 1.04, "P3": 0.85}
BY_STATUS = {"BLOCKED": 0.93, "WAITING": 0.8}
# Weights of an incoming item's twelve factors, which sum to 100.
ATTENTION_WEIGHTS = {"strategic": 14, "revenue": 9, "fundraising": 10, "customer": 8, "risk": 9, "urgency": 13, "deadline": 5, "ownership": 8, "legal": 5, "science": 4, "opportunity": 5, "directAsk": 10}
# How much an amount of money counts, from the highest band down, and nearness of a date.
MONEY = [(5e6, 1.0), (1e6, 0.9), (3e5, 0.75), (1e5, 0.5), (1e-9, 0.3)]
NEARNESS = [(0, 1.0), (1, 0.9), (2, 0.8), (7, 0.6), (14, 0.35)]
# Categories and companies that make an item one of a key party.
KEY_CATEGORIES = ["INVESTOR", "FUNDRAISING", "BOARD", "CUSTOMER", "STRATEGIC_PARTNER", "COMMERCIAL_OPPORTUNITY", "LEGAL"]
KEY_COMPANIES = ["CUSTOMER", "PROSPECT", "INVESTOR", "PARTNER"]
# Levels of attention, lowest first.
LEVELS = ["ARCHIVE", "DELEGATE", "MONITOR", "THIS_WEEK", "TODAY", "IMMEDIATE"]


def normalised_weights(weights: dict[str, float] | None = None, default: dict[str, float] = PRIORITY_WEIGHTS) -> dict[str, float]:
    """Weights that sum to 100: missing ones by default, negatives 0; the default ones if none is left."""
    kept = {k: max(0.0, float((weights or {}).get(k, v))) for k, v in default.items()}
    total = sum(kept.values())
    return {k: v * 100 / total for k, v in kept.items()} if total > 0 else dict(default)


def normalised(given: DataFrame, groups: DataFrame, defaults: DataFrame) -> DataFrame:
    """(grp, factor, weight) for every group and factor: each group's weights, brought to a sum of 100.

    given (grp, factor, weight), groups (grp), defaults (factor, weight): a fixed list of factors, so
    it is broadcast. A missing weight counts as its default, a negative one as 0; a group of which
    nothing is left takes the defaults.
    """
    every = groups.select("grp").distinct().crossJoin(F.broadcast(defaults.select("factor", F.col("weight").alias("usual"))))
    both = every.join(given, ["grp", "factor"], "left").withColumn("own", F.greatest(F.lit(0.0), F.coalesce("weight", "usual")))
    sums = both.groupBy("grp").agg(F.sum("own").alias("total"), F.sum("usual").alias("usual_total"))
    share = F.when(F.col("total") > 0, F.col("own") * 100 / F.col("total")).otherwise(F.col("usual") * 100 / F.col("usual_total"))
    return both.join(sums, "grp").select("grp", "factor", share.alias("weight"))


def urgency(days: Column) -> Column:
    """From 5 for today or overdue down to 0.5, also without a date."""
    return F.when(days.isNull(), 0.5).otherwise(steps(days, URGENCY, 0.5))


def priority_factors(t: dict[str, Column]) -> dict[str, Column]:
    """The eleven factors, 0 to 5, of a task.

    t has the impacts, risk, uniqueness and opportunity as numbers, due_days, milestone_days and
    milestone_status (null without), blocks (open tasks that wait for it) and hard. A milestone's
    pressure counts a week later than its day.
    """
    five = lambda x: clamp(x.cast("double"), 0.0, 5.0)
    ms = t["milestone_days"]
    near = F.when(ms <= 14, 2).when(ms <= 30, 1).otherwise(0)
    at_risk = F.coalesce(t["milestone_status"].isin("AT_RISK", "BLOCKED"), F.lit(False)).cast("int")
    own = {k: five(t[k]) for k in ("strategic", "revenue", "fundraising", "customer", "scientific", "risk", "uniqueness", "opportunity")}
    return own | {
        "urgency": urgency(F.least(t["due_days"], ms + 7)),  # least skips nulls
        "dependency": five(t["blocks"] * 1.5 + near + at_risk),
        "deadline": F.when(t["hard"], 5.0).when(t["due_days"].isNotNull(), 2.0).otherwise(0.0),
    }


def priority_score(factors: dict[str, Column], t: dict[str, Column], weights: dict[str, float] | None = None) -> dict[str, Column]:
    """Points of each factor, to one decimal, and the score.

    The points are added as rounded; priority, a goal at risk, delegability, and status multiply
    in this order; a task put off three times or more gets 3 points after that; the score lies
    between 0 and 100, to one decimal.
    """
    use = normalised_weights(weights)
    points = {k: half_up(factors[k] * use[k] / 5, 1) for k in PRIORITY_WEIGHTS}
    of = lambda column, table: reduce(lambda w, kv: w.when(column == kv[0], kv[1]), table.items(), F.when(F.lit(False), 1.0)).otherwise(1.0)
    multipliers = [
        of(t["priority"], BY_PRIORITY),
        F.when(t["goal_status"].isin("AT_RISK", "OFF_TRACK"), 1.05).otherwise(1.0),
        F.when(t["uniqueness"] <= 2, 0.85).otherwise(1.0),
        of(t["status"], BY_STATUS),
    ]
    raw = reduce(lambda a, b: a * b, multipliers, reduce(lambda a, b: a + b, points.values()))
    raw = raw + F.when(t["postponed"] >= 3, 3.0).otherwise(0.0)
    return {f"{k}_points": v for k, v in points.items()} | {"score": clamp(half_up(raw, 1), 0.0, 100.0)}


def drivers(factors: dict[str, Column], points: dict[str, Column], least: float = 3.0, n: int = 3) -> Column:
    """The names of the n factors with most points, of those at ``least`` or more; ties in the factors' order."""
    rows = F.array(*(F.struct((-points[f"{k}_points"]).alias("p"), F.lit(i).alias("i"), F.lit(k).alias("k"), factors[k].alias("v")) for i, k in enumerate(PRIORITY_WEIGHTS)))
    strong = F.slice(F.array_sort(F.filter(rows, lambda r: r["v"] >= least)), 1, n)
    return F.array_join(F.transform(strong, lambda r: r["k"]), ", ")


def money_weight(amount: Column) -> Column:
    out = F.when(amount.isNull(), 0.0)
    for bound, value in MONEY:
        out = out.when(amount >= bound, value)
    return out.otherwise(0.0)


def attention_score(i: dict[str, Column]) -> dict[str, Column]:
    """score (0 to 100) and level of an incoming item.

    i has: noise, relevance, category, company_type, company_relationship, strategic_score,
    revenue, fundraising, fundraising_value, risk_severity, days_to_due, hard, deal_owner,
    sole_recipient, replied_before, legal, scientific, opportunity_value, asked, owes_due_soon,
    urgent_action, decision_needed, team_owned, wrote, change_importance, change_soon. The score
    is rounded once; the level is the first of a ladder that fits, lifted by important changes.
    """
    true = lambda c: F.coalesce(c, F.lit(False))
    key_category = true(i["category"].isin(KEY_CATEGORIES))
    key_party = true(i["company_type"].isin(KEY_COMPANIES)) | key_category
    some = lambda c, v: F.when(true(c), v).otherwise(0.0)
    days = i["days_to_due"]
    factors = {
        "strategic": F.greatest(clamp(i["strategic_score"], 0.0, 1.0), F.when(key_category, 0.6).otherwise(0.3)),
        "revenue": F.greatest(money_weight(i["revenue"]), some(i["category"].isin("CUSTOMER", "COMMERCIAL_OPPORTUNITY"), 0.4)),
        "fundraising": F.when(true(i["fundraising"]), F.greatest(F.lit(0.8), money_weight(i["fundraising_value"]))).otherwise(some(i["category"] == "BOARD", 0.5)),
        "customer": F.when(i["company_type"] == "CUSTOMER", F.least(F.lit(1.0), 0.5 + 0.1 * F.coalesce(i["company_relationship"], F.lit(3)))).otherwise(some(i["company_type"] == "PROSPECT", 0.5)),
        "risk": F.coalesce(i["risk_severity"] / 5, F.lit(0.0)),
        "urgency": F.when(days.isNull(), 0.0).otherwise(steps(days, NEARNESS, 0.1)),
        "deadline": some(i["hard"], 1.0),
        "ownership": F.least(F.lit(1.0), some(i["deal_owner"], 0.4) + some(i["sole_recipient"], 0.4) + some(i["replied_before"], 0.3)),
        "legal": some(i["legal"], 0.8),
        "science": some(i["scientific"], 0.6),
        "opportunity": money_weight(i["opportunity_value"]),
        "directAsk": some(i["asked"], 1.0),
    }
    raw = reduce(lambda a, b: a + b, (factors[k] * w for k, w in ATTENTION_WEIGHTS.items()))
    relevance = F.when(i["relevance"] == "CRITICAL", 10).when(i["relevance"] == "HIGH", 5).when(i["relevance"] == "LOW", -10).otherwise(0)
    score = clamp(F.floor(raw + relevance + 0.5), 0, 100)

    soon = lambda n: true(days <= n)
    severe = F.coalesce(i["risk_severity"], F.lit(0))
    asked, owes, decide = true(i["asked"]), true(i["owes_due_soon"]), true(i["decision_needed"])
    team = true(i["team_owned"])
    rank = {name: k for k, name in enumerate(LEVELS)}
    critical = true(i["relevance"] == "CRITICAL") & ((true(i["urgent_action"]) & asked) | ((severe >= 5) & key_party))
    level = (
        F.when((score >= 66) | (owes & soon(0) & key_party) | critical, rank["IMMEDIATE"])
        .when((score >= 50) | (asked & key_party & soon(3)) | owes | (decide & soon(2)) | ((severe >= 4) & key_party), rank["TODAY"])
        .when((score >= 35) | (asked & soon(7)) | decide, rank["THIS_WEEK"])
        .when(team & ~asked, rank["DELEGATE"])
        .when((score >= 18) | true(i["wrote"]), rank["MONITOR"])
        .otherwise(rank["ARCHIVE"])
    )
    change = i["change_importance"]
    lift = F.when((change >= 5) | ((change >= 4) & true(i["change_soon"])), rank["TODAY"]).when(change >= 4, rank["THIS_WEEK"]).when(change.isNotNull(), rank["MONITOR"]).otherwise(0)
    level = F.greatest(level, lift)
    level = F.when(team & ~asked & (level == rank["THIS_WEEK"]) & (score < 50), rank["DELEGATE"]).otherwise(level)
    noise = true(i["noise"]) | true(i["relevance"] == "NOISE")
    named = F.element_at(F.array(*map(F.lit, LEVELS)), level + 1)
    return {"score": F.when(noise, 0).otherwise(score), "level": F.when(noise, "ARCHIVE").otherwise(named)}


def gate(confidence: Column, relevance: Column, protected: Column) -> Column:
    """WRITE, REVIEW or DROP: from 0.80 written, from 0.55 reviewed; what is protected is always
    reviewed, but with little confidence only if the source is critical. No number counts as 0."""
    sure = F.when(F.isnan(confidence) | confidence.isNull(), 0.0).otherwise(confidence)
    return (
        F.when(protected.isNotNull(), F.when((sure < 0.55) & ~F.coalesce(relevance == "CRITICAL", F.lit(False)), "DROP").otherwise("REVIEW"))
        .when(sure >= 0.8, "WRITE").when(sure >= 0.55, "REVIEW").otherwise("DROP")
    )
