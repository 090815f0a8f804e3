import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.functions import dates, finance, formats, rounding, scoring, text

NY = "America/New_York"


def one(spark, column, **values):
    kinds = {str: "string", int: "int", float: "double", dt.date: "date", bool: "boolean", list: "array<string>"}
    schema = ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items()) or "x int"
    return spark.createDataFrame([tuple(values.values()) or (1,)], schema).select(column.alias("out")).first()["out"]


@pytest.mark.parametrize("instant, day", [("2026-10-07 02:30:00", "2026-10-06"), ("2026-10-07 04:30:00", "2026-10-07"), ("2026-11-01 03:59:59", "2026-10-31"), ("2026-11-01 04:00:00", "2026-11-01")])
def test_local_day_across_daylight_saving(spark, instant, day):
    at = F.col("at").cast("timestamp")
    assert str(one(spark, dates.local_day(at, NY), at=instant)) == day


def test_day_start_round_trip(spark):
    start = dates.day_start(F.lit("2026-11-02").cast("date"), NY)
    assert str(one(spark, start.cast("string"))) == "2026-11-02 05:00:00"


@pytest.mark.parametrize("raw, out", [("2026-02-03", dt.date(2026, 2, 3)), ("2026-2-3", None), ("2026-02-31", None), ("soon", None)])
def test_parse_day_is_strict(spark, raw, out):
    assert one(spark, dates.parse_day(F.col("raw")), raw=raw) == out


@pytest.mark.parametrize("day, n, out", [("2026-10-06", 1, "2026-10-07"), ("2026-10-09", 1, "2026-10-12"), ("2026-10-10", 1, "2026-10-12"), ("2026-10-11", 5, "2026-10-16"), ("2026-10-06", 0, "2026-10-06"), ("2026-10-06", 10, "2026-10-20")])
def test_business_days(spark, day, n, out):
    assert str(one(spark, dates.add_business_days(F.col("day").cast("date"), F.col("n")), day=day, n=n)) == out


@pytest.mark.parametrize("day, out", [("2026-10-06", "Today"), ("2026-10-07", "Tomorrow"), ("2026-10-03", "3d overdue"), ("2026-10-10", "in 4d"), ("2026-10-27", "in 3w"), ("2027-10-06", "2027-10-06")])
def test_relative_day(spark, day, out):
    assert one(spark, dates.relative_day(F.col("day").cast("date"), F.lit("2026-10-06").cast("date")), day=day) == out


def test_week_quarter_and_work_hours(spark):
    assert str(one(spark, dates.week_start(F.lit("2026-10-11").cast("date")))) == "2026-10-05"
    assert one(spark, dates.quarter_key(F.lit("2026-10-11").cast("date"))) == "2026-Q4"
    assert one(spark, dates.in_work_hours(F.lit("2026-10-06 14:00:00").cast("timestamp"), NY)) is True
    assert one(spark, dates.in_work_hours(F.lit("2026-10-10 14:00:00").cast("timestamp"), NY)) is False
    assert str(one(spark, dates.excel_day(F.lit(45000.7)))) == "2023-03-15"


def test_time_ago_and_days_between(spark):
    now = F.lit("2026-10-06 14:00:00").cast("timestamp")
    ago = lambda s: one(spark, dates.time_ago(F.lit(s).cast("timestamp"), now))
    assert [ago(s) for s in ("2026-10-06 13:59:40", "2026-10-06 13:30:00", "2026-10-06 09:00:00", "2026-10-01 14:00:00", "2026-07-01 14:00:00")] == ["just now", "30m ago", "5h ago", "5d ago", "3mo ago"]
    assert one(spark, dates.days_between_instants(F.lit("2026-10-05 02:00:00").cast("timestamp"), now)) == 2


@pytest.mark.parametrize("x, out", [(2.5, 3.0), (-2.5, -2.0), (2.4, 2.0), (-2.6, -3.0)])
def test_halves_go_up(spark, x, out):
    assert one(spark, rounding.half_up(F.col("x")), x=x) == out


def test_percent_bands_steps_and_backoff(spark):
    assert one(spark, rounding.percent(F.lit(1), F.lit(8))) == 13
    assert one(spark, rounding.percent(F.lit(1), F.lit(0))) is None
    assert one(spark, rounding.bands(F.lit(0.55), [(0.8, "HIGH"), (0.55, "MEDIUM")], "LOW")) == "MEDIUM"
    assert one(spark, rounding.backoff(F.lit(20), 5.0, 600.0)) == 600.0
    assert one(spark, rounding.recency(F.lit(45), 90.0)) == 0.5
    assert one(spark, scoring.urgency(F.lit(None).cast("int"))) == 0.5
    assert [one(spark, scoring.urgency(F.lit(d))) for d in (-5, 0, 1, 5, 100)] == [5.0, 5.0, 4.5, 3.0, 0.5]


def test_weights():
    assert sum(scoring.PRIORITY_WEIGHTS.values()) == sum(scoring.ATTENTION_WEIGHTS.values()) == 100
    assert sum(scoring.normalised_weights({"strategic": 90, "urgency": -4}).values()) == pytest.approx(100)
    assert scoring.normalised_weights({"urgency": -4})["urgency"] == 0
    assert scoring.normalised_weights(dict.fromkeys(scoring.PRIORITY_WEIGHTS, 0)) == scoring.PRIORITY_WEIGHTS


def task(**over):
    base = dict.fromkeys(("strategic", "revenue", "fundraising", "customer", "scientific", "risk", "opportunity", "blocks", "postponed"), 0) | {"uniqueness": 3, "due_days": None, "milestone_days": None, "milestone_status": None, "hard": False, "priority": "P2", "goal_status": None, "status": "NOT_STARTED"}
    kinds = {"due_days": "int", "milestone_days": "int", "milestone_status": "string", "goal_status": "string"}
    return {k: F.lit(v).cast(kinds[k]) if k in kinds else F.lit(v) for k, v in (base | over).items()}


def priority(spark, **over):
    t = task(**over)
    return one(spark, scoring.priority_score(scoring.priority_factors(t), t)["score"])


def test_priority_scores(spark):
    # 13 * 3 / 5 for uniqueness and 12 * 0.5 / 5 for urgency
    assert priority(spark) == 9.0
    assert priority(spark, due_days=0) == pytest.approx(7.8 + 12 + 2)
    assert priority(spark, milestone_days=-7) == pytest.approx(7.8 + 12 + 2.8)
    assert priority(spark, priority="P0") == pytest.approx(9.9) and priority(spark, status="WAITING") == pytest.approx(7.2)
    assert priority(spark, uniqueness=2) == pytest.approx(5.4)  # (5.2 + 1.2) * 0.85
    assert priority(spark, postponed=3) == 12.0
    high = dict.fromkeys(("strategic", "revenue", "fundraising", "customer", "scientific", "risk", "opportunity"), 5) | {"uniqueness": 5, "blocks": 4, "hard": True, "due_days": 0, "priority": "P0"}
    assert priority(spark, **high) == 100.0
    assert priority(spark, strategic=5, uniqueness=5) > priority(spark, strategic=1, uniqueness=1, due_days=0)
    t = task(strategic=5, risk=4, customer=3, due_days=0)
    f = scoring.priority_factors(t)
    assert one(spark, scoring.drivers(f, scoring.priority_score(f, t))) == "strategic, urgency, uniqueness"


def item(**over):
    base = {
        "noise": False, "relevance": "MEDIUM", "category": "OTHER", "company_type": "VENDOR", "company_relationship": None, "strategic_score": 0.0, "revenue": None, "fundraising": False, "fundraising_value": None, "risk_severity": None,
        "days_to_due": None, "hard": False, "deal_owner": False, "sole_recipient": False, "replied_before": False, "legal": False, "scientific": False, "opportunity_value": None, "asked": False, "owes_due_soon": False,
        "urgent_action": False, "decision_needed": False, "team_owned": False, "wrote": False, "change_importance": None, "change_soon": False,
    }
    kinds = {"company_relationship": "int", "revenue": "double", "fundraising_value": "double", "opportunity_value": "double", "risk_severity": "int", "days_to_due": "int", "change_importance": "int"}
    return {k: F.lit(v).cast(kinds[k]) if k in kinds else F.lit(v) for k, v in (base | over).items()}


@pytest.mark.parametrize(
    "over, level",
    [
        ({"noise": True, "asked": True}, "ARCHIVE"), ({"relevance": "LOW"}, "ARCHIVE"), ({}, "ARCHIVE"), ({"wrote": True}, "MONITOR"),
        ({"asked": True, "company_type": "CUSTOMER", "days_to_due": 3}, "TODAY"), ({"owes_due_soon": True, "days_to_due": 0, "company_type": "INVESTOR"}, "IMMEDIATE"), ({"owes_due_soon": True}, "TODAY"),
        ({"decision_needed": True}, "THIS_WEEK"), ({"team_owned": True}, "DELEGATE"), ({"team_owned": True, "decision_needed": True}, "DELEGATE"), ({"change_importance": 4}, "THIS_WEEK"), ({"change_importance": 4, "change_soon": True}, "TODAY"),
        ({"relevance": "CRITICAL", "risk_severity": 5, "category": "BOARD"}, "IMMEDIATE"),
    ],
)
def test_attention_levels(spark, over, level):
    assert one(spark, scoring.attention_score(item(**over))["level"]) == level


@pytest.mark.parametrize(
    "confidence, relevance, protected, out",
    [(0.8, None, None, "WRITE"), (0.79, "HIGH", None, "REVIEW"), (0.54, "CRITICAL", None, "DROP"), (float("nan"), "HIGH", None, "DROP"), (7.0, "LOW", None, "WRITE"), (0.99, "LOW", "ENTITY_MERGE", "REVIEW"), (0.3, "HIGH", "OWNER_CHANGE", "DROP"), (0.3, "CRITICAL", "OWNER_CHANGE", "REVIEW")],
)
def test_gate(spark, confidence, relevance, protected, out):
    assert one(spark, scoring.gate(F.lit(confidence), F.lit(relevance).cast("string"), F.lit(protected).cast("string"))) == out


@pytest.mark.parametrize("raw, out", [("  Ærøskøbing   Straße ", "aeroskobing strasse"), ("José ŁÓDŹ", "jose lodz"), ("", "")])
def test_fold(spark, raw, out):
    assert one(spark, text.fold(F.col("raw")), raw=raw) == out


def test_company_core_and_keys(spark):
    assert one(spark, text.company_core(F.lit("Northwind Holdings, Inc."))) == "northwind"
    assert one(spark, text.company_core(F.lit("Global Group"))) == "global"
    assert one(spark, text.company_core(F.lit("Capital One & Co."))) == "capital one" and one(spark, text.company_normal(F.lit("The Brightwater Therapeutics, Inc."))) == "brightwater therapeutics"
    assert one(spark, text.person_normal(F.lit("Dr. Henrik Sørensen, PhD"))) == "henrik sorensen" == one(spark, text.person_normal(F.lit("Sørensen, Henrik <h@x.io>")))
    alike = lambda a, b: one(spark, text.token_set_similarity(F.split(F.lit(a), " "), F.split(F.lit(b), " ")))
    assert alike("aurelius", "aurelius pharma") == 1.0 and alike("lumen pharma", "pharma") == 0.5
    assert one(spark, text.action_key(F.lit("Send the signed contracts to Ada"))) == one(spark, text.action_key(F.lit("ada: contract sign send")))


@pytest.mark.parametrize("word, stem", [("parties", "party"), ("sending", "send"), ("signed", "sign"), ("boxes", "box"), ("contracts", "contract"), ("class", "class"), ("ring", "ring"), ("hired", "hir"), ("hire", "hir"), ("revised", "revis"), ("revise", "revis"), ("status", "status"), ("need", "need"), ("studied", "study")])
def test_light_stem(spark, word, stem):
    assert one(spark, text.light_stem(F.col("w")), w=word) == stem


def test_action_tokens(spark):
    assert one(spark, text.action_tokens(F.lit("Please send the revised $1.5M packages to Ada's team by Friday. 0.88 hits"))) == ["send", "revis", "$1.5m", "packag", "ada", "team", "friday", "0.88", "hit"]
    same = lambda a, b, shared: one(spark, text.is_duplicate_action(text.action_tokens(F.lit(a)), text.action_tokens(F.lit(b)), F.lit(shared)))
    assert same("Sign Vantage NDA", "Sign Vantage mutual NDA via DocuSign", True) and not same("Sign Vantage NDA", "Sign Vantage mutual NDA via DocuSign", False)
    assert same("Send signed contracts", "send the signed contract", False)


def test_similarities(spark):
    a, b = F.array(F.lit("sign"), F.lit("contract"), F.lit("ada")), F.array(F.lit("contract"), F.lit("sign"))
    assert one(spark, text.jaccard(a, b)) == pytest.approx(2 / 3)
    assert one(spark, text.contextual_similarity(a, b)) == pytest.approx(0.9)
    assert one(spark, text.jaccard(F.array().cast("array<string>"), F.array().cast("array<string>"))) == 0.0
    assert one(spark, text.token_set_similarity(a, b)) == 1.0
    assert text.jaro_winkler_score("martha", "marhta") == pytest.approx(0.9611, abs=1e-4)
    assert text.jaro_winkler_score("dixon", "dicksonx") == pytest.approx(0.8133, abs=1e-4)
    assert text.jaro_winkler_score("abc", "xyz") == 0.0
    rows = spark.createDataFrame([("acme labs", "acme labs"), ("acme", None)], "a string, b string").select(text.jaro_winkler("a", "b").alias("s")).collect()
    assert [r["s"] for r in rows] == [1.0, None]


@pytest.mark.parametrize("raw, out", [("about $1.5M now", 1.5e6), ("$1,200 due", 1200.0), ("$40k", 4e4), ("no money", None)])
def test_money(spark, raw, out):
    assert one(spark, text.money_value(F.col("raw")), raw=raw) == out


@pytest.mark.parametrize("raw, out", [("1,234.50", 1234.5), ("n/a", 0.0), ("", 0.0)])
def test_parse_amount(spark, raw, out):
    assert one(spark, text.parse_amount(F.col("raw")), raw=raw) == out


def test_like_pattern_takes_wildcards_literally(spark):
    rows = spark.createDataFrame([("50%_x",), ("50ab",)], "t string")
    assert rows.where(F.col("t").like(text.like_pattern("%_"))).count() == 1


def test_profit_tree_and_books(spark):
    columns = [{"ColTitle": ""}] + [{"MetaData": [{"Name": "StartDate", "Value": a}, {"Name": "EndDate", "Value": b}]} for a, b in (("2026-08-01", "2026-08-31"), ("2026-09-01", "2026-09-12"))] + [{"ColTitle": "Total"}]
    report = {"Columns": columns, "Rows": [{"Rows": [{"group": "Income", "Summary": ["", "1,000.50", ""]}]}, {"group": "Expenses", "Summary": ["", "400", "70"]}]}
    assert finance.profit_rows(report) == [("2026-08", 1000.5, 400.0, 600.5, True), ("2026-09", 0.0, 70.0, -70.0, False)]
    money = spark.createDataFrame([(100, None), (250, "USD"), (7, "EUR"), (None, "USD")], "amount long, currency string")
    assert finance.balances(money).first().asDict() == {"usd": 3.5, "others": ["EUR"]}
    stages = [(False, 1.0, "x", "OPEN"), (True, 1.0, "x", "WON"), (True, 0.0, "Closed won", "LOST"), (True, 0.3, "Closed Won", "WON"), (True, 0.5, "other", "WON"), (True, 0.4, "other", "LOST")]
    df = spark.createDataFrame(stages, "closed boolean, p double, label string, want string")
    assert df.where(finance.stage_outcome(F.col("closed"), F.col("p"), F.col("label")) != F.col("want")).count() == 0


def test_deal_signals(spark):
    now = spark.createDataFrame([(1, "OPEN", 3), (2, "WON", 9), (3, "OPEN", 1), (4, "OPEN", 2), (5, "WON", 8)], "deal_id int, outcome string, place int")
    old = spark.createDataFrame([(1, "OPEN", 2), (2, "OPEN", 4), (3, "OPEN", 2), (5, "WON", 7)], "deal_id int, outcome string, place int")
    assert {(r["deal_id"], r["signal"]) for r in finance.deal_signals(now, old).collect()} == {(1, "advanced"), (2, "won"), (3, "moved_back"), (4, "created")}
    assert finance.deal_signals(now, old.limit(0)).count() == 0


@pytest.mark.parametrize("amount, out", [(0.0, "$0"), (1234.5, "$1,235"), (-1234.4, "-$1,234"), (9999.9, "$10,000"), (10_000.0, "$10K"), (123_456.0, "$123K"), (-6_000_000.0, "-$6M"), (6_150_000.0, "$6.2M"), (2.5e12, "$2.5T")])
def test_currency(spark, amount, out):
    assert one(spark, formats.currency(F.col("x")), x=amount) == out


@pytest.mark.parametrize("minutes, out", [(0, "0m"), (59, "59m"), (60, "1h"), (90, "1h 30m"), (1440, "24h")])
def test_minutes_label(spark, minutes, out):
    assert one(spark, formats.minutes_label(F.col("x")), x=minutes) == out


@pytest.mark.parametrize("name, letters, short", [("ada  lovelace king", "AL", "ada  love…"), (" x", "X", " x"), ("", "", ""), ("abcdefghi jkl", "AJ", "abcdefghi…")])
def test_initials_and_truncate(spark, name, letters, short):
    assert one(spark, formats.initials(F.col("x")), x=name) == letters
    assert one(spark, formats.truncate(F.col("x"), 10), x=name) == short


def test_plurals(spark):
    assert [one(spark, formats.pluralize(F.lit(n), "task")) for n in (0, 1, 2)] == ["0 tasks", "1 task", "2 tasks"]
