from datetime import date

import pytest
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.operators import groups, intake, review, search, threads


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_queries_are_taken_apart():
    q = search.Query.parse('"Signed  contract" alpha OR "beta gamma" -draft -"old one" OR')
    assert q.clauses == ((("signed", "contract"),), (("alpha",), ("beta", "gamma"))) and q.without == (("draft",), ("old", "one"))
    assert search.Query.parse("  ").clauses == ()


def test_queries_against_texts(spark):
    docs = spark.createDataFrame([(1, "The signed contracts, alpha", False), (2, "contract signed alpha", False), (3, "signing contracts: beta gamma draft", False), (4, "Sign contract; beta\ngammas", True), (5, None, False)], "id int, text string, noise boolean")
    find = lambda t: rows(search.match_query(docs, "id", "text", search.Query.parse(t), F.col("noise")))
    assert find('"signed contract" alpha OR "beta gamma" -draft') == [(1, 3.0), (4, pytest.approx(1.2))]
    assert find("contract -alpha -draft") == [(4, pytest.approx(0.3))] and find("nothing") == []


@pytest.mark.parametrize(
    "phrase, out",
    [("last 30 days", ("2001-07-02", "2001-08-01")), ("next 2 months", ("2001-08-01", "2001-10-01")), ("next week", ("2001-08-06", "2001-08-12")), ("last quarter", ("2001-04-01", "2001-06-30")), ("since wednesday", ("2001-07-25", "2001-08-01")), ("recent", ("2001-07-02", "2001-08-01")), ("some day", None), ("last 3 eons", None)],
)
def test_time_ranges(phrase, out):
    found = search.time_range(phrase, date(2001, 8, 1))
    assert (tuple(map(str, found)) if found else None) == out


def test_headlines_mark_hits(spark):
    body = " ".join(f"w{k}" for k in range(30)) + " Contracts, " + " ".join(f"v{k}" for k in range(40)) + " contract end"
    said = spark.createDataFrame([(body,), ("no hit here",)], "t string")
    first, second = (r["h"] for r in search.headlines(said, "t", ["contract"], "h", 8).collect())
    assert first == "w28 w29 [Contracts,] v0 v1 v2 v3 v4 … [contract] end" and second == "no hit here"


def test_participants_and_evidence(spark):
    people = spark.createDataFrame([([("A@x.io", "a@x.io"), ("b@x.io", "Bo"), (" a@x.io", "Ada"), (None, "?"), ("", "?")],), ([],), (None,)], "p array<struct<email string, name string>>")
    got = [r["u"] for r in people.select(intake.unique_participants(F.col("p")).alias("u")).collect()]
    assert [(p["email"], p["name"]) for p in got[0]] == [("a@x.io", "Ada"), ("b@x.io", "Bo")] and got[1] == [] and got[2] is None
    ids = spark.createDataFrame([(list(range(25)), 99), ([1, 2], 2), ([], 1)], "e array<int>, i int").select(intake.pushed(F.col("e"), F.col("i")).alias("e"))
    assert [r["e"] for r in ids.collect()] == [[*range(6, 25), 99], [1, 2], [1]]


def test_deletions_below_a_folder_and_titles(spark):
    items = spark.createDataFrame([("a/b/c.txt",), ("a/bc.txt",), ("a/b",), ("z",)], "path string")
    gone = intake.with_deletions(items, spark.createDataFrame([("a/b/",), ("q",)], "path string"), "path")
    assert rows(gone) == [("a/b", True), ("a/b/c.txt", True), ("a/bc.txt", False), ("z", False)]
    titles = spark.createDataFrame([("Q3_plan_v2.docx",), ("Budget (final).pdf",), ("draft",), ("Report - copy",)], "t string")
    assert [r["t"] for r in titles.select(intake.clean_title(F.col("t")).alias("t")).collect()] == ["Q3 plan", "Budget", "draft", "Report"]


def test_signals_decoding_and_validation(spark):
    said = spark.createDataFrame([("URGENT: approve now",), ("I’ll do it",), ("go/no-go today",), (None,)], "t string")
    assert [r["k"] for r in said.select(text.signal_kind(F.col("t")).alias("k")).collect()] == ["escalation", "commitment", "decision_request", "development"]
    raw = spark.createDataFrame([("Zoë".encode(),), (b"\xef\xbb\xbfZo\xc3\xab",), ("Zoë".encode("utf-16"),), ("Zoë".encode("latin-1"),), (None,)], "b binary")
    assert [r["t"] for r in raw.select(text.decoded(F.col("b")).alias("t")).collect()] == ["Zoë"] * 4 + [None]
    checked = intake.validated(spark.createDataFrame([(1, "a"), (2, None), (3, "")], "id int, t string"), {"title": F.length("t") > 0, "id": F.col("id") < 3})
    assert rows(checked.select("id", "reason")) == [(1, None), (2, "title"), (3, "title")]


def test_delegates_precedence_and_first_with_rows(spark):
    tasks = spark.createDataFrame([(1, "law"), (2, "tax"), (3, "none")], "task int, skill string")
    people = spark.createDataFrame([(10, "law"), (11, "law"), (12, "tax")], "person int, skill string")
    loads = spark.createDataFrame([(10, 5), (11, 2)], "person int, load long")
    assert rows(review.delegates(tasks, people, loads, "skill").select("task", "delegate").na.fill(-1)) == [(1, 11), (2, 12), (3, -1)]
    feed = spark.createDataFrame([("m1", "books", 1.0), ("m1", "bank", 2.0), ("m2", "other", 3.0), ("m2", "books", 4.0)], "m string, source string, v double")
    assert rows(review.by_precedence(feed, ["m"], "source", ["bank", "books"], ["v"])) == [("m1", "bank", 2.0), ("m2", "books", 4.0)]
    one = spark.range(2)
    assert rows(groups.first_that_has_rows([one.where("id > 9"), one])) == [(0,), (1,)] and rows(groups.first_that_has_rows([one.where("id = 1"), one])) == [(1,)]


def test_threads_ladder(spark):
    columns = "thread int, sent int, mine boolean, automated boolean, asks boolean, addressed boolean, closes boolean"
    m = lambda t, s, **k: (t, s, *(k.get(c, c == "addressed") for c in ("mine", "automated", "asks", "addressed", "closes")))
    messages = spark.createDataFrame(
        [m(1, 1, asks=True), m(1, 2), m(2, 1, asks=True), m(2, 2, mine=True), m(3, 1, mine=True, asks=True), m(3, 2, automated=True), m(4, 1, addressed=False), m(5, 1, closes=True), m(6, 1, automated=True), m(7, 1, mine=True), m(8, 1, mine=True), m(9, 1, asks=True, closes=True)],
        columns,
    )
    promises = spark.createDataFrame([(7, True, True, 5), (8, True, False, 5)], "thread int, inbound boolean, is_open boolean, made_at int")
    got = {r["thread"]: (r["status"], r["since"]) for r in threads.thread_status(messages, promises).collect()}
    assert got == {
        1: ("AWAITING_US", 1), 2: ("ACTIVE", None), 3: ("AWAITING_THEM", 1), 4: ("FYI", None), 5: ("RESOLVED", None), 6: ("FYI", None), 7: ("AWAITING_THEM", 5), 8: ("RESOLVED", None), 9: ("AWAITING_US", 1),
    }
