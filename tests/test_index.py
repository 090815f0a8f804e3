import random
import re

import pytest
from pyspark.sql import functions as F

from tidemark.operators import index
from tidemark.operators.search import Query

WORDS = "contract contracts signed sign board budget the of and renewal renewals".split()


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(4)
    rows = [(k, rng.choice(["plan", "signed contract", None]), " ".join(rng.choice(WORDS) for _ in range(rng.randrange(0, 30)))) for k in range(120)]
    return rows, spark.createDataFrame(rows, "id int, title string, body string").repartition(4)


def stem(w: str) -> str:
    return {"contracts": "contract", "signed": "sign", "renewals": "renewal"}.get(w, w)


def slow_closeness(row, asked, weights):
    rank, shortest, kinds = 0.0, None, set()
    for text, weight in zip(row[1:], weights, strict=True):
        words = [stem(w) for w in re.findall("[a-z0-9]+", (text or "").lower())]
        kinds |= set(words) & set(asked)
        rank += sum(weight * words.count(a) / (words.count(a) + 1) for a in asked)
        runs = [(i, j) for i in range(len(words)) for j in range(i, len(words)) if set(asked) <= set(words[i : j + 1])]
        least = [(i, j) for i, j in runs if not any((a, b) != (i, j) and i <= a and b <= j for a, b in runs)]
        rank += sum(weight / (j - i + 1) for i, j in least)
        shortest = min([shortest or 10**9, *(j - i + 1 for i, j in least)])
    return (round(rank, 9), None if shortest == 10**9 else shortest) if kinds == set(asked) else None


def test_closeness_equals_all_runs(spark, docs, tmp_path):
    rows, df = docs
    index.write_index(df, str(tmp_path / "0"), "id", ["title", "body"])
    got = {r.id: (round(r["rank"], 9), r.shortest) for r in index.closeness(spark, [str(tmp_path / "0")], ["signed", "contracts", "of"], {"title": 1.0, "body": 0.4}).collect()}
    want = {r[0]: c for r in rows if (c := slow_closeness(r, ["sign", "contract", "of"], (1.0, 0.4)))}
    assert got == want and 20 < len(want) < 120


def test_segments_stand_for_what_they_cover_and_merge(spark, docs, tmp_path):
    rows, df = docs
    paths = [str(tmp_path / k) for k in "abc"]
    index.write_index(df, paths[0], "id", ["title", "body"])
    later = [(3, None, "entirely new words"), (5, "plan", ""), (500, "signed contract", "the budget")]
    index.write_index(spark.createDataFrame(later, "id int, title string, body string"), paths[1], "id", ["title", "body"])
    now = {r[0]: r for r in rows} | {r[0]: r for r in later}
    fresh = spark.createDataFrame(list(now.values()), "id int, title string, body string")
    want = sorted(map(str, index.postings(fresh, "id", ["title", "body"]).drop("bucket").collect()))
    assert sorted(map(str, index.read_index(spark, paths[:2]).collect())) == want
    index.merge_index(spark, paths[:2], paths[2])
    assert sorted(map(str, index.read_index(spark, paths[2:]).collect())) == want
    ids = {r.id for r in index.match_stems(spark, paths[:2], ["new", "words"]).collect()}
    assert ids == {3} and 5 not in {r.id for r in index.match_stems(spark, paths[:2], ["budget"], fields=["body"]).collect()}


def test_a_search_reads_the_buckets_of_its_stems(spark, docs, tmp_path):
    path = str(tmp_path / "0")
    index.write_index(docs[1], path, "id", ["title", "body"])
    plan = index.read_index(spark, [path], ["contract"])._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[.*bucket", plan) and re.search(r"PushedFilters: \[.*stem", plan)


def test_queries_and_tiers(spark, docs, tmp_path):
    rows, df = docs
    path = str(tmp_path / "0")
    index.write_index(df, path, "id", ["title", "body"])
    body = {r[0]: [stem(w) for w in r[2].split()] for r in rows}
    got = {r.id: r["rank"] for r in index.match_index(spark, [path], Query.parse('"the budget" OR board -renewal'), spark.createDataFrame([(k,) for k in range(60)], "id int"), ["body"]).collect()}
    want = {}
    for k, w in body.items():
        phrase = any(w[i : i + 2] == ["the", "budget"] for i in range(len(w)))
        if (phrase or "board" in w) and "renewal" not in w:
            want[k] = sum(w.count(x) for x in ("the", "budget", "board")) * (0.3 if k < 60 else 1.0)
    assert want and got == pytest.approx(want)
    tiers = {(r.term, r.tier) for r in index.match_tiers(spark, [path], ["contract", "bud", "udge", "zzz"], ["body"]).collect()}
    assert tiers == {("contract", 1), ("bud", 2), ("udge", 3)}
    assert index.match_stems(spark, [path], ["the"], ["of"], ["body"]).select(F.collect_set("id")).first()[0].__len__() == sum("the" in w and "of" not in w for w in body.values())


def planned(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_postings_are_gathered_within_a_row(spark, docs, monkeypatch):
    rows, df = docs
    assert "Exchange" not in planned(index.postings(spark.createDataFrame(rows, "id int, title string, body string"), "id", ["title", "body"]))
    monkeypatch.setattr(index, "PLACES", 7)  # texts of several parts
    got = {}
    for r in index.postings(df, "id", ["title", "body"]).collect():
        assert len({(p - 1) // 7 for p in r.places}) == 1 and r.places == sorted(r.places)
        got.setdefault((r.id, r.field, r.word), []).extend(r.places)
    want = {}
    for k, *texts in rows:
        for field, text in zip(("title", "body"), texts, strict=True):
            for at, word in enumerate(re.split("[^a-z0-9]+", (text or "").lower()), 1):
                if word:
                    want.setdefault((k, field, word), []).append(at)
    assert {key: sorted(v) for key, v in got.items()} == want


def test_tiers_do_not_shuffle_the_words_of_the_index(spark, docs, tmp_path):
    path = str(tmp_path / "0")
    index.write_index(docs[1], path, "id", ["title", "body"])
    plan = planned(index.match_tiers(spark, [path], ["contract", "bud"], ["body"]))
    assert not re.search(r"Exchange hashpartitioning\(word", plan) and "SortMergeJoin" not in plan
