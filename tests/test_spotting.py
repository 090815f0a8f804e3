import random

from pyspark.sql import functions as F

from tidemark.operators import intake, spotting


def slow_spots(words, names):
    found, at = [], 0
    while at < len(words):
        size = max((len(n) for n in names if words[at : at + len(n)] == n), default=0)
        if size:
            found.append((at, size))
        at += size or 1
    return found


def test_spots_equal_a_plain_scan(spark):
    rng = random.Random(2)
    say = lambda n: [rng.choice("abcde") for _ in range(n)]
    names = [say(rng.randint(1, 8)) for _ in range(40)] + [["new", "york"], ["new", "york", "city", "ballet"], ["york", "city"]]
    texts = [say(rng.randint(0, 60)) for _ in range(200)] + ["a new york city ballet in new york city".split(), []]
    items = spark.createDataFrame([(k % 150, ", ".join(t).upper()) for k, t in enumerate(texts)] + [(900, None)], "id int, text string").repartition(5)
    frame = spark.createDataFrame([(" ".join(n),) for n in names], "run string")
    got = sorted((r.id, r.run, r.at, r["size"]) for r in spotting.spots(items, "text", frame, ["id"]).collect())
    want = sorted((k % 150, " ".join(t[at : at + n]), at, n) for k, t in enumerate(texts) for at, n in slow_spots(t, names))
    assert got == want and len(want) > 500


def test_mentions_of_long_and_shared_names(spark):
    names = spark.createDataFrame([(1, "New York City Ballet"), (2, "Ada Inc"), (3, "New York"), (4, "ADA inc."), (5, "")], "entity int, name string")
    items = spark.createDataFrame([(7, "The New-York City ballet met Ada, Inc. in New York; Ada Inc")], "id int, text string")
    assert sorted(tuple(r) for r in spotting.mentions(items, "id", "text", names).collect()) == [(7, 1, 1), (7, 2, 2), (7, 3, 1), (7, 4, 2)]


def test_lexicon_of_all_kinds(spark):
    people = spark.createDataFrame([(1, "Ada Lovelace"), (2, None)], "pid int, full string")
    firms = spark.createDataFrame([(1, "Fabrikam")], "cid int, title string")
    also = spark.createDataFrame([("person", 1, "Ada L.", 0.9), ("person", 1, "ADA lovelace", 1.0), ("firm", 1, "FBK", 0.5)], "kind string, entity int, alias string, confidence double")
    got = {tuple(r) for r in spotting.lexicon({"person": (people, "pid", "full"), "firm": (firms, "cid", "title")}, also).collect()}
    assert got == {("person", "1", "Ada Lovelace", "name"), ("person", "1", "Ada L.", "alias"), ("firm", "1", "Fabrikam", "name")}


def test_titles(spark):
    cases = {
        "Budget 2026.xlsx": "Budget 2026", "Series B deck 3.pdf": "Series B deck 3", "Deck (3).pdf": "Deck", "Plan_v2.docx": "Plan", "Plan v1.2": "Plan", "Plan version 3.docx": "Plan", "Plan V 2": "Plan", "Q3 follow-up": "Q3 follow-up", "Report-final.doc": "Report",
        "Report – draft": "Report", "Photocopy": "Photocopy", "final": "final", "v2.pdf": "v2.pdf", "Plan (final).pdf": "Plan", "Plan (v3)": "Plan", "Plan final v2": "Plan final", "(3)": "(3)", "": "", "a_b_c": "a b c", "Version 7": "Version 7", "Minutes 2026-01-05": "Minutes 2026-01-05",
    }
    df = spark.createDataFrame([(k,) for k in cases] + [(None,)], "t string")
    got = {r.t: r.c for r in df.select("t", intake.clean_title(F.col("t")).alias("c")).collect()}
    assert got == cases | {None: None}
