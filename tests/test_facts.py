from pyspark.sql import functions as F

from tidemark.operators import facts


def facts_of(spark, versions):
    df = spark.createDataFrame(versions, "doc_id int, text string").withColumn("f", facts.extract_facts("text"))
    return df.select("doc_id", F.posexplode("f").alias("place", "x")).select("doc_id", "place", "x.*")


def test_changes_by_significance(spark):
    before = facts_of(spark, [(1, "Raising $35M for the round. Burn is $1.15M. Profiled 410 donor hearts. Round close December 30, 2026. Product launch November 20, 2026.")])
    after = facts_of(spark, [(1, "Raising $40M for the round. Burn is $1.2M. Profiled 410 donor hearts. Round close January 22, 2027. Product launch November 23, 2026. Margin is 71%."), (2, "Raising $9M.")])
    got = {(r["kind"], r["from_value"], r["to_value"]): (r["change"], r["significance"], r["delta_pct"], r["delta_days"]) for r in facts.fact_changes(before, after).collect()}
    assert got == {
        ("money", "$35M", "$40M"): ("changed", "HIGH", 14.3, None), ("money", "$1.15M", "$1.2M"): ("changed", "MEDIUM", 4.3, None),
        ("date", "2026-12-30", "2027-01-22"): ("changed", "HIGH", None, 23.0), ("date", "2026-11-20", "2026-11-23"): ("changed", "MEDIUM", None, 3.0), ("percent", None, "71%"): ("added", "MEDIUM", None, None),
    }


def test_pairs_by_order_and_removals(spark):
    before = facts_of(spark, [(1, "Runway 16.6 months. Runway 13.1 months. Proposal fee $350K.")])
    after = facts_of(spark, [(1, "Runway 15.9 months. Runway 12.4 months.")])
    got = {(r["from_value"], r["to_value"], r["change"]) for r in facts.fact_changes(before, after).collect()}
    assert got == {("16.6 months", "15.9 months", "changed"), ("13.1 months", "12.4 months", "changed"), ("$350K", None, "removed")}


def test_ratio_and_significant_documents(spark):
    a = spark.createDataFrame([(1, "Same here."), (1, "Gone now."), (2, "x")], "doc_id int, sentence string")
    b = spark.createDataFrame([(1, "same  here."), (1, "New text."), (2, "x")], "doc_id int, sentence string")
    ratios = {r["doc_id"]: round(r["ratio"], 3) for r in facts.text_change_ratio(a, b).collect()}
    assert ratios == {1: 0.474, 2: 0.0}
    changes = spark.createDataFrame([(2, "MEDIUM"), (3, "HIGH"), (4, "MEDIUM"), (4, "MEDIUM")], "doc_id int, significance string")
    assert {r[0] for r in facts.significant_documents(changes, facts.text_change_ratio(a, b)).collect()} == {1, 3, 4}
