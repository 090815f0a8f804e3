from pyspark.sql import functions as F

from tidemark.operators import detectors as d


def told(df):
    return {(r.kind, r.subject): (r.importance, r.requires_owner) for r in df.collect()}


def test_requests_of_buyers(spark):
    rows = [
        (1, 7, "CUSTOMER", True, "Send the report", "2026-01-05", None, None, 10.0), (1, 7, "CUSTOMER", True, "Send the deck", "2026-01-05", 3, None, 10.0), (2, None, "PROSPECT", True, "Send a quote", "2026-02-01", None, "Renewal 2026", 1.0),
        (3, None, "PROSPECT", True, "Send a quote", "2026-02-01", None, "New", 499_999.0), (4, None, "INVESTOR", True, "Send a quote", "2026-02-01", None, None, None), (5, None, "CUSTOMER", False, "x y", "2026-02-01", None, None, None), (6, None, "CUSTOMER", True, "x y", None, None, None, None),
    ]
    asks = spark.createDataFrame(rows, "item int, thread int, company_type string, inbound boolean, title string, due string, task int, deal_name string, deal_value double")
    found = d.requested(asks)
    assert told(found) == {("customer_deliverable_requested", "1"): (4, True), ("customer_deliverable_requested", "2"): (4, True), ("customer_deliverable_requested", "3"): (3, True)}
    key = asks.where("task = 3").select(d.text.action_key(F.col("title"))).first()[0]
    assert found.where("subject = '1'").first().fingerprint == f"change:customer_deliverable_requested:7:{key}"


def test_moves_documents_risks_investors_contracts(spark):
    moves = spark.createDataFrame([("TASK", 1, "2026-01-01", "2026-01-09", "P0", True, False), ("TASK", 2, "2026-01-09", "2026-01-01", "P2", False, False), ("TASK", 3, None, "2026-01-01", "P0", True, True)], "type string, id int, before string, after string, priority string, applied boolean, by_owner boolean")
    moves = moves.withColumn("before", F.to_date("before")).withColumn("after", F.to_date("after"))
    assert told(d.moved(moves)) == {("deadline_moved", "moved out"): (4, False), ("deadline_moved", "pulled in"): (3, True)}
    versions = spark.createDataFrame(
        [(1, "INVESTOR_DECK", 2, True, "Price", "high"), (1, "INVESTOR_DECK", 2, True, "Cash", "0.2"), (2, "OTHER", 3, True, None, None), (3, "OTHER", 1, True, "x", "critical"), (4, "OTHER", 2, True, "Old", "critical"), (4, "OTHER", 3, False, "New", "low"), (5, "OTHER", 2, True, "N", "0.7")],
        "document int, doc_type string, version int, significant boolean, label string, significance string",
    )
    assert {r.fingerprint: (r.importance, r.requires_owner) for r in d.changed_documents(versions).collect()} == {"change:document_changed:1:v2": (5, True), "change:document_changed:2:v3": (3, False), "change:document_changed:5:v2": (4, True)}
    risks = spark.createDataFrame([(1, True, 5), (2, True, 3), (3, False, 5), (4, True, 4)], "id int, created boolean, severity int")
    assert told(d.new_risks(risks)) == {("new_risk", "1"): (5, True), ("new_risk", "4"): (4, True)}
    firms = spark.createDataFrame([("Alpha Capital", "alpha.vc", "LOW"), ("Alpha", "alpha.vc", "HIGH"), ("Beta Fund", None, None)], "name string, domain string, relevance string")
    assert told(d.new_investors(firms)) == {("new_investor", "alpha.vc"): (5, True), ("new_investor", "beta fund"): (4, True)}
    signed = spark.createDataFrame([(1, "MSA"), (1, "msa"), (1, "NDA"), (None, "MSA"), (2, None)], "company int, contract string")
    both = d.folded_changes(d.signed_contracts(signed), d.new_risks(risks), d.new_risks(risks))
    assert {r.fingerprint for r in both.collect()} == {"change:contract_status_changed:1:msa", "change:contract_status_changed:1:nda", "change:new_risk:1", "change:new_risk:4"}


def test_results_meet_milestones(spark):
    facts = spark.createDataFrame(
        [(1, "PUBLICATION", "Hold-out AUC", "0.88", "Toxicity model report"), (2, "EXPERIMENT_REPORT", "hold-out AUCs", "0.88", "Deck"), (3, "PUBLICATION", "Latency", "3 ms", "Serving"), (4, "INVESTOR_DECK", "Hold-out AUC", "0.9", "Deck")],
        "item int, doc_type string, label string, value string, title string",
    )
    goals = spark.createDataFrame([(1, "Validate the toxicity model on patients"), (2, "Hire a cook")], "id int, title string")
    assert sorted((r.importance, r.requires_owner) for r in d.results(facts, goals).collect()) == [(3, False), (4, True)]


def test_ranks_of_kinds(spark):
    from tidemark.operators import ranks

    now = F.lit("2026-03-01").cast("timestamp")
    deals = spark.createDataFrame([(1, "Alpha deal", "OPEN", 50.0), (2, "Alpha", "LOST", None), (3, "Other", "OPEN", 90.0)], "id int, title string, status string, number double")
    goals = spark.createDataFrame([(1, "Close the round", 2), (2, "alpha first", None), (3, "none", None)], "id int, title string, place int")
    notes = spark.createDataFrame([(1, "talk about alpha", "2026-03-01"), (2, "alpha", "2025-01-01"), (3, "alpha", None)], "id int, body string, at string")
    found = {(r.type, r.id): round(r["rank"], 6) for r in ranks.ranked({"deal": deals, "goal": goals, "note": notes}, ["alpha"], now).collect()}
    assert found == {("deal", 1): 0.85, ("deal", 2): 0.3, ("goal", 1): 0.9, ("goal", 2): 1.0, ("note", 1): 0.7, ("note", 2): 0.3, ("note", 3): 0.3}
    assert [r.id for r in ranks.ranked({"deal": deals}, [], now, 2).collect()] == [3, 1]
