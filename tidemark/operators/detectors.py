"""What changed that a leader has to know: detectors over what a batch of items brought, each a few columns of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.operators import likeness
from tidemark.operators.groups import top_per_group

# Kinds of companies that buy, documents whose changes weigh more, documents that report results, and milestones that results bear on.
BUYERS = ["CUSTOMER", "PROSPECT"]
KEY_DOCUMENTS = ["INVESTOR_DECK", "FINANCIAL_MODEL", "CUSTOMER_CONTRACT", "CUSTOMER_PROPOSAL", "BOARD_DOCUMENT", "PARTNERSHIP_AGREEMENT"]
SCIENCE_DOCUMENTS = ["EXPERIMENT_REPORT", "SCIENTIFIC_DATA_SUMMARY", "PUBLICATION"]
# A deal's value from which a request weighs more, and the least severity of a risk that is news.
LARGE_DEAL, SERIOUS = 500_000, 4

def change(rows: DataFrame, kind: str, key: Column, importance: Column, requires: Column, subject: Column) -> DataFrame:
    return rows.select(F.lit(kind).alias("kind"), F.concat_ws(":", F.lit("change"), F.lit(kind), key).alias("fingerprint"), importance.cast("int").alias("importance"), requires.alias("requires_owner"), subject.cast("string").alias("subject"))


def significance_rank(significance: Column) -> Column:
    """A label or a number as a rank from 1 to 5; a number of 1 or less is a share of five."""
    number = significance.try_cast("double")
    scaled = F.greatest(F.lit(1), F.least(F.lit(5), F.floor(F.when(number <= 1, number * 5).otherwise(number) + 0.5)))
    named = F.lower(significance)
    return F.when(number.isNotNull(), scaled).when(named == "critical", 5).when(named == "high", 4).when(named == "medium", 3).otherwise(2).cast("int")


def requested(asks: DataFrame) -> DataFrame:
    """asks (item, thread, company_type, inbound, title, due, task, deal_name, deal_value): the earliest dated request of an item that a buyer sent, one with a task before others of its day."""
    dated = asks.where(F.col("inbound") & F.col("company_type").isin(BUYERS) & F.col("due").isNotNull())
    first = top_per_group(dated, ["item"], [F.asc("due"), F.desc(F.col("task").isNotNull()), F.asc("title")])
    renewal = F.coalesce(F.contains(F.lower("deal_name"), F.lit("renewal")), F.lit(False))
    weighs = renewal | (F.coalesce("deal_value", F.lit(0.0)) >= LARGE_DEAL) | (F.col("company_type") == "CUSTOMER")
    key = F.concat_ws(":", F.coalesce(F.col("thread").cast("string"), F.col("item").cast("string")), text.action_key(F.col("title")))
    return change(first, "customer_deliverable_requested", key, F.when(weighs, 4).otherwise(3), F.lit(True), F.col("item"))


def moved(due_changes: DataFrame) -> DataFrame:
    """due_changes (type, id, before, after, priority, applied, by_owner): dates that moved from a known one."""
    rows = due_changes.where(F.col("before").isNotNull() & F.col("after").isNotNull() & (F.col("before") != F.col("after")))
    key = F.concat_ws(":", "type", F.col("id").cast("string"), F.date_format("after", "yyyy-MM-dd"))
    return change(rows, "deadline_moved", key, F.when(F.col("priority").isin("P0", "P1"), 4).otherwise(3), ~F.col("applied") | F.col("by_owner"), F.when(F.col("after") > F.col("before"), "moved out").otherwise("pulled in"))


def changed_documents(versions: DataFrame) -> DataFrame:
    """versions (document, doc_type, version, significant, label, significance), a row a change of a version: the latest version of a document, if it is significant and not its first, by its weightiest change."""
    latest = top_per_group(versions, ["document"], [F.desc("version"), F.desc(significance_rank(F.col("significance"))), F.asc("label")])
    rows = latest.where(F.col("significant") & (F.col("version") > 1))
    rank = F.greatest(F.when(F.col("label").isNotNull(), significance_rank(F.col("significance"))).otherwise(3), F.lit(3)) + F.col("doc_type").isin(KEY_DOCUMENTS).cast("int")
    weight = F.least(rank, F.lit(5))
    return change(rows, "document_changed", F.concat(F.col("document").cast("string"), F.lit(":v"), F.col("version").cast("string")), weight, weight >= 4, F.col("label"))


def results(facts: DataFrame, milestones: DataFrame, least: float = 0.3) -> DataFrame:
    """facts (item, doc_type, label, value, title) of science documents, milestones (id, title): each reported result once, and whether it bears on a milestone, of whose title it has ``least`` of the tokens. Facts and milestones meet by a rare token."""
    rows = facts.where(F.col("doc_type").isin(SCIENCE_DOCUMENTS))
    key = F.concat_ws("=", text.action_key(F.col("label")), F.col("value").cast("string"))
    said = rows.select(key.alias("id"), text.action_tokens(F.concat_ws(" ", "label", "title")).alias("tokens"), "label")
    once = said.groupBy("id").agg(F.min("label").alias("label"), F.array_distinct(F.flatten(F.collect_set("tokens"))).alias("tokens"))
    goals = milestones.select("id", text.action_tokens(F.col("title")).alias("tokens"))
    met = likeness.with_tokens(likeness.containment_candidates(goals, once, least, of_left=True), goals, once)
    near = met.where(text.token_coverage(F.col("left_tokens"), F.col("right_tokens")) >= least).select(F.col("right_id").alias("id"), F.lit(True).alias("bears")).distinct()
    both = once.join(near, "id", "left").withColumn("bears", F.coalesce("bears", F.lit(False)))
    return change(both, "new_scientific_result", F.col("id"), F.when(F.col("bears"), 4).otherwise(3), F.col("bears"), F.col("label"))


def new_risks(risks: DataFrame) -> DataFrame:
    """risks (id, created, severity): those that are new and serious."""
    return change(risks.where(F.col("created") & (F.col("severity") >= SERIOUS)), "new_risk", F.col("id").cast("string"), F.least(F.col("severity"), F.lit(5)), F.lit(True), F.col("id"))


def new_investors(pending: DataFrame) -> DataFrame:
    """pending (name, domain, relevance): firms that wait for a decision, once each; 5 if a source of theirs is loud, else 4."""
    loud = F.max(F.col("relevance").isin("HIGH", "CRITICAL").cast("int"))
    each = pending.groupBy(F.coalesce("domain", text.fold(F.col("name"))).alias("who")).agg(F.coalesce(loud, F.lit(0)).alias("loud"))
    return change(each, "new_investor", F.col("who"), F.col("loud") + 4, F.lit(True), F.col("who"))


def signed_contracts(signings: DataFrame) -> DataFrame:
    """signings (company, contract): once for each company and kind of contract."""
    each = signings.where("company IS NOT NULL AND contract IS NOT NULL").select(F.col("company").cast("string").alias("company"), F.lower("contract").alias("contract")).distinct()
    return change(each, "contract_status_changed", F.concat_ws(":", "company", "contract"), F.lit(5), F.lit(True), F.col("company"))


def folded_changes(*found: DataFrame) -> DataFrame:
    """All changes, a fingerprint once: the most important of its rows, owed to the owner if any of them is."""
    every = found[0]
    for one in found[1:]:
        every = every.unionByName(one)
    return every.groupBy("kind", "fingerprint").agg(F.max("importance").alias("importance"), F.bool_or("requires_owner").alias("requires_owner"), F.min("subject").alias("subject"))
