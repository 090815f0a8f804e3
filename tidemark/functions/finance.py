"""Books: report trees, balances, deal stages."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def profit_rows(report: dict) -> list[tuple[str, float, float, float, bool]]:
    """(month, income, expenses, net, complete) of a profit-and-loss report.

    Groups are found at any depth, the first of a name counts; a total column is left out; an
    empty cell is 0; a missing net income is income less cost of goods and expenses, with other
    income and expenses.
    """
    columns = report.get("Columns", [])
    months = []
    for k, c in enumerate(columns):
        meta = {m["Name"]: m["Value"] for m in c.get("MetaData", [])}
        if "StartDate" in meta:
            whole = meta.get("EndDate", "") >= (pd.Timestamp(meta["StartDate"]) + pd.offsets.MonthEnd(0)).strftime("%Y-%m-%d")
            months.append((k, meta["StartDate"][:7], whole))

    def find(rows: list[dict], group: str):
        for r in rows:
            if r.get("group") == group and "Summary" in r:
                return r["Summary"]
            if (deeper := find(r.get("Rows", []), group)) is not None:
                return deeper
        return None

    def cell(summary, k: int) -> float | None:
        if summary is None or k >= len(summary):
            return None
        try:
            return float(str(summary[k]).replace(",", "") or 0)
        except ValueError:
            return 0.0

    income, expenses, net, cogs, more, less = (find(report.get("Rows", []), g) for g in ("Income", "Expenses", "NetIncome", "COGS", "OtherIncome", "OtherExpenses"))
    out = []
    for k, month, whole in months:
        i, e, c, m, x = (cell(group, k) or 0.0 for group in (income, expenses, cogs, more, less))
        n = cell(net, k)
        out.append((month, i, e, i - c - e + m - x if n is None else n, whole))
    return out


def profit_and_loss(reports: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """Month rows of report trees given as JSON, a report a row."""

    def work(batches):
        for batch in batches:
            rows = [(r[0], *m) for r in batch.itertuples(index=False) if r[1] for m in profit_rows(json.loads(r[1]))]
            yield pd.DataFrame(rows, columns=["id", "month", "income", "expenses", "net", "complete"])

    return reports.select(F.col(id_col).cast("string"), json_col).mapInPandas(work, "id string, month string, income double, expenses double, net double, complete boolean")


def balances(accounts: DataFrame) -> DataFrame:
    """(usd, others): the sum of dollar balances in minor units, and the other currencies, sorted. No currency means dollars."""
    currency = F.upper(F.coalesce(F.col("currency"), F.lit("USD")))
    usd = F.coalesce(F.sum(F.when(currency == "USD", F.col("amount"))), F.lit(0)) / 100
    return accounts.where("amount IS NOT NULL").agg(usd.alias("usd"), F.array_sort(F.collect_set(F.when(currency != "USD", currency))).alias("others"))


def stage_outcome(closed: Column, probability: Column, label: Column) -> Column:
    """WON, LOST or OPEN of a stage: closed ones by probability 1 or 0, then by label, then from a half up."""
    text = F.lower(label)
    return (
        F.when(~closed, "OPEN").when(probability >= 1, "WON").when(probability <= 0, "LOST")
        .when(text.contains("won"), "WON").when(text.contains("lost"), "LOST")
        .when(probability >= 0.5, "WON").otherwise("LOST")
    )


def deal_signals(deals: DataFrame, before: DataFrame) -> DataFrame:
    """(deal_id, signal) of deals (deal_id, outcome, place) against their previous state; none on a first sync.

    created, won, lost, advanced or moved_back; nothing between closed stages of one outcome.
    """
    old = before.select("deal_id", F.col("outcome").alias("was"), F.col("place").alias("was_place"))
    first_sync = before.isEmpty()
    both = deals.join(old, "deal_id", "left")
    signal = (
        F.when(F.col("was").isNull(), "created").when((F.col("outcome") != F.col("was")) & (F.col("outcome") == "WON"), "won")
        .when((F.col("outcome") != F.col("was")) & (F.col("outcome") == "LOST"), "lost")
        .when((F.col("outcome") == F.col("was")) & (F.col("outcome") != "OPEN"), None)
        .when(F.col("place") > F.col("was_place"), "advanced").when(F.col("place") < F.col("was_place"), "moved_back")
    )
    found = both.select("deal_id", signal.alias("signal")).where("signal IS NOT NULL")
    return found.where(F.lit(not first_sync))
