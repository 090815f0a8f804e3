"""Named queries over the driver tables and the SQL each is compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    """Registers a query and, where SQL expresses it, its oracle."""

    def register(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = build
        if sql:
            ORACLES[name] = sql
        return build

    return register


@query(
    "q00_pipeline_by_segment",
    """
    SELECT c.c_mktsegment AS segment, count(*) FILTER (o.o_orderstatus = 'O') AS open_deals,
           round(coalesce(sum(o.o_totalprice) FILTER (o.o_orderstatus = 'O'), 0), 2) AS open_value,
           round(sum(o.o_totalprice * CASE o.o_orderstatus WHEN 'O' THEN 0.5 WHEN 'P' THEN 0.25 ELSE 1.0 END), 4) AS weighted_value,
           max(o.o_orderdate) AS last_activity
    FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY 1
    """,
)
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open and probability-weighted order value and last activity by customer segment."""
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    is_open = F.col("o_orderstatus") == "O"
    weight = F.when(is_open, 0.5).when(F.col("o_orderstatus") == "P", 0.25).otherwise(1.0)
    per_customer = (
        table(spark, sf_dir, "orders")
        .groupBy("o_custkey")
        .agg(
            F.count_if(is_open).alias("open_deals"),
            F.sum(F.when(is_open, F.col("o_totalprice"))).alias("open_value"),
            F.sum(F.col("o_totalprice") * weight).alias("weighted_value"),
            F.max("o_orderdate").alias("last_activity"),
        )
    )
    return (
        customer.join(per_customer, customer.c_custkey == per_customer.o_custkey, "left")
        .groupBy(F.col("c_mktsegment").alias("segment"))
        .agg(
            F.coalesce(F.sum("open_deals"), F.lit(0)).alias("open_deals"),
            F.round(F.coalesce(F.sum("open_value"), F.lit(0.0)), 2).alias("open_value"),
            F.round(F.sum("weighted_value"), 4).alias("weighted_value"),
            F.max("last_activity").alias("last_activity"),
        )
    )


def load() -> None:
    """Imports the modules that register queries."""
    from tidemark.plans import analytics, assistant, boards, entities, hard_joins, history, ingestion, intake, messages, relational, reviews, scalars, searching  # noqa: F401


load()
