"""A chain of stages whose outputs are kept by item and content, so that a run works on what changed only."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.kept import kept


def exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def content_hash(items: DataFrame, item: str) -> DataFrame:
    """items with ``content``, a digest of all columns but the item's; null and empty differ."""
    rest = [c for c in items.columns if c != item]
    return items.withColumn("content", F.unhex(F.sha2(F.to_json(F.struct(*rest), {"ignoreNullFields": "false"}), 256)))


def run_stage(items: DataFrame, item: str, path: str, stage: str, work: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, int]:
    """(outputs of all items, how many of them were worked out now).

    items has a row an item. work takes rows (item, content, ...) and gives any number of rows with item
    and content. What an item of this content gave in an earlier run is read, not worked out again. A run
    has folders of its own for outputs and for the list of done items, which also holds those that gave none; last
    it names itself in the stage's list of runs. Folders without an entry there are never read, so a stage
    that fails leaves nothing, and a later run goes on after the last stage that ended. What was
    worked out now is current and needs no join; earlier outputs meet the items once.
    """
    spark = items.sparkSession
    marked = kept(content_hash(items, item))
    runs_at, done_at, out_at = (f"{path}/{stage}/{part}" for part in ("runs", "done", "out"))
    runs = [r["run"] for r in spark.read.parquet(runs_at).collect()] if exists(spark, runs_at) else []
    earlier = lambda at: spark.read.parquet(*(f"{at}/{run}" for run in runs))
    todo = kept(marked.join(earlier(done_at).select(item, "content"), [item, "content"], "left_anti")) if runs else marked
    batch = uuid.uuid4().hex
    work(todo).write.parquet(f"{out_at}/{batch}")
    todo.select(item, "content").write.parquet(f"{done_at}/{batch}")
    spark.range(1).select(F.lit(batch).alias("run")).coalesce(1).write.mode("append").parquet(runs_at)
    fresh = spark.read.parquet(f"{done_at}/{batch}").count()
    outputs = spark.read.parquet(f"{out_at}/{batch}")
    if runs:
        outputs = earlier(out_at).join(marked.select(item, "content"), [item, "content"], "left_semi").unionByName(outputs)
    return outputs.drop("content"), fresh


def run_stages(items: DataFrame, item: str, path: str, stages: dict[str, Callable[[DataFrame], DataFrame]]) -> tuple[DataFrame, dict[str, int]]:
    """Runs each stage on the outputs of the one before, and tells how many items each worked out now. Stages give a row an item."""
    worked = {}
    for name, work in stages.items():
        items, worked[name] = run_stage(items, item, path, name, work)
    return items, worked
