"""Results that are kept between steps."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """A new folder's name in spark.checkpoint.dir, which all executors see; only a local session without that setting (tests) gets a temporary one."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if shared is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="tidemark-kept-")
    return f"{shared}/tidemark-{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """df, written to the folder in spark.checkpoint.dir and read again, so that later reads cost no more and survive lost executors."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def counted(df: DataFrame, most: int = 100_000) -> DataFrame:
    """df, kept and counted: up to ``most`` rows are broadcast in joins, more are shuffled."""
    df = kept(df)
    return F.broadcast(df) if df.count() <= most else df
