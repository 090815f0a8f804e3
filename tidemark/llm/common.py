"""Small pieces that the operators share."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the checkpoint folder that the cluster names and reads it again.

    Later reads survive lost executors and don't repeat the work. The folder comes from
    spark.checkpoint.dir; only a local session without one (tests) gets a temporary folder.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        shared = sc.getConf().get("spark.checkpoint.dir")
        if shared is None:
            if not sc.master.startswith("local["):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            shared = tempfile.mkdtemp(prefix="tidemark-checkpoint-")
        sc.setCheckpointDir(shared)
    return df.checkpoint()


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; a null id is in fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")), F.lit(0)) % folds


def free_name(df: DataFrame, name: str) -> str:
    """name, with as many underscores before it as keep it apart from df's columns."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = f"_{name}"
    return name


def keep_ids(docs: DataFrame, ids: DataFrame, drop: bool, most: int = 1_000_000) -> DataFrame:
    """The rows of docs whose doc_id is in ids (or, with drop, is not). Null is in no list.

    ids is counted first: up to ``most`` distinct ids (tens of MB) are broadcast, so that whole
    texts aren't shuffled; beyond that both sides are shuffled by doc_id.
    """
    ids = cut(ids.select("doc_id").where("doc_id IS NOT NULL").distinct())
    small = ids.count() <= most
    kept = docs.join(F.broadcast(ids) if small else ids, "doc_id", "left_anti" if drop else "left_semi")
    return kept.select(*(f"`{c}`" for c in docs.columns))


def bounded(df: DataFrame, most: int = 100_000) -> DataFrame:
    """df, written once and counted: up to ``most`` rows are broadcast in joins, more are shuffled."""
    df = cut(df)
    return F.broadcast(df) if df.count() <= most else df


#: Bytes of text in an Arrow batch. A text longer than this makes a batch of its own.
BATCH_BYTES = 8 << 20


def limit_batches(spark: SparkSession) -> None:
    """Sets spark.sql.execution.arrow.maxBytesPerBatch where the session has no limit.

    So a task's memory depends on neither table nor partition size.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(re.sub(r"\D", "", spark.conf.get(name))) > 4 * BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def map_texts(docs: DataFrame, work, schema: str, *columns) -> DataFrame:
    """docs' columns through work, an iterator over Arrow batches of at most BATCH_BYTES."""
    limit_batches(docs.sparkSession)
    return docs.select(*columns).mapInArrow(work, schema)


def as_bytes(column) -> list[bytes]:
    """An Arrow string column as UTF-8 bytes, null as empty."""
    import pyarrow as pa

    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def to_batch(**columns):
    """A record batch of the given columns, in their order."""
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns.values()], names=list(columns))
