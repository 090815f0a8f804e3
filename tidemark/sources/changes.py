"""Change feeds: pages of changes that connectors drop as files, read as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAGE = "id string, kind string, payload string, deleted boolean"


def change_feed(spark: SparkSession, folder: str, pages_per_batch: int = 100) -> DataFrame:
    """A stream of (id, kind, payload, deleted, page) over a folder of JSON-lines pages.

    Which pages were read is kept by the stream's checkpoint, so a restart goes on where it ended
    and no page is read twice. Pages are read by the executors, side by side. page is the file's
    name, in whose order changes of one item follow each other.
    """
    rows = spark.readStream.schema(PAGE).option("maxFilesPerTrigger", pages_per_batch).json(folder)
    return rows.select("id", "kind", "payload", F.coalesce("deleted", F.lit(False)).alias("deleted"), F.element_at(F.split(F.input_file_name(), "/"), -1).alias("page"))


def latest(changes: DataFrame) -> DataFrame:
    """Each item's last change, by page; of several on one page, a deletion counts, then the greatest payload."""
    last = changes.groupBy("id").agg(F.max(F.struct("page", "deleted", "kind", "payload")).alias("last"))
    return last.select("id", "last.kind", "last.payload", "last.deleted", "last.page")
