"""The corpus pipeline: stages over documents, each written as Parquet and read again by the next.

Language ID, quality classifier, exact dedup, SimHash near-dedup, best-fit packing. Every stage
takes all that its predecessor kept, and its decisions take effect. All but the last return the
columns of documents as they are, extra ones included. A null text counts as empty: it has no
language and goes in the first stage. An empty table passes through as an empty table.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import langid, quality
from tidemark.llm.common import fold_of, table
from tidemark.llm.exact_dedup import drop_exact_duplicates
from tidemark.llm.packing import pack_documents
from tidemark.llm.queries import tokenizer_path
from tidemark.llm.simhash import drop_near_duplicates


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which the PPM trees see no language: null texts, texts without a letter, and ties."""
    model = langid.train(langid.sample_by_language(docs, fold_of(F.col("doc_id"), 5) != 0))
    return langid.identified(docs, model)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the byte-level network, learned from the labels, gives less than 0.7."""
    learn_from = fold_of(F.col("doc_id"), 4) != 2
    net = quality.train(*quality.labelled_sample(docs, table(spark, sf_dir, "labels"), learn_from))
    return quality.of_quality(docs, net)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal after lower-casing A-Z, the row with the largest doc_id stays."""
    return drop_exact_duplicates(docs, keep="largest")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links connect, the one with the smallest doc_id stays. Links: SimHash fingerprints within
    3 bits, or five-word shingles of Jaccard likeness 0.8 or more."""
    return drop_near_duplicates(docs, similarity=0.8, width=5)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences of 1024 tokens."""
    return pack_documents(docs, tokenizer_path("byte_bpe_50k.json"), 1024, end=2)


STAGES = [
    ("language ID", language_id),
    ("quality classifier", quality_classifier),
    ("exact dedup", exact_dedup),
    ("SimHash near-dedup", near_dedup),
    ("best-fit packing", packing),
]

#: Trees, a network, 64-bit XXH64 and BPE are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to documents. Results go to the folder in spark.checkpoint.dir; the last one stays there."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if shared is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="tidemark-pipeline-")
    home = f"{shared}/corpus-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        path = f"{home}/{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before is not None:
            folder = spark._jvm.org.apache.hadoop.fs.Path(before)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
        before = path
    return docs
