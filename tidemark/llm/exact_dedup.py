"""Exact deduplication by a tree merge of sorted digest runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ascii_lower, cut, free_name, shuffle_partitions

#: Runs that one merge takes in.
FAN_IN = 8
KEY = ["digest", "octets", "proof"]


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest, octets, proof) of each row.

    digest is SHA-256 of the text after lower-casing A-Z only (null counts as empty); length
    and a 64-bit hash by another function verify it: rows whose digests agree but whose proofs
    don't are never merged.
    """
    text = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    return docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).select(
        "doc_id",
        F.unhex(F.sha2("text", 256)).alias("digest"),
        F.octet_length("text").alias("octets"),
        F.xxhash64("text").alias("proof"),
    )


def merge_runs(rows: DataFrame, keep: str = "smallest", rounds: int | None = None, fan_in: int = FAN_IN) -> DataFrame:
    """One row per distinct text: KEY, keep_id and group_size.

    There are fan_in ** rounds places, by default the first such number that shuffle partitions
    don't exceed. At the start each task sorts its own rows by digest and merges equal ones: its
    runs. In every round, fan_in neighbouring runs become one: they hand the pieces of their
    sorted rows to the same places, each of which has a range of digests, sorts what it got and
    merges it in one stream, keeping for each digest the best identifier and the number of rows.
    So a run is spread over fan_in times as many places as before, and after the last round one
    run is left, sorted over all places. A digest, however frequent, reaches a place at most once
    from each task in the first round and fan_in times in any other. Rows merge only if length
    and second hash agree as well.
    """
    best = F.min if keep == "smallest" else F.max
    parts = shuffle_partitions(rows.sparkSession)
    if rounds is None:
        rounds = next(k for k in range(1, 64) if fan_in**k >= parts)
    places = fan_in**rounds
    range_of = F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long")
    # The aggregate's value is a struct, which Spark merges from sorted rows and in their order.
    state = rows.select(*KEY, F.when(F.col("doc_id").isNotNull(), F.struct("doc_id")).alias("best"), F.lit(1).cast("long").alias("group_size"), F.pmod(F.spark_partition_id(), F.lit(places)).alias("place"))
    for turn in range(1, rounds + 1):
        ranges = fan_in**turn
        place = F.floor(F.col("place") / ranges) * ranges + F.shiftright(range_of * ranges, 32)
        state = state.withColumn("place", place.cast("int"))
        if turn > 1:
            state = state.repartitionById(places, F.col("place")).sortWithinPartitions("place", *KEY)
        state = state.groupBy("place", *KEY).agg(best("best").alias("best"), F.sum("group_size").alias("group_size"))
    return state.select(*KEY, F.col("best.doc_id").alias("keep_id"), "group_size")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z only. Null and empty texts are equal.
    A row without an id stays only if no row of its group has one. Rows that repeat an id and
    its text are the same document: each is returned, all with the same verdict. Other columns
    of docs are not read. An empty table gives an empty result.
    """
    rows = cut(digests(docs, id_col, text_col))
    groups = cut(merge_runs(rows, keep))  # so that the join below shuffles both sides, and AQE can split a hot digest
    return rows.join(groups, KEY).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame, keep: str = "smallest", text_col: str = "text", most: int = 500_000) -> DataFrame:
    """The rows of docs, as they are, that stay; of rows that repeat an id and its text, one.

    Verdicts are brought back by id and digest, so rows that share an id but not a text are told
    apart, and rows without an id as well. The rows to drop are counted: up to ``most`` (about
    100 MB at most) are broadcast, and texts aren't shuffled; beyond, both sides are.
    """
    verdicts = cut(exact_duplicates(docs, text_col=text_col, keep=keep).select("doc_id", "kept", F.unhex("text_sha256").alias("digest")))
    own = F.unhex(F.sha2(ascii_lower(F.coalesce(docs[text_col], F.lit(""))), 256))

    id_name, digest_name = free_name(docs, "listed_id"), free_name(docs, "listed_digest")

    def match(listed: DataFrame, how: str) -> DataFrame:
        listed = listed.select(F.col("doc_id").alias(id_name), F.col("digest").alias(digest_name))
        return docs.join(F.broadcast(listed) if listed.count() <= most else listed, docs["doc_id"].eqNullSafe(F.col(id_name)) & (own == F.col(digest_name)), how)

    repeated = cut(verdicts.where("kept").groupBy("doc_id", "digest").count().where("count > 1"))
    away = verdicts.where("NOT kept").select("doc_id", "digest").distinct()
    if repeated.isEmpty():
        return match(away, "left_anti")
    once = match(repeated, "left_semi").withColumn(digest_name, own).dropDuplicates(["doc_id", digest_name]).drop(digest_name)
    return match(away.union(repeated.select("doc_id", "digest")), "left_anti").unionByName(once)
