"""Names of a lexicon found in texts: leftmost, longest, without overlap, names of any length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.operators.kept import counted


def lexicon(kinds: dict[str, tuple[DataFrame, str, str]], aliases: DataFrame | None = None, least: float = 0.6) -> DataFrame:
    """(kind, entity, name, how) of all entity tables: kinds names a frame, its id and its name column.

    aliases (kind, entity, alias, confidence) of ``least`` confidence or more are names as well. How
    is name or alias; a name that an entity has twice is there once, as its own before as an alias.
    Ids are texts, as kinds have ids of their own.
    """
    rows = None
    for kind, (frame, entity, name) in kinds.items():
        one = frame.select(F.lit(kind).alias("kind"), F.col(entity).cast("string").alias("entity"), F.col(name).alias("name"), F.lit("name").alias("how"))
        rows = one if rows is None else rows.unionByName(one)
    if aliases is not None:
        also = aliases.where(F.col("confidence") >= least).select("kind", F.col("entity").cast("string").alias("entity"), F.col("alias").alias("name"), F.lit("alias").alias("how"))
        rows = also if rows is None else rows.unionByName(also)
    best = rows.where(F.size(text.words(F.col("name"))) > 0).groupBy("kind", "entity", text.fold(F.col("name")).alias("fold")).agg(F.max(F.struct("how", "name")).alias("n"))
    return best.select("kind", "entity", F.col("n.name").alias("name"), F.col("n.how").alias("how"))


def spots(items: DataFrame, text_col: str, names: DataFrame, carry: list[str]) -> DataFrame:
    """(*carry, run, at, size): where the runs of words of names (run) stand in each item's text, in words from 0.

    Words are runs of letters and digits of the folded text. From left to right the longest name
    that begins at a word is taken, and the next may begin after it. A word that begins a name
    brings the lengths of such names, and the words there are compared with the names by
    equality; names and first words are broadcast if counting shows them to be few, else shuffled.
    No length is left out; a shuffled word carries as many words as the longest name has.
    """
    runs = counted(names.select("run", F.size(F.split("run", " ")).alias("size")).where("run <> ''").distinct())
    longest = runs.agg(F.max("size").alias("longest"))
    firsts = counted(runs.groupBy(F.substring_index("run", " ", 1).alias("word")).agg(F.collect_set("size").alias("sizes")))
    each = items.select(*carry, text.words(F.col(text_col)).alias("__words")).withColumn("__row", F.monotonically_increasing_id())
    each = each.crossJoin(F.broadcast(longest)).select(*carry, "__row", "__words", "longest", F.posexplode("__words").alias("at", "word"))
    begun = each.withColumn("__next", F.slice("__words", F.col("at") + 1, F.col("longest"))).drop("__words").join(firsts, "word")
    tried = begun.select(*carry, "__row", "at", "__next", F.explode("sizes").alias("size")).where(F.size("__next") >= F.col("size"))
    tried = tried.withColumn("run", F.array_join(F.slice("__next", F.lit(1), F.col("size")), " ")).drop("__next")
    hits = tried.join(runs, ["run", "size"], "left_semi").select(*carry, "__row", "at", "size", "run")
    # Only where hits of a text overlap is there a choice.
    ordered = hits.repartition("__row").sortWithinPartitions("__row", "at", F.desc("size"))

    def first_longest(batches):
        import pyarrow as pa

        row, free = None, 0
        for batch in batches:
            taken = []
            for k, at, size in zip(*(batch.column(c).to_pylist() for c in ("__row", "at", "size")), strict=True):
                if k != row:
                    row, free = k, 0
                taken.append(at >= free)
                if at >= free:
                    free = at + size
            yield batch.filter(pa.array(taken, pa.bool_()))

    return ordered.mapInArrow(first_longest, ordered.schema).select(*carry, "run", F.col("at"), "size")


def run_of(name: Column) -> Column:
    """A name as spots compares it."""
    return F.array_join(text.words(name), " ")


def mentions(items: DataFrame, id_col: str, text_col: str, lexicon: DataFrame) -> DataFrame:
    """(id, entity, n): how often the names of a lexicon (entity, name) occur in a text, the longest where names overlap (see spots).

    A name that several entities have is a mention of each.
    """
    names = lexicon.select("entity", run_of(F.col("name")).alias("run")).where("run <> ''").distinct()
    found = spots(items, text_col, names, [id_col]).groupBy(id_col, "run").agg(F.count("*").alias("n"))
    return found.join(names, "run").groupBy(id_col, "entity").agg(F.sum("n").alias("n"))
