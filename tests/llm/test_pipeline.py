import subprocess
import sys
from collections import Counter, defaultdict
from pathlib import Path

from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from tests.llm.conftest import odd_rows
from tidemark.llm import quality, simhash
from tidemark.llm.queries import QUERIES

REPO = Path(__file__).resolve().parents[2]
SF = "/root/testdata/sf0.01"


def test_each_operator_has_one_query():
    for n in range(1, 11):
        assert sum(name.startswith(f"op{n}_") for name in QUERIES) == 1
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())


def test_stages_on_planted_documents(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(400)
    copies = docs.where("doc_id IN (5, 19, 20)").withColumn("doc_id", F.col("doc_id") + 200_000)
    nothing = docs.limit(1).withColumn("doc_id", F.lit(300_000).cast("long")).withColumn("text", F.lit("12345 !!"))
    rows = docs.unionByName(copies).unionByName(nothing).unionByName(nothing.withColumn("text", F.lit(None).cast("string")).withColumn("doc_id", F.lit(300_001).cast("long")))
    seen = [rows]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, seen[-1], SF)
        if name != "best-fit packing":
            assert out.columns == rows.columns
        out.write.parquet(str(tmp_path / str(k)))
        seen.append(spark.read.parquet(str(tmp_path / str(k))))
    ids = [{r["doc_id"] for r in x.select("doc_id").collect()} for x in seen[1:]]
    assert not ids[0] & {300_000, 300_001} and ids[0] >= {r["doc_id"] for r in docs.where("text RLIKE '[A-Za-z]'").collect()}
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    texts = [r["text"].translate(lower) for r in seen[3].select("text").collect()]
    assert len(texts) == len(set(texts)) and not ids[2] & {5, 19, 20}
    assert {k for k in (200_005, 200_019, 200_020) if k in ids[1]} <= ids[2]
    bits = [simhash.fingerprint(r["text"].encode()) for r in seen[4].collect()]
    assert all((a ^ b).bit_count() > 3 for k, a in enumerate(bits) for b in bits[:k])
    assert {r["doc_id"] for r in seen[5].select("doc_id").collect()} == ids[3]


def rows_of(df) -> Counter:
    return Counter((r["doc_id"], r["text"]) for r in df.collect())


def test_stages_of_an_empty_table_are_empty(spark, empty):
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, empty, SF)
        assert out.count() == 0 and (name == "best-fit packing" or out.columns == empty.columns), name


def test_language_stage_of_odd_rows(spark, odd):
    given, out = Counter(odd_rows()), corpus_pipeline.language_id(spark, odd, SF)
    kept = rows_of(out)
    assert out.columns == odd.columns and kept <= given
    assert not any(not any(map(str.isalpha, t or "")) for _, t in kept)
    assert kept >= Counter({x: n for x, n in given.items() if x[1] and len(x[1]) > 100 and "Alpha" in x[1]})  # long texts, repeats and copies in the words that were taught
    assert all(n == given[x] for x, n in kept.items())  # a row and its repeats share their verdict


def test_quality_stage_of_odd_rows(spark, odd):
    out = corpus_pipeline.quality_classifier(spark, odd, SF)
    learn_from = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2
    net = quality.train(*quality.labelled_sample(odd, spark.read.parquet(f"{SF}/labels.parquet"), learn_from))
    good = {t for _, t in odd_rows() if quality.probability(net, quality.features(net, (t or "").encode())) >= 0.7}
    assert out.columns == odd.columns and rows_of(out) == Counter(x for x in odd_rows() if x[1] in good)


def test_exact_stage_of_odd_rows(spark, odd):
    out = corpus_pipeline.exact_dedup(spark, odd, SF)
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    groups = defaultdict(list)
    for k, t in odd_rows():
        groups[(t or "").translate(lower)].append((k, t))
    largest = {t: max((k for k, _ in rows if k is not None), default=None) for t, rows in groups.items()}
    kept = rows_of(out)
    assert out.columns == odd.columns and sum(kept.values()) == len(groups) and kept <= Counter(odd_rows())
    assert {((t or "").translate(lower), k) for k, t in kept} == set(largest.items())


def test_near_stage_of_odd_rows(spark, odd):
    out = corpus_pipeline.near_dedup(spark, odd, SF)
    kept = rows_of(out)
    bits = [simhash.fingerprint((t or "").encode()) for k, t in kept if k is not None]
    ids = [k for k, _ in kept if k is not None]
    assert out.columns == odd.columns and kept <= Counter(odd_rows())
    assert all((a ^ b).bit_count() > 3 or ids[i] == ids[j] for i, a in enumerate(bits) for j, b in enumerate(bits[:i]))
    assert {k for k, _ in kept} >= {None, -5, 4, 5, 8, 10, 11, 12, 14, 15} and not {1, 2, 6} & {k for k, _ in kept}


def test_packing_stage_of_odd_rows(spark, odd):
    pieces = corpus_pipeline.packing(spark, odd, SF).collect()
    places = defaultdict(list)
    for r in pieces:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    assert Counter(r["doc_id"] for r in pieces if r["piece"] == 0) == Counter(k for k, _ in odd_rows())
    for own in places.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:])) and own[-1][0] + own[-1][1] <= 1024  # noqa: B905, RUF007


def test_run_goes_through_all_stages(spark):
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert rows.count() > 0 and {"doc_id", "piece", "sequence_id", "offset"} <= set(rows.columns)


def test_the_rest_works_without_this_subpackage(tmp_path):
    copy = tmp_path / "repo"
    subprocess.run(["cp", "-r", str(REPO), str(copy)], check=True)
    subprocess.run(["rm", "-rf", str(copy / "tidemark/llm"), str(copy / "tests/llm"), str(copy / "corpus_pipeline.py")], check=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 60 and 'pipeline' not in q and not any(n.startswith('op') for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True)
