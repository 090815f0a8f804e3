"""The registered queries of the operators, over the driver tables, and their SQL."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import lm_score, quality
from tidemark.llm.bpe import encoding_digests
from tidemark.llm.collision import near_vectors
from tidemark.llm.common import fold_of, table
from tidemark.llm.divergence import source_divergence
from tidemark.llm.exact_dedup import exact_duplicates
from tidemark.llm.fill_in_middle import fill_in_middle, restore
from tidemark.llm.langid import identify, sample_by_language
from tidemark.llm.langid import train as train_languages
from tidemark.llm.order_minhash import compare_with_edits
from tidemark.llm.packing import pack_documents
from tidemark.llm.sharding import assign_shards, even_topology
from tidemark.llm.simhash import near_duplicates
from tidemark.llm.url_filter import Rule, judge_urls, read_rules

QUERIES: dict = {}
ORACLES: dict = {}


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def query(name: str, sql: str | None = None):
    def register(build):
        QUERIES[name] = build
        if sql:
            ORACLES[name] = sql
        return build

    return register


@query(
    "op8_exact_dedup",
    """
    WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS h FROM documents)
    SELECT doc_id, max(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
           doc_id = max(doc_id) OVER (PARTITION BY h) AS kept, h AS text_sha256
    FROM d
    """,
)
def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the row that stays of its exact copies, the one with the largest doc_id."""
    return exact_duplicates(table(spark, sf_dir, "documents"), keep="largest")


def shards_sql() -> str:
    """DuckDB SQL for op5: crc32 from its polynomial, then the draws of two regions (three when grown), racks and shards."""

    def draw(path: str, weight: int) -> str:
        return f"-ln((('0x' || substr(md5(k || '|{path}'), 1, 13))::BIGINT + 0.5) / 4503599627370496) / {weight}"

    def lower(region: int, rack: int) -> str:
        a, b = 4 * region + 2 * rack, 4 * region + 2 * rack + 1
        return f"CASE WHEN {draw(f'{region}/{rack}/{a}', 1)} <= {draw(f'{region}/{rack}/{b}', 1)} THEN {a} ELSE {b} END"

    def region(r: int) -> str:
        return f"CASE WHEN {draw(f'{r}/0', 2)} <= {draw(f'{r}/1', 2)} THEN {lower(r, 0)} ELSE {lower(r, 1)} END"

    old = f"CASE WHEN {draw('0', 4)} <= {draw('1', 4)} THEN {region(0)} ELSE {region(1)} END"
    return f"""
    WITH RECURSIVE steps AS (SELECT i AS b, i AS c, 0 AS n FROM range(256) t(i) UNION ALL SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n + 1 FROM steps WHERE n < 8),
    crc AS (SELECT list(c ORDER BY b) AS t FROM steps WHERE n = 8),
    d AS (SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), 'null') AS k, encode(coalesce(text, '')) AS bytes FROM documents),
    e AS (SELECT doc_id, k, octet_length(bytes) + 1 AS size, list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(bytes), '..'), lambda x: ('0x' || x)::BIGINT)) AS b FROM d),
    f AS (SELECT doc_id, k, size, xor(list_reduce(b, lambda c, x: xor(c >> 8, list_extract(crc.t, (xor(c, x) & 255) + 1))), 4294967295) AS text_crc32,
                 {old} AS shard, CASE WHEN {draw("2", 1)} < least({draw("0", 4)}, {draw("1", 4)}) THEN 8 ELSE {old} END AS grown_shard FROM e, crc)
    SELECT doc_id, CAST(size AS BIGINT) AS size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY md5(k), doc_id, text_crc32) - 1 AS slot, grown_shard FROM f
    """


@query("op5_hash_tree_shards", shards_sql())
def op5_hash_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents dealt over shards 0 to 7, two to a rack, two racks to a region, under the law ``key``."""
    return assign_shards(table(spark, sf_dir, "documents"), even_topology(8))


#: The contract's rules (host and path), then what the method adds: the list of rules beside this module.
URL_RULES = [
    Rule("net/", "||net/", "block", 1),
    Rule("example.net/en/", "||example.net/en/", "allow", 1),
    Rule("example.com/de/", "||example.com/de/", "block", 1),
    Rule("org/fr/", "||org/fr/", "allow", 1),
    *read_rules((Path(__file__).parent / "url_rules.txt").read_text().splitlines()),
]


def listed_sql(host_path: str) -> str:
    """DuckDB SQL: the verdict of the listed rules, tried one by one. The longest that fits wins, block before allow."""
    ranked = sorted((r for r in URL_RULES if r.tier == 0), key=lambda r: (-len(r.pattern.removeprefix("||")), r.verdict != "block"))
    quote = lambda text: "'" + text.replace("'", "''") + "'"
    return "CASE " + " ".join(f"WHEN regexp_matches({host_path}, {quote(r.regex())}) THEN '{r.verdict}'" for r in ranked) + " ELSE 'allow' END"


@query(
    "op10_url_filter",
    rf"""
    WITH r AS (SELECT page_id, CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
    p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
    q AS (SELECT *, CASE WHEN ('.' || host) LIKE '%.example.net' AND path LIKE '/en/%' THEN 'example.net/en/'
                         WHEN ('.' || host) LIKE '%.example.com' AND path LIKE '/de/%' THEN 'example.com/de/'
                         WHEN ('.' || host) LIKE '%.org' AND path LIKE '/fr/%' THEN 'org/fr/'
                         WHEN ('.' || host) LIKE '%.net' AND path LIKE '/%' THEN 'net/' END AS rule FROM p)
    SELECT page_id, host, path, rule,
           CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
                ELSE {listed_sql("host || path")} END AS verdict
    FROM q
    """,
)
def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's host and path, the contract's rule that fits it, and the verdict."""
    judged = judge_urls(table(spark, sf_dir, "pages"), URL_RULES)
    return judged.select("page_id", "host", "path", F.when(F.col("tier") == 1, F.col("fitted")).alias("rule"), "verdict")


@query("op7_simhash_near_dedup")
def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's SimHash and the smallest document that it reaches by links of 3 bits or fewer."""
    rows = near_duplicates(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lpad(F.lower(F.hex("bits")), 16, "0").alias("fingerprint"), "component_id")


@query("op3_ppm_language_id")
def op3_ppm_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language by PPM trees learned from the documents outside the held-out fifth."""
    docs = table(spark, sf_dir, "documents")
    model = train_languages(sample_by_language(docs, fold_of(F.col("doc_id"), 5) != 0))
    return identify(docs, model).select("doc_id", (fold_of(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score")


@query("op9_byte_cnn_quality")
def op9_byte_cnn_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's chance of quality label 1, by a network that learned outside the held-out quarter."""
    docs = table(spark, sf_dir, "documents")
    net = quality.train(*quality.labelled_sample(docs, table(spark, sf_dir, "labels"), fold_of(F.col("doc_id"), 4) != 2))
    scored = quality.score(docs, net)
    return scored.select("doc_id", (fold_of(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query("op6_bpe_round_trip")
def op6_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids under the word-end BPE and what they decode to, as digests."""
    return encoding_digests(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


@query("op1_order_minhash")
def op1_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order MinHash of every document and of its edited text, with their likeness."""
    return compare_with_edits(table(spark, sf_dir, "documents"))


@query("op2_sum_of_squares_packing")
def op2_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces of byte-level BPE ids, packed into sequences of 1024 tokens."""
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), 1024, end=2)


@query("op4_gru_scores")
def op4_gru_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's log10 likelihood under unigram counts and under the recurrent net, learned outside fold 1 of 5."""
    held_out = fold_of(F.col("doc_id"), 5) == 1
    scored = lm_score.score(table(spark, sf_dir, "documents"), ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query("op11_fill_in_middle")
def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cut at two line ends and put in another order, as digests of the output and of the text rebuilt from it."""
    rows = restore(fill_in_middle(table(spark, sf_dir, "documents")))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


@query(
    "op12_source_divergence",
    r"""
    WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                      regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
    t AS (SELECT row, lang, source, unnest(terms) AS term FROM d),
    c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT row) AS docs FROM t GROUP BY ALL),
    v AS (SELECT lang, term, sum(n) AS all_n FROM c GROUP BY ALL HAVING sum(docs) >= 30),
    l AS (SELECT lang, count(*) AS terms, sum(all_n) AS total FROM v GROUP BY lang),
    g AS (SELECT DISTINCT lang, source FROM d),
    gv AS (SELECT g.lang, g.source, v.term, v.all_n, coalesce(c.n, 0) AS n FROM g JOIN v ON v.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = v.term),
    p AS (SELECT gv.lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER (PARTITION BY gv.lang, source) + 5 * l.terms) AS p,
                 1 + (1000000000::HUGEINT * (all_n + 5)) // (l.total + 5 * l.terms) AS q FROM gv JOIN l ON l.lang = gv.lang),
    pairs AS (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
    parts AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
              FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
              UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM parts)
    SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 50
    """,
)
def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every group of language and source: how far it is from the others in its words, and the words that mark it."""
    return source_divergence(table(spark, sf_dir, "documents"))


@query("op13_collision_near_vectors")
def op13_collision_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector with the number of vectors of its label at cosine 0.93 or more, and the smallest that links reach."""
    return near_vectors(table(spark, sf_dir, "embeddings"))
