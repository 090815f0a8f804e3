import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tests.llm.conftest import odd_rows
from tidemark.llm import divergence
from tidemark.llm.divergence import shares, source_divergence


def slow(rows: list[tuple], least: int, most: int) -> list[tuple]:
    """The contract with Python's own integers, over (text, lang, source)."""
    counts, having, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        groups[lang].add(source)
        counts[lang, source].update(terms)
        having[lang].update(set(terms))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, d in having[lang].items() if d >= least]
        v = len(kept)

        def rates(count):
            n = sum(count[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (count[t] + 5) // (n + 5 * v) for t in kept}

        q = rates(sum((counts[lang, s] for s in sources), Counter()))
        p = {s: rates(counts[lang, s]) for s in sources}
        for s in sources:
            pairs = [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in sources if o != s]
            terms = [(t, p[s][t] - q[t]) for t in kept if counts[lang, s][t] > 0 and p[s][t] > q[t]]
            for part, items, top in (("pair", pairs, None), ("term", terms, most)):
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:top]
                out += [(lang, s, part, item, value, k) for k, (item, value) in enumerate(ranked, 1)]
    return sorted(out)


def corpus(spark, rows):
    return spark.createDataFrame(rows, "text string, lang string, source string").repartition(4)


@pytest.mark.parametrize("sizes", [{}, {"chunk": 3, "slab": 2, "block": 2}, {"chunk": 1, "slab": 1, "block": 1}])
def test_against_the_contract(spark, sizes):
    rng = random.Random(4)
    words = [f"w{'abcdefghij'[k % 10]}{'xyzuv'[k // 10]}" for k in range(40)] + ["Été", "été", "日本", "ÅB", "don't", "a1b"]
    rows = []
    for k in range(500):
        lang = rng.choice(["en", "en", "fr", None, "zz"])
        source = "hot" if rng.random() < 0.4 else rng.choice(["s1", "s2", "s3", "S1", "é", None, "a", "b"])
        text = " ".join(rng.choices(words[: 20 if source == "hot" else 46], k=rng.randint(0, 30)))
        rows.append((None if lang == "zz" or rng.random() < 0.05 else text, lang, source))
    rows += [("only once", "de", "s1"), ("", "de", "s2"), (None, "de", None)] + [("same row again", "en", "copy")] * 40
    got = [tuple(r) for r in source_divergence(corpus(spark, rows), least_docs=30, most_terms=7, **sizes).collect()]
    want = slow(rows, 30, 7)
    assert sorted(got) == want
    assert {"pair", "term"} == {r[2] for r in got} and any(r[4] == 0 for r in got) and len({r[0] for r in got}) == 5


def test_odd_rows_and_a_text_of_many_pieces(spark, odd, monkeypatch):
    rows = [(t, "en" if t else None, "src0") for _, t in odd_rows()]
    assert sorted(tuple(r) for r in source_divergence(odd, least_docs=1).collect()) == slow(rows, 1, 50)
    rows = [("Alpha beta\n" * 50, "en", "a"), ("beta gamma " * 50, "en", "b"), ("x" * 900 + " beta", "en", "b")]
    monkeypatch.setattr(divergence, "STEP", 64)
    monkeypatch.setattr(divergence, "HELD", 2)
    from tidemark.llm.divergence import term_counts

    assert {(r.lang, r.source, r.term): (r.n, r.docs) for r in term_counts(corpus(spark, rows).coalesce(1), "text", "lang", "source").collect()} == {
        ("en", "a", None): (0, 1), ("en", "b", None): (0, 2), ("en", "a", "alpha"): (50, 1), ("en", "a", "beta"): (50, 1), ("en", "b", "beta"): (51, 2), ("en", "b", "gamma"): (50, 1), ("en", "b", "x" * 900): (1, 1),
    }


def test_nothing(empty):
    assert source_divergence(empty).collect() == []


def test_shares_are_exact_for_large_counts():
    n = np.array([0, 1, 7, 123_456_789_012, 8_999_999_999_999_990], np.int64)
    total = np.full(5, 9_000_000_000_000_000, np.int64)
    assert shares(n, total, 1000).tolist() == [1 + 1_000_000_000 * (int(x) + 5) // (9_000_000_000_000_000 + 5000) for x in n]
