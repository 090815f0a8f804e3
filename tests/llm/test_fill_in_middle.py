import hashlib
import re

import pytest

from tests.llm.conftest import odd_rows
from tidemark.llm.fill_in_middle import UNITS, Fim, fill_in_middle, rebuild, restore


def slow(text: str, doc_id, rate: int = 100) -> tuple:
    """The contract, step by step, with lines found by splitting."""
    digest = hashlib.sha256(f"7:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))
    lines = [x + "\n" for x in text.split("\n")]
    lines[-1] = lines[-1][:-1]
    lines = [x for x in lines if x]
    n = len(lines)
    if text == "" or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    if h4 % 100 < 50:
        return n, "spm", len(p), len(m), "<S>" + s + "<P>" + p + "<M>" + m
    return n, "psm", len(p), len(m), "<P>" + p + "<S>" + s + "<M>" + m


TEXTS = ["", "\n", "\n\n\n", "a", "a\n", "a\nb", "\na\n\nb", "x<P>y\nz", "a <S b\n<M c>\n<", "ä😀\r\nß c\n日本\n", "<\n" * 5, "\x00\n\x00", "line\n" * 5000 + "x" * 300_000, None]


def test_against_the_contract(spark, odd):
    rows = [(k * 37, t) for k, t in enumerate(TEXTS)] + [(-k, "one\ntwo\nthree\nfour\n") for k in range(40)] + [(7, "same\nrow"), (7, "same\nrow"), (None, "no\nid")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = fill_in_middle(docs)
    assert got.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "output_sha256"]
    made = [tuple(r) for r in got.collect()]
    want = [(k, *slow(t or "", k)) for k, t in rows]
    assert sorted(map(repr, want)) == sorted(repr(r[:-1]) for r in made)
    assert all(hashlib.sha256(r[5].encode()).hexdigest() == r[6] for r in made)
    assert {"plain", "psm", "spm"} == {r[2] for r in made}
    back = restore(got).collect()
    assert sorted(map(repr, ((k, t or "") for k, t in rows))) == sorted(repr((r.doc_id, r.restored)) for r in back)
    assert all(hashlib.sha256(r.restored.encode()).hexdigest() == r.restored_sha256 for r in back)
    assert sorted(map(repr, ((k, *slow(t or "", k)) for k, t in odd_rows()))) == sorted(repr(tuple(r)[:-1]) for r in fill_in_middle(odd).collect())


def test_rates_and_other_units(spark):
    docs = spark.range(400).selectExpr("id AS doc_id", "concat('word ', id, '  and more') AS text")
    some = fill_in_middle(docs, Fim(rate=30)).collect()
    assert [tuple(r)[1:-1] for r in some] == [slow(f"word {r.doc_id}  and more", r.doc_id, 30) for r in some]
    assert 60 < sum(r.form != "plain" for r in some) < 180
    for unit, n in (("word", 4), ("char", 17)):
        how = Fim(unit=UNITS[unit], spm=100, prefix="[p]", suffix="[s]", middle="[m]")
        rows = restore(fill_in_middle(docs.where("doc_id BETWEEN 10 AND 99"), how), how).collect()
        assert {r.n for r in rows} == {n} and {r.form for r in rows} == {"spm"}
        assert all(r.restored == f"word {r.doc_id}  and more" and r.output.startswith("[s]") for r in rows)


def test_nothing(empty):
    assert restore(fill_in_middle(empty)).count() == 0


@pytest.mark.parametrize("text", ["<", "a<P", "<S<M", "M><P", "<P >"])
def test_parts_that_look_like_marks(text):
    how, pattern = Fim(unit=UNITS["char"]), re.compile(UNITS["char"])
    from tidemark.llm.fill_in_middle import transform

    for doc_id in map(str, range(50)):
        _, form, _, _, output = transform(text, doc_id, how, pattern)
        assert rebuild(output, form, how) == text
