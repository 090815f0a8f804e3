"""Fill-in-the-middle: a text cut at two units into prefix, middle and suffix, and put in another order."""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import limit_batches

#: What a text is cut into. Matches follow each other from left to right and cover the text.
UNITS = {"line": r"[^\n]*\n|[^\n]+", "word": r"\S+\s*|\s+", "char": r"(?s:.)"}


@dataclass(frozen=True)
class Fim:
    """How texts are transformed: the unit's pattern, the seed, the shares in percent, the three marks.

    ``rate`` of the texts are transformed, and of these ``spm`` put the suffix first. Marks must
    not be part of each other, and an end of one must not be a beginning of another; then the
    text can be rebuilt from the output.
    """

    unit: str = UNITS["line"]
    seed: int = 7
    rate: int = 100
    spm: int = 50
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"


def draws(seed: int, doc_id: str) -> list[int]:
    """Four numbers of 32 bits that only the seed and the id decide."""
    digest = sha256(f"{seed}:{doc_id}".encode()).hexdigest()
    return [int(digest[k : k + 8], 16) for k in range(0, 32, 8)]


def unit_ends(text: str, pattern) -> array:
    """Where each unit ends, in code points: four bytes a unit (eight in texts of over 2**32)."""
    return array("I" if len(text) < 1 << 32 else "Q", (m.end() for m in pattern.finditer(text)))


def transform(text: str, doc_id: str, how: Fim, pattern) -> tuple:
    """(n, form, prefix_chars, middle_chars, output) of one text."""
    ends = unit_ends(text, pattern)
    n = len(ends)
    h1, h2, h3, h4 = draws(how.seed, doc_id)
    if not text or any(mark in text for mark in (how.prefix, how.suffix, how.middle)) or h3 % 100 >= how.rate:
        return n, "plain", None, None, text
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = (ends[k - 1] if k else 0 for k in (first, second))
    if h4 % 100 < how.spm:
        return n, "spm", a, b - a, f"{how.suffix}{text[b:]}{how.prefix}{text[:a]}{how.middle}{text[a:b]}"
    return n, "psm", a, b - a, f"{how.prefix}{text[:a]}{how.suffix}{text[b:]}{how.middle}{text[a:b]}"


def rebuild(output: str, form: str, how: Fim) -> str:
    """The text that transform was given, from what it made of it."""
    if form == "plain":
        return output
    head, _, middle = output.partition(how.middle)
    if form == "psm":
        before, _, after = head.removeprefix(how.prefix).partition(how.suffix)
    else:
        after, _, before = head.removeprefix(how.suffix).partition(how.prefix)
    return before + middle + after


def hex_digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def fill_in_middle(docs: DataFrame, how: Fim | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n (units), form, prefix_chars, middle_chars, output, output_sha256.

    Form is ``plain`` (output is the text; no lengths) for empty texts, texts with a mark, and
    those beyond the rate; else ``psm`` or ``spm``, prefix or suffix first. A null text is
    empty, a null id draws as ``null``. The draws depend on the id alone, so rows that share an
    id draw alike, in any order of rows and number of partitions. Texts of any length are cut
    whole; a batch of texts is bounded by bytes. Other columns are not read, so their names may
    clash; an empty table gives an empty result.
    """
    how = how or Fim()
    limit_batches(docs.sparkSession)

    @F.pandas_udf("n long, form string, prefix_chars long, middle_chars long, output string, output_sha256 string")
    def cut_and_order(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        import regex

        pattern = regex.compile(how.unit)
        for ids, texts in batches:
            made = [transform(text, doc_id, how, pattern) for doc_id, text in zip(ids, texts, strict=True)]
            n, form, prefix, middle, output = zip(*made, strict=True) if made else ((),) * 5
            yield pd.DataFrame(
                {
                    "n": pd.Series(n, dtype="int64"), "form": pd.Series(form, dtype=object), "prefix_chars": pd.Series(prefix, dtype="Int64"), "middle_chars": pd.Series(middle, dtype="Int64"),
                    "output": pd.Series(output, dtype=object), "output_sha256": pd.Series([hex_digest(x) for x in output], dtype=object),
                }
            )

    key = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    made = docs.select(F.col(id_col).alias("doc_id"), cut_and_order(key, F.coalesce(F.col(text_col), F.lit(""))).alias("made"))
    return made.select("doc_id", "made.*")


def restore(rows: DataFrame, how: Fim | None = None) -> DataFrame:
    """rows of fill_in_middle with the texts rebuilt from output and form: restored, restored_sha256."""
    how = how or Fim()
    limit_batches(rows.sparkSession)

    @F.pandas_udf("restored string, restored_sha256 string")
    def put_back(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for outputs, forms in batches:
            texts = [rebuild(output, form, how) for output, form in zip(outputs, forms, strict=True)]
            yield pd.DataFrame({"restored": pd.Series(texts, dtype=object), "restored_sha256": pd.Series([hex_digest(x) for x in texts], dtype=object)})

    return rows.withColumn("back", put_back("output", "form")).select(*rows.columns, "back.*")
