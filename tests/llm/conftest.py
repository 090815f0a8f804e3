import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, bucket string, row string, word string, component_id string, __key string, digest string"
WORDS = ["Alpha", "beta", "gamma", "delta", "epsilon", "zeta", "Éta", "théta", "iota", "kappa"]


def odd_rows() -> list[tuple]:
    """(doc_id, text): nulls, empty and blank texts, no letters, copies, case copies, repeats, a long text and a null id."""
    rng = random.Random(9)
    say = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    base = say(40)
    return [
        (0, None), (1, ""), (2, " \n\t "), (3, "123 456 !!!"), (4, base), (5, base.upper()), (6, base), (7, base + " Omega"), (8, "Alpha"), (9, "alpha beta"),
        (10, say(30_000)), (11, "x" * 5000), (12, "日本語 のテキスト ß Σ"), (13, "<|endoftext|> Alpha"), (14, say(60)), (14, "another text with the same id"), (15, "repeat me please"), (15, "repeat me please"),
        (None, "no id here"), (None, None), (2**62, say(25)), (-5, say(25)),
    ]


@pytest.fixture(scope="session")
def odd(spark):
    """Odd rows with columns whose names the operators use themselves."""
    rows = [(k, t, "en" if t else None, "src0", len(t or ""), "b", "r", "w", "c", "k", "d") for k, t in odd_rows()]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
