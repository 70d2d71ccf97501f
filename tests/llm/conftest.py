"""Odd documents that every corpus operator must take."""

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h string, n int, id int, doc string, key long, norm string, pos int, block int, item string, y int, fold int, tokens int, sha string, start int"


def rows_of(texts):
    """Rows with clashing extra columns; ids may be given."""
    out = []
    for k, t in enumerate(texts):
        i, t = t if isinstance(t, tuple) else (k, t)
        out.append((i, t, None if k % 3 == 0 else "en", None if k % 4 == 0 else f"src{k % 2}", None, "x", 1, 2, "d", 5, "n", 6, 7, "i", 1, 2, 9, "s", 0))
    return out


@pytest.fixture(scope="session")
def make(spark):
    return lambda texts: spark.createDataFrame(rows_of(texts), SCHEMA)


@pytest.fixture(scope="session")
def odd_texts():
    long = " ".join(f"w{k % 700}x{k % 37}" for k in range(30_000))
    return [None, "", " ", "\t\n", "one", "two words", "The THE the", "ü ß Ω é", "a" * 50_000, long, long, (3, "two words"), (3, "two words"), (None, "no id here"), (None, None), "12 kg of 5 apples, John", "x | y | z\n" * 40, "!!! ??? ...", "\u0000 nul", "🙂 🙃 emoji text"]


@pytest.fixture(scope="session")
def odd(make, odd_texts):
    return make(odd_texts)


@pytest.fixture(scope="session")
def empty(make, spark):
    return make(["x"]).limit(0)
