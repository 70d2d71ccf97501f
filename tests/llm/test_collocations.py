"""Collocations against counts by dictionary, on odd rows and with small shards."""

import re
from collections import Counter

import pytest

from outlyer.llm.collocations import collocations

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score", "cut"]


def brute(rows, least, top=2000):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, 6) for i in range(len(w) - k + 1))
    cands = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    dropped = {
        (lang, w[i : i + m]) for (lang, w), a in cands.items() for m in range(2, len(w)) for i in range(len(w) - m + 1) if 100 * a >= 100 * f[lang, w[i : i + m]]
    }
    out = []
    for (lang, w), a in cands.items():
        if (lang, w) not in dropped:
            score, k = min((1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w)))
            out.append((lang, -score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]], n[lang], k))
    out.sort()
    ranks, rows = Counter(), []
    for lang, score, a, phrase, left, right, total, k in out:
        ranks[lang] += 1
        if ranks[lang] <= top:
            rows.append((lang, ranks[lang], phrase.decode(), -a, left, right, total, -score, k))
    return sorted(rows)


TEXTS = [
    ("en", "New York is a city. New York, new york is large! The city of New York is old"),
    ("en", "a a a a a a a a a a"), (None, "New York is a city; new york"), ("fr", "NEW York\tis a\x0bcity. New York is ÉTÉ été"), ("en", None), ("en", ""), (None, None),
    ("en", " . , ; \t\n"), ("de", "\u0000 \x1c x y x y 🙂 🙃 🙂 🙃"), ("", "New York is New York is"),
] + [("en", "New York is a city. New York, new york is large! The city of New York is old")] * 2


@pytest.mark.parametrize("size, least", [(3, 2), (12, 1), (2_000_000, 3)])
def test_same_as_counts_by_dictionary(spark, size, least):
    docs = spark.createDataFrame([(*t, 1, "x") for t in TEXTS], "lang string, text string, n int, path string").repartition(3)
    got = sorted(tuple(r[c] for c in COLUMNS) for r in collocations(docs, least, size=size).collect())
    assert got == brute(TEXTS, least)


def test_random_corpus_and_cut_at_top(spark):
    import random

    rng = random.Random(1)
    texts = [(rng.choice(["en", "de", None]), " ".join(rng.choice(["the", "of", "a", "b", "c,", "ab", "a-b"]) for _ in range(rng.randrange(60)))) for _ in range(120)]
    docs = spark.createDataFrame(texts, "lang string, text string").repartition(5)
    got = sorted(tuple(r[c] for c in COLUMNS) for r in collocations(docs, 3, top=40, size=200).collect())
    want = brute(texts, 3, 40)
    assert len(want) == 120 and got == want


def test_exact_beyond_64_bits(spark):
    from outlyer.llm import collocations as c

    e = spark.sql("SELECT (1000 * cast(3000000000000 as decimal(19,0)) * cast(9000000000000000 as decimal(19,0))) div (cast(3000000000001 as decimal(19,0)) * cast(3000000000007 as decimal(19,0))) AS s").first().s
    assert e == 1000 * 3000000000000 * 9000000000000000 // (3000000000001 * 3000000000007) and c.DEPTH == 5


def test_odd_rows_and_empty_tables(odd, odd_texts, empty):
    assert collocations(empty).count() == 0
    rows = [(r.lang, r.text) for r in odd.select("lang", "text").collect()]
    assert sorted(tuple(r[c] for c in COLUMNS) for r in collocations(odd, 2).collect()) == brute(rows, 2)
