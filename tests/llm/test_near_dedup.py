import random
from collections import Counter

import numpy as np
import pytest

from outlyer.llm import near_dedup as N
from outlyer.llm.common import WORD
from outlyer.llm.components import components


def bags(texts):
    out = {}
    for k, t in texts.items():
        w = WORD.findall((t or "").lower())
        out[k] = tuple(w), Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()
    return out


def brute(texts, theta=0.8):
    b, parent = bags(texts), {k: k for k in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in texts:
        for j in texts:
            if i < j:
                x, y = b[i][1], b[j][1]
                either = sum((x | y).values())
                if b[i][0] == b[j][0] or (either and sum((x & y).values()) / either >= theta):
                    a, c = sorted((find(i), find(j)))
                    parent[c] = a
    return {k: find(k) for k in texts}


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def test_against_brute_force(make):
    rng = random.Random(5)
    texts = []
    for g in range(12):
        base = [f"g{g}w{rng.randrange(400)}" for _ in range(rng.choice([8, 40, 150]))]
        texts += [edited(rng, base, n) for n in (0, 0, 1, 2, 3, 5)]
    texts += [f"lonely {k} " * 9 for k in range(20)] + ["a b", "a b", "a b c"]
    got = {r.doc_id: r.class_id for r in N.groups(make(texts)).collect()}
    assert got == brute(dict(enumerate(texts)))


def test_hot_group_of_near_copies(make):
    rng = random.Random(9)
    base = [f"w{rng.randrange(500)}" for _ in range(150)]
    texts = [" ".join(base)] + [edited(rng, base, rng.choice([1, 1, 2, 4, 6])) for _ in range(150)]
    second = edited(rng, base, 5).split()
    texts += [edited(rng, second, 1) for _ in range(40)] + [" ".join(base)] * 30
    got = {r.doc_id: r.class_id for r in N.groups(make(texts)).collect()}
    assert got == brute(dict(enumerate(texts)))


@pytest.mark.parametrize("outright", [N.OUTRIGHT, 0])
def test_truncated_copies_of_a_long_hub(make, monkeypatch, outright):
    """All members lie inside one long text, so that none has a word that it lacks; nothing outright: all are dealt."""
    monkeypatch.setattr(N, "OUTRIGHT", outright)
    rng = random.Random(10)
    base = [f"w{rng.randrange(500)}" for _ in range(150)]
    texts = [" ".join(base[: 150 - rng.randrange(0, 45)]) for _ in range(60)] + [" ".join(base + base[:k]) for k in range(0, 40, 2)]
    texts += [" ".join(base[rng.randrange(0, 40) :]) for _ in range(40)]
    got = {r.doc_id: r.class_id for r in N.groups(make(texts)).collect()}
    assert got == brute(dict(enumerate(texts)))


def test_differences_that_linked_bags_share():
    rng = np.random.default_rng(8)
    met = 0
    for _ in range(3000):
        hub, a = (dict(zip(range(40), rng.integers(0, 3, 40), strict=True)) for _ in range(2))
        a = {k: (a[k] if rng.random() < 0.15 else v) for k, v in hub.items()}
        b = {k: (int(rng.integers(0, 3)) if rng.random() < 0.08 else v) for k, v in a.items()}
        bags_ = [(np.array([k for k, v in x.items() if v], np.uint64), np.array([v for v in x.values() if v])) for x in (hub, a, b)]
        to_hub, to_a = [N.overlap(bags_[0], x) >= 0.8 for x in bags_[1:]], N.overlap(bags_[1], bags_[2]) >= 0.8
        if to_a and not all(to_hub):
            met += 1
            x, y = (set(N.differences(v, bags_[0], k).tolist()) for v, k in zip(bags_[1:], to_hub, strict=True))
            assert x & y
    assert met > 100


def test_large_ids_beside_null_ids(spark):
    big = 2**53 + 1
    df = spark.createDataFrame([(big, "a b c"), (None, "x y"), (big + 2, "a b c"), (big + 1, "d e f")], "doc_id long, text string")
    got = {r.doc_id: (r.class_id, r.kept) for r in N.groups(df).collect()}
    assert got == {big: (big, True), big + 2: (big, False), big + 1: (big + 1, True), None: (None, True)}


def test_odd_rows(odd, empty):
    got = N.groups(odd).collect()
    assert len(got) == odd.count()
    cls = {r.doc_id: r.class_id for r in got if r.doc_id is not None}
    assert cls[0] == cls[1] == cls[2] == cls[17] == 0 and cls[9] == cls[10] == 9
    assert {r.kept for r in got if r.doc_id == 9} == {True} and {r.kept for r in got if r.doc_id == 10} == {False}
    assert N.groups(empty).count() == 0


def test_registers_estimate_weighted_similarity():
    rng = np.random.default_rng(3)
    h = N.mix(np.arange(1, 400, dtype=np.uint64))
    a, b = rng.integers(1, 9, 399), rng.integers(1, 9, 399)
    b[:150] = a[:150]
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    agree = []
    for seed in range(20):
        s = N.mix(h + np.uint64(seed * 1000003))
        x = N.signatures([(s, a), (s, b)], 200)
        agree.append((x[0] == x[1]).mean())
    assert np.mean(agree) == pytest.approx(want, abs=0.02)


def test_points_at_a_time_do_not_matter():
    h = N.mix(np.arange(1, 30, dtype=np.uint64))
    c = np.arange(1, 30)
    assert (N.signatures([(h, c)], 64, 1) == N.signatures([(h, c)], 64, 16)).all()


def test_components_of_long_paths(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (102, 101)], "a long, b long")
    got = {r.id: r.label for r in components(links).collect()}
    assert {got[k] for k in range(41)} == {0} and {got[100], got[101], got[102]} == {100}


def test_words_of_ascii_and_other_texts():
    import random

    from outlyer.llm.common import WORD, words_of

    rng = random.Random(1)
    for k in range(5_000):
        text = "".join(chr(rng.randrange(128 if k % 2 or j % 3 else 0x3000)) for j in range(rng.randrange(40)))
        assert words_of(text) == WORD.findall(text.lower())
    assert words_of(None) == words_of("") == []


def test_similarity_with_a_hub_bounds_similarity():
    """What lets pairs be left out unread: distances of weighted bags keep the triangle inequality."""
    rng = np.random.default_rng(12)
    for _ in range(2000):
        bags_ = [(np.flatnonzero(c := rng.poisson(rng.uniform(0.2, 2), 30) * (rng.random(30) < rng.uniform(0.3, 1))).astype(np.uint64), c[c > 0]) for _ in range(3)]
        ab, ac, bc = (1 - N.overlap(bags_[i], bags_[j]) for i, j in ((0, 1), (0, 2), (1, 2)))
        assert abs(ac - bc) <= ab + 1e-9
