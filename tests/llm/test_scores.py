"""Quality, toxicity and language-model scores."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from outlyer.llm import lm_scoring, quality, queries, toxicity
from outlyer.llm.common import WORD

SF = "/root/testdata/sf0.01"


def auc(score, y):
    pos, neg = score[y == 1], score[y == 0]
    return np.mean([(p > neg).mean() + 0.5 * (p == neg).mean() for p in pos])


@pytest.mark.parametrize(("query", "label", "least"), [("op10_quality", "quality", 0.98), ("op5_toxicity", "toxic", 0.8)])
def test_held_out_accuracy(spark, query, label, least):
    got = queries.QUERIES[query](spark, SF)
    assert got.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    own = got.join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert auc(own.score.to_numpy(), own[label].to_numpy()) >= least
    assert (own.predicted == own[label]).mean() >= 0.95 and own.score.between(0, 1).all()


@pytest.mark.parametrize("module", [quality, toxicity])
def test_odd_rows(spark, module, odd, empty, make):
    labels = spark.createDataFrame([(k, k % 2, (k // 2) % 2) for k in range(-5, 19)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    model = module.fit(odd.select("doc_id", "text"), labels)
    out = module.score(odd, model)
    assert out.count() == odd.count() and out.where("score is null or not score between 0 and 1").count() == 0
    assert set(odd.columns) <= set(out.columns)
    assert module.score(empty, model).count() == 0
    bare = module.fit(empty.select("doc_id", "text"), labels.limit(0))
    assert {r.score for r in module.score(make(["a", None]), bare).collect()} <= {0.0, 0.5}


def test_discriminant_is_the_log_density_difference():
    rng = np.random.default_rng(4)
    x = np.vstack([rng.normal(0, 1, (80, 3)), rng.normal(1, 2, (90, 3))])
    y = np.repeat([0, 1], [80, 90])
    m = quality.fit_classes(x, y, 0.2, 0.1)
    z = (x - m.centre) / m.scale
    for k, z_k in enumerate(z[:5]):
        want = 0.0
        for c, sign in ((1, 1), (0, -1)):
            cov = np.linalg.inv(m.factors[c].T @ m.factors[c])
            d = z_k - m.means[c]
            want += sign * (-0.5 * d @ np.linalg.solve(cov, d) - 0.5 * np.linalg.slogdet(cov)[1])
        assert m.raw(x[k : k + 1])[0] == pytest.approx(want)


def all_maximal(s):
    """Ruzzo and Tompa's definition by recursion: the best segment (leftmost, shortest), then both sides."""
    best = None
    for i in range(len(s)):
        for j in range(i + 1, len(s) + 1):
            v = sum(s[i:j])
            if v > 0 and (best is None or v > best[2] + 1e-12 or (abs(v - best[2]) <= 1e-12 and (i > best[0] or j < best[1]) and best[0] <= i and j <= best[1])):
                best = i, j, v
    if best is None:
        return []
    i, j, v = best
    return all_maximal(s[:i]) + [best] + [(a + j, b + j, w) for a, b, w in all_maximal(s[j:])]


def test_maximal_segments():
    rng = np.random.default_rng(7)
    for _ in range(200):
        s = rng.normal(-0.2, 1, int(rng.integers(0, 14)))
        got, want = toxicity.maximal_segments(s), all_maximal(s.tolist())
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
        assert [v for *_, v in got] == pytest.approx([v for *_, v in want])


def test_decay_solves_its_equation():
    s, p = np.array([2.0, 1.0, -0.5]), np.array([0.05, 0.05, 0.9])
    lam = toxicity.decay_of(s, p)
    assert (p * np.exp(lam * s)).sum() == pytest.approx(1, abs=1e-6)


def test_toxic_passages(make):
    model = toxicity.ToxicModel({"bad": 3.0, "worse": 4.0}, 1.0, 0.01, np.array([1.0, -2.0]))
    text = "fine " * 30 + "bad worse bad " + "fine " * 30
    got = toxicity.passages(make([text, None, "fine"]), model).collect()
    assert len(got) == 1 and text[got[0].start : got[0].end] == "bad worse bad"


@pytest.mark.parametrize("frequent", [1 << 20, 8])
def test_models_against_dictionaries(make, monkeypatch, frequent):
    monkeypatch.setattr(lm_scoring, "FREQUENT", frequent)  # with 8 most pairs are joined
    texts = ["the cat sat on the mat", "the dog sat", "", None, "cat cat cat", "a b c d " * 30, "the dog sat"]
    docs = make(texts)
    labels = docs.sparkSession.createDataFrame([(k, 1) for k in range(7)], "doc_id long, quality int")
    got = {r.doc_id: r for r in lm_scoring.score(docs, lm_scoring.fit(docs, labels)).collect()}
    words = {k: WORD.findall((t or "").lower()) for k, t in enumerate(texts)}
    targets = {k for k in words if zlib.crc32(str(k).encode()) % 5}
    kinds = len({w for own in words.values() for w in own})
    losses = {}
    for name, ids in (("background_loss", words), ("target_loss", targets)):
        uni, ctx, pair = Counter(), Counter(), Counter()
        for k in ids:
            for v, w in zip([""] + words[k], words[k]):
                uni[w] += 1
                ctx[v] += 1
                pair[v, w] += 1
        n = sum(uni.values())
        for k, own in words.items():
            total = 0.0
            for v, w in zip([""] + own, own):
                alone = (uni[w] + 1) / (n + kinds)
                total -= math.log((pair[v, w] + lm_scoring.MU * alone) / (ctx[v] + lm_scoring.MU))
            losses[k, name] = total / max(1, len(own))
    for (k, name), v in losses.items():
        assert got[k][name] == pytest.approx(v, rel=1e-4, abs=1e-9)
        assert got[k].tokens == len(words[k])


def test_lm_odd_rows(odd, empty, spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    out = lm_scoring.score(odd, lm_scoring.fit(odd, none))
    assert out.count() == odd.count() and out.where(F.abs("score") > 1e-9).count() == 0
    assert lm_scoring.score(empty, lm_scoring.fit(empty, none)).count() == 0
