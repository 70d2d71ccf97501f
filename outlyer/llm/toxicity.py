"""Toxic passages by maximum-scoring segments over token log-odds.

1. Lexicon. Words of the distinct training texts are counted by label, once a text, as a word that
   fills one document is no evidence. Each gets the log-odds of its two rates under a Dirichlet
   prior that is the corpus itself, ``PRIOR`` words strong, and ``FLOOR`` for every word. Words
   whose signed root of the likelihood ratio is at least ``LEAST_Z`` keep them, up to
   ``MOST_WORDS``; all other words score ``DRIFT`` below 0, so that text without evidence wears a
   segment down.
2. Scan. One pass over a document finds all maximal segments of positive score (Ruzzo and Tompa);
   between words of positive score the prefix sum is taken as a whole, so the Python part costs
   one step for each of those words only.
3. Calibration. Under the null model the largest segment score of n words has an extreme-value
   law, P(S >= x) = 1 - exp(-K n exp(-lambda x)). lambda solves sum p(w) exp(lambda s(w)) = 1 over
   the words of clean training rows, and K is its maximum-likelihood value on clean rows that the
   lexicon has not seen. A segment with an expected count of at most ``MOST_EXPECTED`` is
   significant. A document's evidence is the sum of -log E over its significant segments, or the
   best segment's -log E where none is; its score is a logistic curve over that, fitted on the same
   unseen rows.

Training takes at most ``SAMPLE`` labelled rows; the lexicon is a broadcast of at most
``MOST_WORDS`` words. Scoring is one scan without a shuffle.

Defined cases: null texts count as empty; empty texts have no segment and score as the least toxic
ones; labels other than 0 and 1 are left out; without rows of both labels every score is the share
of label 1 (0 without labels); columns named like the results are replaced.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outlyer.llm.common import WORD, held_out, labelled_sample, text_of
from outlyer.llm.quality import logistic

SAMPLE = 20_000
PRIOR = 2_000.0
FLOOR = 0.5
LEAST_Z = 4.5
MOST_WORDS = 50_000
DRIFT = -0.05
MOST_EXPECTED = 0.05
THRESHOLD = 0.5


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments ``(start, end, score)``, end exclusive, in order.

    Every segment's own prefixes and suffixes have positive scores, and no longer segment that
    holds it does better.
    """
    at = np.flatnonzero(scores > 0)
    if not len(at):
        return []
    total = np.concatenate([[0.0], np.cumsum(scores)])
    found: list[tuple[float, float, int, int]] = []  # prefix sums before and after, start, end
    for i, left, right in zip(at.tolist(), total[at].tolist(), total[at + 1].tolist(), strict=True):
        start, end = i, i + 1
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][0] >= left:
                j -= 1
            if j < 0 or found[j][1] >= right:
                found.append((left, right, start, end))
                break
            left, start = found[j][0], found[j][2]
            del found[j:]
    return [(a, b, r - l) for l, r, a, b in found]


@dataclass
class ToxicModel:
    lexicon: dict[str, float] = field(default_factory=dict)
    decay: float = 1.0
    k: float = 1.0
    weights: np.ndarray | None = None
    prior: float = 0.0

    def segments(self, text: str) -> tuple[int, list[tuple[int, int, float, float]]]:
        """Word count, and ``(first word, last word + 1, score, expected count)`` of each segment."""
        words = WORD.findall(text)
        get = self.lexicon.get
        scores = np.array([get(w.lower(), DRIFT) for w in words])
        n = len(words)
        return n, [(a, b, s, self.k * n * math.exp(-min(700.0, self.decay * s))) for a, b, s in maximal_segments(scores)]

    def evidence(self, n: int, scores) -> float:
        """-log E of the best segment, or the sum of -log E over the significant ones."""
        worth = [self.decay * x - math.log(self.k * max(1, n)) for x in scores]
        several = sum(w for w in worth if w >= -math.log(MOST_EXPECTED))
        return several or max([-10.0, *worth])

    def probability(self, texts) -> np.ndarray:
        if self.weights is None:
            return np.full(len(texts), self.prior)
        found = [self.segments(t or "") for t in texts]
        x = shape([self.evidence(n, [s for _, _, s, _ in segments]) for n, segments in found])
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -30, 30)))


def shape(evidence: list[float]) -> np.ndarray:
    """A column for the logistic curve: large sums are logged."""
    x = np.array(evidence, float).reshape(-1, 1)
    return np.where(x > 0, np.log1p(np.maximum(x, 0)), x / 10)


def log_odds(counts: DataFrame, prior: float = PRIOR) -> DataFrame:
    """``word, n1, n0`` with log_odds, the signed likelihood-ratio root z, and the clean rate p0."""
    sums = counts.agg(F.sum("n1").alias("t1"), F.sum("n0").alias("t0"))
    both = F.col("n1") + F.col("n0")
    odds = lambda n, t: F.log((F.col(n) + F.col("a")) / (F.col(t) + prior - F.col(n) - F.col("a")))
    part = lambda n, t: F.when(F.col(n) > 0, F.col(n) * F.log(F.col(n) * (F.col("t1") + F.col("t0")) / (both * F.col(t)))).otherwise(0.0)
    return (
        counts.crossJoin(F.broadcast(sums))  # one row of totals
        .withColumn("a", prior * both / (F.col("t1") + F.col("t0")) + FLOOR)
        .withColumn("log_odds", odds("n1", "t1") - odds("n0", "t0"))
        .withColumn("z", F.signum(F.col("n1") * F.col("t0") - F.col("n0") * F.col("t1")) * F.sqrt(F.greatest(F.lit(0.0), 2 * (part("n1", "t1") + part("n0", "t0")))))
        .withColumn("p0", F.col("n0") / F.col("t0"))
    )


def decay_of(scores: np.ndarray, rates: np.ndarray) -> float:
    """The positive root of sum p exp(lambda s) = 1 by bisection."""
    low, high = 0.0, 1.0
    value = lambda x: float((rates * np.exp(np.minimum(700, x * scores))).sum())
    if not (scores[rates > 0] > 0).any():
        return 1.0
    while value(high) < 1 and high < 64:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if value(mid) < 1 else (low, mid)
    return max(high, 0.05)


def calibrate(model: ToxicModel, lengths: list[int], scores: list[list[float]], y: np.ndarray) -> ToxicModel:
    """K by maximum likelihood on the clean rows, then the logistic curve, from segment scores."""
    clean = [n * math.exp(-model.decay * max(s, default=0.0)) for n, s, label in zip(lengths, scores, y, strict=True) if not label]
    model.k = max(1e-9, len(clean) / max(1e-9, sum(clean)))
    model.weights = logistic(shape([model.evidence(n, s) for n, s in zip(lengths, scores, strict=True)]), np.asarray(y, float))
    return model


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE) -> ToxicModel:
    rows = labelled_sample(docs, labels.where(F.col(label).isin(0, 1)), label, sample)
    seen = {(r.y, r.outer): r.n for r in rows.groupBy("y", (F.col("fold") == 4).alias("outer")).agg(F.count(F.lit(1)).alias("n")).collect()}
    ones, all_ = sum(n for (y, _), n in seen.items() if y == 1), sum(seen.values())
    if not all(seen.get((y, outer)) for y in (0, 1) for outer in (True, False)):
        return ToxicModel(prior=ones / all_ if all_ else 0.0)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            n = [Counter(), Counter()]
            for text, y in zip(b.text, b.y, strict=True):
                n[y].update({w.lower() for w in WORD.findall(text)})
            words = list(n[0].keys() | n[1].keys())
            yield pd.DataFrame({"word": words, "n1": [n[1][w] for w in words], "n0": [n[0][w] for w in words]})

    counts = rows.where("fold <> 4").select("text", "y").distinct().mapInPandas(count, "word string, n1 long, n0 long").groupBy("word").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
    # MOST_WORDS rows at most
    top = log_odds(counts).where(F.abs("z") >= LEAST_Z).orderBy(F.abs("z").desc(), "word").limit(MOST_WORDS).select("word", "log_odds", "p0").toPandas()
    model = ToxicModel(dict(zip(top.word, top.log_odds.astype(float), strict=True)))
    scores, rates = top.log_odds.to_numpy(float), top.p0.to_numpy(float)
    model.decay = decay_of(np.append(scores, DRIFT), np.append(rates, 1 - rates.sum()))

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [model.segments(t) for t in b.text]
            yield pd.DataFrame({"doc_id": b.doc_id, "y": b.y, "n": [n for n, _ in found], "s": [[s for _, _, s, _ in f] for _, f in found]})

    outer = rows.where("fold = 4").mapInPandas(weigh, "doc_id long, y int, n long, s array<double>").toPandas().sort_values("doc_id", kind="stable")
    return calibrate(model, outer.n.tolist(), outer.s.tolist(), outer.y.to_numpy())


def score(docs: DataFrame, model: ToxicModel, text_col: str = "text") -> DataFrame:
    """``docs``, all columns kept, with held_out, score and predicted."""

    @F.pandas_udf("double")
    def rate(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield pd.Series(model.probability(texts), dtype=float)

    kept = [F.col(f"`{c}`") for c in docs.columns if c not in ("held_out", "score", "predicted")]
    out = docs.select(*kept, held_out().alias("held_out"), rate(text_of(text_col)).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def passages(docs: DataFrame, model: ToxicModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per significant passage: id, start and end (characters), score, expected count."""

    def spans(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, text in zip(b[id_col], b.text, strict=True):
                found = [x for x in model.segments(text)[1] if x[3] <= MOST_EXPECTED]
                at = [m.span() for m in WORD.finditer(text)] if found else []
                rows += [(i, at[a][0], at[e - 1][1], s, x) for a, e, s, x in found]
            yield pd.DataFrame(rows, columns=[id_col, "start", "end", "score", "expected"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_of(text_col).alias("text")).mapInPandas(spans, f"`{id_col}` {kind}, start int, end int, score double, expected double")
