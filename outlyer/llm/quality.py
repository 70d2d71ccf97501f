"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Every whole text becomes a vector of ``len(NAMES)`` statistics of its bytes, words and lines,
logged or put on the logit scale. Each class of the training rows has a mean and a covariance that
is shrunk twice: towards the pooled one, and then towards its own diagonal. A document's raw
score is the difference of the two log densities, each a Mahalanobis distance taken through the
class's Cholesky factor, computed once; a logistic curve fitted on rows that neither mean nor
covariance has seen makes it a probability of label 1. The two amounts of shrinkage are chosen by
log loss on those rows.

Training takes at most ``SAMPLE`` labelled rows (see :func:`common.labelled_sample`), so that the
driver holds that many vectors at any size of the corpus; scoring is one scan without a shuffle.

Defined cases: null texts count as empty, and empty texts have a fixed vector and thus a score;
labels other than 0 and 1 are left out; when a class has fewer than two rows every score is the
share of label 1 (0.5 without labels); columns named like the results are replaced.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outlyer.llm.common import held_out, labelled_sample, text_of

#: Rows to train on at most.
SAMPLE = 20_000
#: From this score on a document counts as good.
THRESHOLD = 0.3
NAMES = ["bytes", "words", "word_length", "capitals", "digits", "punctuation", "symbols", "bars", "non_ascii", "distinct_words", "top_word", "distinct_pairs", "line_length", "distinct_lines", "line_ends"]

SPACE, LOWER, UPPER, DIGIT, POINT, SYMBOL, BAR, OTHER = range(8)
_KIND = np.full(256, OTHER, np.uint8)
_KIND[:128] = SYMBOL
_KIND[[9, 10, 11, 12, 13, 32]] = SPACE
_KIND[97:123], _KIND[65:91], _KIND[48:58] = LOWER, UPPER, DIGIT
_KIND[[ord(c) for c in ".,;:!?'\"()-"]] = POINT
_KIND[ord("|")] = BAR


def statistics(text: str) -> list[float]:
    """The transformed statistics of a text, in the order of NAMES."""
    raw = np.frombuffer(text.encode(errors="replace"), np.uint8)
    kinds = np.bincount(_KIND[raw], minlength=8)
    ink = max(1, len(raw) - int(kinds[SPACE]))
    words = text.split()
    n = len(words)
    counts = Counter(words)
    pairs = len(set(zip(words, words[1:]))) if n > 1 else 1
    lines = [x for x in text.split("\n") if x]
    part = lambda a, b: np.log((a + 0.5) / (b - a + 0.5))
    top = max(counts.values(), default=0)
    ended = sum(x[-1] in ".!?:;\"')" for x in lines)
    return [
        np.log1p(len(raw)), np.log1p(n), np.log1p(ink / max(1, n)),
        part(kinds[UPPER], ink), part(kinds[DIGIT], ink), part(kinds[POINT], ink), part(kinds[SYMBOL], ink), part(kinds[BAR], ink), part(kinds[OTHER], ink),
        part(len(counts), max(n, len(counts))), part(top, max(n, top)), part(pairs, max(1, n - 1)),
        np.log1p(n / max(1, len(lines))), part(len(set(lines)), max(1, len(lines))), part(ended, max(1, len(lines))),
    ]


def vectors(texts: pd.Series) -> np.ndarray:
    return np.array([statistics(t or "") for t in texts], float).reshape(-1, len(NAMES))


@dataclass
class Discriminant:
    """Means, cached inverse Cholesky factors and log determinants of the classes 0 and 1."""

    centre: np.ndarray
    scale: np.ndarray
    means: list[np.ndarray]
    factors: list[np.ndarray]
    log_dets: list[float]
    slope: float = 1.0
    offset: float = 0.0

    def raw(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.centre) / self.scale
        d = [((z - m) @ f.T) ** 2 for m, f in zip(self.means, self.factors, strict=True)]
        return 0.5 * ((d[0].sum(1) + self.log_dets[0]) - (d[1].sum(1) + self.log_dets[1]))

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * squash(self.raw(x)) + self.offset, -30, 30)))


def squash(raw: np.ndarray) -> np.ndarray:
    """Signed log, as log densities far out differ by thousands."""
    return np.sign(raw) * np.log1p(np.abs(raw))


def fit_classes(x: np.ndarray, y: np.ndarray, pooled_part: float, diagonal_part: float) -> Discriminant:
    centre, scale = x.mean(0), x.std(0) + 1e-6
    z = (x - centre) / scale
    groups = [z[y == k] for k in (0, 1)]
    own = [np.cov(g.T, bias=True) for g in groups]
    pooled = sum(len(g) * c for g, c in zip(groups, own, strict=True)) / len(z)
    factors, dets = [], []
    for c in own:
        c = (1 - pooled_part) * c + pooled_part * pooled
        c = (1 - diagonal_part) * c + diagonal_part * np.diag(np.diag(c)) + 1e-3 * np.eye(len(c))
        low = np.linalg.cholesky(c)
        factors.append(np.linalg.inv(low))
        dets.append(2 * float(np.log(np.diag(low)).sum()))
    return Discriminant(centre, scale, [g.mean(0) for g in groups], factors, dets)


def logistic(x: np.ndarray, y: np.ndarray, steps: int = 50, ridge: float = 1e-3) -> np.ndarray:
    """Coefficients of a ridged logistic regression by Newton steps; the last is the offset."""
    a = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(a.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (p * (1 - p))[:, None]).T @ a + ridge * len(a) * np.eye(len(w)) * 1e-2
        step = np.linalg.solve(h, a.T @ (y - p) - ridge * 1e-2 * len(a) * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(x: np.ndarray, y: np.ndarray, fold: np.ndarray) -> Discriminant | float:
    """The discriminant, or the share of label 1 where a class is too small."""
    inner, outer = fold != 4, fold == 4
    if min((y[inner] == 0).sum(), (y[inner] == 1).sum()) < 2:
        return float(y.mean()) if len(y) else 0.5
    if min((y[outer] == 0).sum(), (y[outer] == 1).sum()) < 2:
        outer = inner
    best = None
    for pooled_part in (0.0, 0.1, 0.3, 0.6):
        for diagonal_part in (0.0, 0.1, 0.3):
            model = fit_classes(x[inner], y[inner], pooled_part, diagonal_part)
            model.slope, model.offset = logistic(squash(model.raw(x[outer]))[:, None], y[outer])
            p = np.clip(model.probability(x[outer]), 1e-6, 1 - 1e-6)
            loss = -np.mean(np.where(y[outer] == 1, np.log(p), np.log(1 - p)))
            if best is None or loss < best[0] - 1e-9:
                best = loss, model
    return best[1]


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> Discriminant | float:
    rows = labelled_sample(docs, labels.where(F.col(label).isin(0, 1)), label, sample)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b.doc_id, "x": list(vectors(b.text)), "y": b.y, "fold": b.fold})

    # ``sample`` vectors at most
    got = rows.mapInPandas(measure, "doc_id long, x array<double>, y int, fold int").toPandas().sort_values("doc_id", kind="stable")
    x = np.array(got.x.tolist(), float).reshape(-1, len(NAMES))
    return train(x, got.y.to_numpy(), got.fold.to_numpy())


def score(docs: DataFrame, model: Discriminant | float, text_col: str = "text") -> DataFrame:
    """``docs``, all columns kept, with held_out, score and predicted."""

    @F.pandas_udf("double")
    def rate(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield pd.Series(np.full(len(texts), model) if isinstance(model, float) else model.probability(vectors(texts)))

    kept = [F.col(f"`{c}`") for c in docs.columns if c not in ("held_out", "score", "predicted")]
    out = docs.select(*kept, held_out().alias("held_out"), rate(text_of(text_col)).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
