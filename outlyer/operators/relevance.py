"""Localised relevance: a small network says where each ensemble member can be trusted.

The network is a few hundred numbers. Training reads all rows in each epoch: a partition sums its rows'
gradients, the sums meet in one aggregation, and only they reach the driver. ``train`` does the same for
a bounded sample on the driver. Scoring all rows is one scan with the network broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from outlyer.functions.tables import written
from outlyer.functions.vectors import dot, matrix
from outlyer.operators.active import Config
from outlyer.operators.metrics import quantile_values


@dataclass
class Network:
    """One hidden leaky layer, then a sigmoid for each member."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray

    @classmethod
    def start(cls, inputs: int, members: int, hidden: int = 0, prior: float = 0.5, seed: int = 42) -> Network:
        rng, h = np.random.default_rng(seed), hidden or max(50, 3 * members)
        return cls(rng.normal(0, 0.1, (inputs, h)), np.zeros(h), rng.normal(0, 0.01, (h, members)), np.full(members, np.log(prior / (1 - prior))))

    def forward(self, x: np.ndarray):
        a = x @ self.w1 + self.b1
        h = np.maximum(a, 0.2 * a)
        return a, h, 1 / (1 + np.exp(-np.clip(h @ self.w2 + self.b2, -30, 30)))

    def relevance(self, x: np.ndarray) -> np.ndarray:
        return self.forward(x)[2]


    def parameters(self) -> list[np.ndarray]:
        return [self.w1, self.b1, self.w2, self.b2]

    def moved(self, flat: np.ndarray) -> Network:
        """The network with other numbers, given in a row."""
        out, at = [], 0
        for p in self.parameters():
            out.append(flat[at : at + p.size].reshape(p.shape))
            at += p.size
        return Network(*out)


def gradient_sum(net: Network, x: np.ndarray, values: np.ndarray, y: np.ndarray, q: float, shares: tuple[float, float, float], prior: float) -> np.ndarray:
    """Summed gradient, in a row, over rows with ``y`` 1, 0 or -1 (no label).

    ``shares`` weigh a row's cross entropy with the prior, an anomaly's hinge below ``q`` and a nominal's above it.
    Rows with labels have no part in the prior.
    """
    bg, ca, cn = shares
    a, h, p = net.forward(x)
    s = (p * values).sum(1)
    push = np.where((y == 1) & (s < q), -ca, 0.0) + np.where((y == 0) & (s >= q), cn, 0.0)
    dz = push[:, None] * values * p * (1 - p) + np.where(y < 0, bg, 0.0)[:, None] * (p - prior)
    da = (dz @ net.w2.T) * np.where(a > 0, 1.0, 0.2)
    return np.concatenate([(x.T @ da).ravel(), da.sum(0), (h.T @ dz).ravel(), dz.sum(0)])


def _filled(x: pa.ListArray, d: int) -> np.ndarray:
    """A batch of arrays of ``d`` numbers as a matrix; rows that lack one are NaN."""
    out, missing = matrix(x, d)
    if missing.any():
        out[missing] = np.nan
    return out


def gradient(rows: DataFrame, net: Network, q: float, shares: tuple[float, float, float], prior: float = 0.5) -> DataFrame:
    """``k, g``: the gradient over rows (``x, values, y``, null without label), a row a parameter; partitions are summed first."""
    shared = rows.sparkSession.sparkContext.broadcast(net)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        total = np.zeros(sum(p.size for p in net.parameters()))
        for b in batches:
            if b.num_rows:
                y = pc.fill_null(b.column(2), -1).to_numpy(zero_copy_only=False)
                total += gradient_sum(net, _filled(b.column(0), len(net.w1)), _filled(b.column(1), len(net.b2)), y, q, shares, prior)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["k", "g"])

    return rows.select("x", "values", F.col("y").cast("int").alias("y")).mapInArrow(part, "k int, g double").groupBy("k").agg(F.sum("g").alias("g"))


def train_on_rows(rows: DataFrame, net: Network, q: float, cfg: Config, prior: float = 0.5, weight: float = 1.0, epochs: int = 20, rate: float = 0.02) -> Network:
    """Adam over all rows; an epoch is one aggregation."""
    n = rows.agg(*(F.count_if(c).alias(k) for k, c in (("bg", F.col("y").isNull()), ("a", F.col("y") == 1), ("n", F.col("y") == 0)))).first()
    shares = (weight / max(1, n.bg), cfg.ca / max(1, n.a), cfg.cn / max(1, n.n))
    flat = np.concatenate([p.ravel() for p in net.parameters()])
    m = v = np.zeros_like(flat)
    for t in range(1, epochs + 1):
        g = 1e-4 * flat
        for r in gradient(rows, net.moved(flat), q, shares, prior).collect():  # a number a parameter
            g[r.k] += r.g
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        flat = flat - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return net.moved(flat)


def scored(rows: DataFrame, net: Network) -> DataFrame:
    """``rows`` (``x, values``) with ``relevance``, an entry a member, and ``score``, relevance times value."""
    shared = rows.sparkSession.sparkContext.broadcast(net)

    @F.arrow_udf("array<double>")
    def f(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for p in parts:
            found = shared.value.relevance(_filled(p, len(shared.value.w1)))
            yield pa.ListArray.from_arrays(np.arange(len(p) + 1, dtype=np.int32) * found.shape[1], found.ravel())

    return rows.withColumn("relevance", f("x")).withColumn("score", dot(F.col("relevance"), F.col("values")))


class Session:
    """Ask the best row, learn where members can be trusted, again; ``rows`` are ``id, x, values`` (higher for the more anomalous)."""

    def __init__(self, rows: DataFrame, members: int, inputs: int, cfg: Config | None = None, prior: float = 0.5, hidden: int = 8, epochs: int = 20):
        self.cfg, self.prior, self.epochs = cfg or Config(), prior, epochs
        self.rows = written(rows.select("id", "x", "values"), "relevance")
        self.net = Network.start(inputs, members, hidden, prior, self.cfg.seed)
        self.asked: list[int] = []
        self.labels: list[int] = []

    def step(self, label_of) -> list[int]:
        spark = self.rows.sparkSession
        now = scored(self.rows, self.net).select("id", "score").persist()
        try:
            known = spark.createDataFrame([(i,) for i in self.asked], "id long")
            found = [int(r.id) for r in now.join(F.broadcast(known), "id", "left_anti").orderBy(F.col("score").desc(), "id").limit(self.cfg.batch).collect()]
            if not found:
                return []
            self.asked += found
            self.labels += [int(label_of(i)) for i in found]
            q = float(quantile_values(now, "score", [1 - self.cfg.tau])[0])
        finally:
            now.unpersist()
        given = spark.createDataFrame(list(zip(self.asked, self.labels, strict=True)), "id long, y int")  # as many as were answered
        self.net = train_on_rows(self.rows.join(F.broadcast(given), "id", "left"), self.net, q, self.cfg, self.prior, 1.0, self.epochs)
        return found

    def run(self, label_of) -> list[int]:
        while len(self.asked) < self.cfg.budget and self.step(label_of):
            pass
        return self.asked


def as_arrays(members: DataFrame, x: DataFrame) -> DataFrame:
    """``id, x, values`` from a member table (``id, member, value``) and vectors (``id, x``): an entry a member, by name."""
    table = members.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("member", "value"))).alias("m"))
    return x.select("id", "x").join(table.select("id", F.transform("m", lambda v: v["value"]).alias("values")), "id")


# descriptions

_BINS = 16


def binned(rows: DataFrame, features: list[str], bins: int = _BINS) -> tuple[DataFrame, dict[str, tuple[float, float]]]:
    """``id`` and ``b_f``: each feature's place among ``bins`` equal parts of its range; and the ranges."""
    lim = rows.agg(*(e(f).cast("double").alias(f"{n}_{f}") for f in features for n, e in (("lo", F.min), ("hi", F.max)))).first()
    ranges = {f: (lim[f"lo_{f}"] or 0.0, lim[f"hi_{f}"] or 0.0) for f in features}

    def place(f: str):
        lo, hi = ranges[f]
        return F.lit(0) if hi <= lo else F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor((F.col(f) - lo) / (hi - lo) * bins).cast("int")))

    return rows.select("id", *(place(f).cast("int").alias(f"b_{f}") for f in features)), ranges


def member_trees(places: DataFrame, features: list[str], targets: DataFrame, depth: int = 2, least: int = 1) -> DataFrame:
    """Leaves of one tree a member that parts rows with ``y`` 1 from the others: ``member, leaf, lo_f, hi_f (bins), n, pos``.

    ``places`` come from :func:`binned`, ``targets`` are ``member, id, y``. All trees grow together, a level at
    a time: rows are counted by member, node, feature and bin, and each node takes the cut of
    least Gini impurity (ties: first feature, lowest bin). What is kept of a level is as large as the model.
    """
    at = targets.join(places, "id").withColumn("leaf", F.lit(1).cast("long"))
    bounds = [F.lit(e).cast("int").alias(f"{n}_{f}") for f in features for n, e in (("lo", 0), ("hi", _BINS - 1))]
    boxes = targets.select("member").distinct().select("member", F.lit(1).cast("long").alias("leaf"), *bounds)
    along = Window.partitionBy("member", "leaf", "f").orderBy("bin")
    whole = Window.partitionBy("member", "leaf", "f")
    for _ in range(depth):
        cells = F.explode(F.array(*(F.struct(F.lit(k).alias("f"), F.col(f"b_{f}").alias("bin")) for k, f in enumerate(features)))).alias("c")
        counts = at.select("member", "leaf", "y", cells).groupBy("member", "leaf", "c.f", "c.bin").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("pos"))
        sums = counts.select("member", "leaf", "f", "bin", *(F.sum(c).over(w).alias(f"{s}_{c}") for c in ("n", "pos") for s, w in (("l", along), ("t", whole))))
        gini = lambda n, p: F.when(n > 0, 2.0 * p * (n - p) / n).otherwise(0.0)
        left, right = gini(F.col("l_n"), F.col("l_pos")), gini(F.col("t_n") - F.col("l_n"), F.col("t_pos") - F.col("l_pos"))
        fit = sums.withColumn("gain", F.round(gini(F.col("t_n"), F.col("t_pos")) - left - right, 9)).where((F.col("gain") > 0) & (F.col("l_n") >= least) & (F.col("t_n") - F.col("l_n") >= least))
        best = fit.groupBy("member", "leaf").agg(F.max(F.struct("gain", (-F.col("f")).alias("f"), (-F.col("bin")).alias("bin"))).alias("b"))
        cuts = written(best.select("member", "leaf", (-F.col("b.f")).alias("f"), (-F.col("b.bin")).alias("cut")), "cuts")
        at = at.join(F.broadcast(cuts), ["member", "leaf"], "left")  # a row a node
        value = F.coalesce(*(F.when(F.col("f") == k, F.col(f"b_{f}")) for k, f in enumerate(features)))
        at = at.withColumn("leaf", F.when(F.col("f").isNull(), F.col("leaf")).otherwise(F.col("leaf") * 2 + (value > F.col("cut")).cast("long"))).drop("f", "cut")
        grown = boxes.join(F.broadcast(cuts), ["member", "leaf"], "left")
        sides = F.explode(F.when(F.col("f").isNull(), F.array(F.lit(-1))).otherwise(F.array(F.lit(0), F.lit(1)))).alias("side")
        split = grown.select("*", sides)
        for k, f in enumerate(features):
            mine = F.col("f") == k
            split = split.withColumn(f"hi_{f}", F.when(mine & (F.col("side") == 0), F.col("cut")).otherwise(F.col(f"hi_{f}")))
            split = split.withColumn(f"lo_{f}", F.when(mine & (F.col("side") == 1), F.col("cut") + 1).otherwise(F.col(f"lo_{f}")))
        boxes = split.withColumn("leaf", F.when(F.col("side") < 0, F.col("leaf")).otherwise(F.col("leaf") * 2 + F.col("side"))).drop("f", "cut", "side")
    counted = at.groupBy("member", "leaf").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("pos"))
    return boxes.join(counted, ["member", "leaf"])


def member_rules(leaves: DataFrame, features: list[str], ranges: dict[str, tuple[float, float]], share: float = 0.5) -> DataFrame:
    """``member, rank, rule, tp, fp``: leaves in which more than ``share`` of the rows are relevant, as rules on the features, the largest first."""
    parts = []
    for f in features:
        lo, hi = ranges[f]
        width = (hi - lo) / _BINS
        parts.append(F.when(F.col(f"lo_{f}") > 0, F.concat(F.lit(f"{f} >= "), F.round(lo + F.col(f"lo_{f}") * width, 6).cast("string"))))
        parts.append(F.when(F.col(f"hi_{f}") < _BINS - 1, F.concat(F.lit(f"{f} < "), F.round(lo + (F.col(f"hi_{f}") + 1) * width, 6).cast("string"))))
    good = leaves.where(F.col("pos") > share * F.col("n"))
    rank = F.row_number().over(Window.partitionBy("member").orderBy(F.col("pos").desc(), "leaf"))  # the leaves of a tree
    return good.select("member", rank.alias("rank"), F.concat_ws(" & ", *parts).alias("rule"), F.col("pos").alias("tp"), (F.col("n") - F.col("pos")).alias("fp"))


def train(net: Network, background: np.ndarray, x: np.ndarray, scores: np.ndarray, y: np.ndarray, q: float, cfg: Config, prior: float = 0.5, weight: float = 1.0, epochs: int = 200, rate: float = 0.01) -> Network:
    """Adam on the prior's cross entropy over the background and the hinges of labelled rows against q."""
    params = [net.w1, net.b1, net.w2, net.b2]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for t in range(1, epochs + 1):
        grads = [1e-4 * p for p in params]

        def back(a, h, inp, dz):
            dh = (dz @ net.w2.T) * np.where(a > 0, 1.0, 0.2)
            for g, d in zip(grads, (inp.T @ dh, dh.sum(0), h.T @ dz, dz.sum(0)), strict=True):
                g += d

        a, h, p = net.forward(background)
        back(a, h, background, weight * (p - prior) / len(background))
        if len(x):
            a, h, p = net.forward(x)
            s = (p * scores).sum(1)
            push = np.where((y == 1) & (s < q), -cfg.ca / max(1, (y == 1).sum()), 0) + np.where((y == 0) & (s >= q), cfg.cn / max(1, (y == 0).sum()), 0)
            back(a, h, x, push[:, None] * scores * p * (1 - p))
        for k, (p_, g) in enumerate(zip(params, grads, strict=True)):
            m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
            p_ -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return net


def relevances(rows: DataFrame, features: list[str], net: Network) -> DataFrame:
    """``rows`` with ``relevance``: an array with an entry a member."""
    shared = rows.sparkSession.sparkContext.broadcast(net)

    @F.pandas_udf("array<double>")
    def f(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for p in parts:
            yield pd.Series(list(shared.value.relevance(np.column_stack([c.to_numpy(float) for c in p]))), dtype=object)

    return rows.withColumn("relevance", f(*(F.col(c).cast("double") for c in features)))


def weighted_scores(members: DataFrame) -> DataFrame:
    """``id, score``: the sum of relevance times value over ``id, member, value, relevance``."""
    return members.groupBy("id").agg(F.sum(F.col("relevance") * F.col("value")).alias("score"))


def best_members(members: DataFrame) -> DataFrame:
    """``members`` with ``rank``: the most relevant of a row first, ties by number."""
    return members.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.col("relevance").desc(), "member")))


def local_surrogate(score, at: np.ndarray, scale: np.ndarray, n: int = 500, seed: int = 42) -> np.ndarray:
    """Weights of a ridge fit to ``score`` around a row, near points counting more."""
    z = np.random.default_rng(seed).normal(size=(n, len(at)))
    w = np.exp(-(z**2).sum(1) / (2 * 0.75 * len(at)))
    a = np.column_stack([z, np.ones(n)])
    return np.linalg.solve((a * w[:, None]).T @ a + 1e-3 * np.eye(len(at) + 1), (a * w[:, None]).T @ score(at + z * scale))[:-1]
