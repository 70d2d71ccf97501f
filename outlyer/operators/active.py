"""Active discovery: member weights learnt from an analyst's labels.

Scoring and ranking are Spark jobs over all rows; the labelled rows (a budget's worth) and the
weights live on the driver, where the small optimisation runs. A round is a few jobs of one scan each:
the best rows that have no label, the score quantile, and the row at it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outlyer.functions.ranking import arithmetic_order
from outlyer.functions.vectors import squared_distance
from outlyer.operators import forest
from outlyer.operators.metrics import quantile_values


@dataclass(frozen=True)
class Config:
    tau: float = 0.03
    budget: int = 35
    batch: int = 1
    explore: int = 10
    ca: float = 1.0
    cn: float = 1.0
    cx: float = 1.0
    sigma2: float = 0.5
    prior: bool = True
    rate: float = 0.001
    epochs: int = 1000
    seed: int = 42


def uniform_weights(m: int) -> np.ndarray:
    return np.full(m, 1 / np.sqrt(m))


def random_weights(m: int, seed: int = 42) -> np.ndarray:
    w = np.random.default_rng(seed).normal(size=m)
    return w / np.linalg.norm(w)


def loss(w: np.ndarray, x: np.ndarray, y: np.ndarray, q: float, cfg: Config, x_tau: np.ndarray | None = None, w0: np.ndarray | None = None) -> float:
    """Hinges of labelled scores against the quantile q and against the tau-th row, and the prior."""
    return _terms(w, x, y, q, cfg, x_tau, w0)[0]


def gradient(w: np.ndarray, x: np.ndarray, y: np.ndarray, q: float, cfg: Config, x_tau: np.ndarray | None = None, w0: np.ndarray | None = None) -> np.ndarray:
    return _terms(w, x, y, q, cfg, x_tau, w0)[1]


def _terms(w, x, y, q, cfg, x_tau, w0):
    s = x @ w
    value, slope = 0.0, np.zeros_like(w)
    for label, weight, sign in ((1, cfg.ca, 1.0), (0, cfg.cn, -1.0)):
        own = y == label
        if not own.any():
            continue
        goals = [(q, None, weight)] + ([(float(x_tau @ w), x_tau, cfg.cx)] if x_tau is not None else [])
        for goal, base, c in goals:
            short = sign * (goal - s[own])
            bad = short > 0 if label else short >= 0
            value += c * np.maximum(short, 0).mean()
            step = -sign * x[own][bad].sum(0)
            if base is not None:
                step = step + sign * bad.sum() * base
            slope += c * step / own.sum()
    if cfg.prior and w0 is not None:
        value += ((w - w0) ** 2).sum() / (2 * cfg.sigma2)
        slope += (w - w0) / cfg.sigma2
    return value, slope


def rmsprop(w: np.ndarray, f: Callable, g: Callable, rate: float = 0.001, epochs: int = 1000, decay: float = 0.9, eps: float = 1e-6) -> np.ndarray:
    """Minimise by RMSProp and return the best weights met."""
    best, low, mean, past = w, f(w), np.zeros_like(w), []
    for _ in range(epochs):
        d = g(w)
        mean = decay * mean + (1 - decay) * d * d
        w = w - rate * d / np.sqrt(mean + 1e-8)
        value = f(w)
        if not np.isfinite(value):
            raise FloatingPointError("the loss is no number")
        if value < low:
            best, low = w, value
        past.append(value)
        if value < eps or (len(past) > 20 and abs(past[-1] - np.mean(past[-20:])) < eps):
            break
    return best


def update(w: np.ndarray, x: np.ndarray, y: np.ndarray, q: float, cfg: Config, x_tau=None, w0=None) -> np.ndarray:
    """New unit weights after feedback."""
    out = rmsprop(w, lambda v: loss(v, x, y, q, cfg, x_tau, w0), lambda v: gradient(v, x, y, q, cfg, x_tau, w0), cfg.rate, cfg.epochs)
    n = np.linalg.norm(out)
    return out / n if n else out


@dataclass
class State:
    """What a session knows: weights, and ids with labels in the order they were asked."""

    w: np.ndarray
    asked: list[int] = field(default_factory=list)
    labels: list[int] = field(default_factory=list)
    history: list[dict] = field(default_factory=list)


class Session:
    """Feedback over a forest's leaves (or all its nodes' values given as ``values``)."""

    def __init__(self, rows: DataFrame, model: forest.Model, values: np.ndarray, cfg: Config | None = None, query: str = "top", id_col: str = "id", weights: np.ndarray | None = None):
        self.cfg, self.rows, self.model, self.id_col, self.query = cfg or Config(), rows, model, id_col, query
        n = np.linalg.norm(values)
        self.values = values / n if n else values
        self.start = uniform_weights(len(values)) if weights is None else weights
        self.state = State(self.start.copy())

    def scored(self) -> DataFrame:
        return forest.score(self.rows, self.model, self.values * self.state.w * len(self.model.roots))

    def members(self, rows: list) -> np.ndarray:
        """Member values of a few rows on the driver."""
        x = np.array([[r[f] for f in self.model.features] for r in rows], float)
        out = np.zeros((len(rows), len(self.values)))
        at = self.model.leaves(x)
        np.put_along_axis(out, at, self.values[at], 1)
        return out

    def step(self, label_of: Callable[[int], int]) -> list[int]:
        """Ask the next rows, learn from all labels so far; the ids asked."""
        asked = self.rows.sparkSession.createDataFrame([(i,) for i in self.state.asked], f"`{self.id_col}` long")
        scored = self.scored().persist()
        try:
            fresh = scored.join(F.broadcast(asked), self.id_col, "left_anti")
            found = STRATEGIES[self.query](fresh, self).collect()  # a batch
            if not found:
                return []
            self.state.asked += [int(r[self.id_col]) for r in found]
            self.state.labels += [int(label_of(int(r[self.id_col]))) for r in found]
            q = float(quantile_values(scored, "score", [1 - self.cfg.tau])[0])
            tau_row = scored.where(F.col("score") <= q).orderBy(F.col("score").desc(), self.id_col).limit(1).collect()
        finally:
            scored.unpersist()
        mine = self.rows.join(F.broadcast(self.rows.sparkSession.createDataFrame([(i,) for i in self.state.asked], f"`{self.id_col}` long")), self.id_col).collect()
        place = {int(r[self.id_col]): r for r in mine}
        x = self.members([place[i] for i in self.state.asked])
        self.state.w = update(self.state.w, x, np.array(self.state.labels), q, self.cfg, self.members(tau_row)[0], self.start)
        self.state.history.append({"asked": len(self.state.asked), "found": sum(self.state.labels), "q_tau": q})
        return [int(r[self.id_col]) for r in found]

    def run(self, label_of: Callable[[int], int], listener: Callable | None = None) -> State:
        while len(self.state.asked) < self.cfg.budget:
            if not self.step(label_of):
                break
            if listener:
                listener(self.state)
        return self.state


def ask_top(fresh: DataFrame, session: Session) -> DataFrame:
    return fresh.orderBy(F.col("score").desc(), session.id_col).limit(session.cfg.batch)


def ask_top_random(fresh: DataFrame, session: Session) -> DataFrame:
    best = fresh.orderBy(F.col("score").desc(), session.id_col).limit(session.cfg.explore)
    return best.orderBy(arithmetic_order(session.id_col, session.cfg.seed + len(session.state.asked))).limit(session.cfg.batch)


def ask_random(fresh: DataFrame, session: Session) -> DataFrame:
    return fresh.orderBy(arithmetic_order(session.id_col, session.cfg.seed), session.id_col).limit(session.cfg.batch)


def ask_quantile(fresh: DataFrame, session: Session) -> DataFrame:
    """Rows nearest to the quantile of the unasked."""
    q = quantile_values(fresh, "score", [1 - session.cfg.tau])[0]
    return fresh.orderBy(F.abs(F.col("score") - F.lit(q)), session.id_col).limit(session.cfg.batch)


def ask_diverse(fresh: DataFrame, session: Session) -> DataFrame:
    """Of the ``explore`` best rows, those that lie far from each other."""
    best = fresh.orderBy(F.col("score").desc(), session.id_col).limit(session.cfg.explore)
    rows = best.withColumn("__x", F.array(*(F.col(f).cast("double") for f in session.model.features)))
    return greedy_diverse(rows, "__x", session.cfg.batch, session.id_col).drop("__x", "pick")


STRATEGIES: dict[str, Callable] = {"top": ask_top, "top_random": ask_top_random, "random": ask_random, "quantile": ask_quantile, "diverse": ask_diverse}


def greedy_diverse(best: DataFrame, x: str, n: int, id_col: str = "id", score: str = "score") -> DataFrame:
    """``n`` of a few candidates with ``pick``: the best first, then always the one whose least squared distance to those picked is largest."""
    picked = best.orderBy(F.col(score).desc(), id_col).limit(1).withColumn("pick", F.lit(0))
    for k in range(1, n):
        rest = best.join(picked.select(id_col), id_col, "left_anti")
        near = rest.join(F.broadcast(picked.select(F.col(x).alias("__p")))).groupBy(id_col).agg(F.min(squared_distance(F.col(x), F.col("__p"))).alias("__d"))
        nxt = rest.join(near, id_col).orderBy(F.col("__d").desc(), F.col(score).desc(), id_col).limit(1).drop("__d").withColumn("pick", F.lit(k))
        picked = picked.unionByName(nxt)
    return picked


def linear_loss(members: DataFrame, weights: DataFrame, q: float, ca: float = 1.0, cn: float = 1.0) -> DataFrame:
    """``loss`` at fixed weights from ``id, member, value, y``: means of the two hinges."""
    s = members.join(F.broadcast(weights), "member").groupBy("id", "y").agg(F.sum(F.col("value") * F.col("w")).alias("s"))
    short = F.when(F.col("y") == 1, ca * F.greatest(F.lit(0.0), q - F.col("s"))).otherwise(cn * F.greatest(F.lit(0.0), F.col("s") - q))
    return s.withColumn("l", short).groupBy("y").agg(F.avg("l").alias("l")).agg(F.sum("l").alias("loss"))


def linear_gradient(members: DataFrame, weights: DataFrame, q: float, ca: float = 1.0, cn: float = 1.0) -> DataFrame:
    """``member, g`` at fixed weights."""
    rows = members.join(F.broadcast(weights), "member")
    s = rows.groupBy("id", "y").agg(F.sum(F.col("value") * F.col("w")).alias("s"))
    n = s.groupBy("y").agg(F.count(F.lit(1)).alias("n"))
    bad = s.where(((F.col("y") == 1) & (F.col("s") < q)) | ((F.col("y") == 0) & (F.col("s") >= q))).join(F.broadcast(n), "y")
    sign: Column = F.when(F.col("y") == 1, -ca).otherwise(cn)
    return members.select("id", "member", "value").join(bad, "id").groupBy("member").agg(F.sum(sign * F.col("value") / F.col("n")).alias("g"))


def weighted_summary(members: DataFrame, weights: DataFrame) -> DataFrame:
    """``id, score, variance`` of w x over members that are not 0."""
    v = F.col("value") * F.col("w")
    return members.where("value <> 0").join(F.broadcast(weights), "member").groupBy("id").agg(F.sum(v).alias("score"), F.var_pop(v).alias("variance"))


def least_overlap(memberships: DataFrame, order: DataFrame, n: int) -> list[int]:
    """``n`` of a few candidates: the best first, then always the row that shares fewest regions with those picked.

    ``memberships`` has ``id, region`` of the candidates, ``order`` their ``id, score``.
    """
    regions: dict[int, set] = {r.id: set(r.regions) for r in memberships.groupBy("id").agg(F.collect_set("region").alias("regions")).collect()}
    left = [r.id for r in order.orderBy(F.col("score").desc(), "id").collect()]
    picked, seen = [], set()
    while left and len(picked) < n:
        k = min(left, key=lambda i: (len(regions.get(i, set()) & seen), left.index(i)))
        left.remove(k)
        picked.append(k)
        seen |= regions.get(k, set())
    return picked


def estimated_quantile(members: DataFrame, names: list[str], tau: float, tries: int = 50, seed: int = 42) -> DataFrame:
    """``q, low, high`` of scores pooled over random unit weights for members ``names``."""
    rng = np.random.default_rng(seed)
    w = rng.normal(size=(tries, len(names)))
    w /= np.linalg.norm(w, axis=1, keepdims=True)
    table = members.sparkSession.createDataFrame([(t, m, float(w[t, k])) for t in range(tries) for k, m in enumerate(names)], "try int, member string, w double")
    scores = members.join(F.broadcast(table), "member").groupBy("try", "id").agg(F.sum(F.col("value") * F.col("w")).alias("s"))
    q, low, high = quantile_values(scores, "s", [1 - tau, 0.0, 1.0])
    return members.sparkSession.createDataFrame([(q, low, high)], "q double, low double, high double")


def from_scores(rows: DataFrame, scores: str, id_col: str = "id") -> DataFrame:
    """``id, member, value`` of an ensemble whose scores are already there as an array."""
    return rows.select(F.col(id_col).alias("id"), F.posexplode(scores).alias("member", "value"))


def confident(summary: DataFrame, tau: float, width: float = 3.0) -> DataFrame:
    """``summary`` (id, score, variance) with ``sure``: the score less some deviations still tops the tau quantile."""
    q = quantile_values(summary, "score", [1 - tau])[0]
    return summary.withColumn("sure", F.col("score") - width * F.sqrt("variance") >= F.lit(q))
