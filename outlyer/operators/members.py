"""Feedback over any ensemble that is a long table ``id, member, value``: forests, projections, given scores.

Rows are scored by a join with the weights and one sum an id. Weights are one number for all members
that no labelled row has, and a table of the others, so they are as many as the analyst's labels reach and
not as the ensemble has members; the small optimisation over them runs on the driver.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from outlyer.functions.tables import written
from outlyer.operators import active, describe, forest, loda
from outlyer.operators.active import Config
from outlyer.operators.metrics import auc, quantile_values


@dataclass(frozen=True)
class Weights:
    """Unit weights of ``n`` members: those ``known`` by name, and ``other`` for each of the rest."""

    n: int
    other: float
    known: dict[str, float] = field(default_factory=dict)

    @classmethod
    def uniform(cls, n: int) -> Weights:
        return cls(n, 1 / np.sqrt(max(1, n)))

    def of(self, names: list[str]) -> np.ndarray:
        return np.array([self.known.get(m, self.other) for m in names], float)

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(m, float(w)) for m, w in self.known.items()], "member string, w double")


def forest_members(rows: DataFrame, model: forest.Model, values: np.ndarray, id_col: str = "id") -> DataFrame:
    """``id, member, value``: a row's leaf in each tree with the node's value; a member is ``tree:node``."""
    spark = rows.sparkSession
    trees = F.array(*(F.lit(int(t)) for t in model.trees))
    nodes = spark.createDataFrame([(int(t), int(k), float(v)) for t, k, v in zip(model.tree, model.node, values, strict=True)], "tree int, node int, value double")
    leaves = forest.leaf_features(forest.route(rows, model), trees, id_col)
    return leaves.join(F.broadcast(nodes), ["tree", "node"]).select(F.col(id_col).alias("id"), F.concat_ws(":", "tree", "node").alias("member"), "value")


def loda_members(rows: DataFrame, proj: DataFrame, hist: DataFrame, x: str = "x", id_col: str = "id") -> DataFrame:
    """``id, member, value``: minus the log density on each projection."""
    names = F.array(*(F.lit(str(r.proj)) for r in proj.join(hist, "proj").select("proj").orderBy("proj").collect()))  # a model
    found = loda.log_densities(rows.select(id_col, x), proj, hist, x)
    return found.select(F.col(id_col).alias("id"), F.posexplode("logp").alias("k", "logp")).select("id", F.element_at(names, F.col("k") + 1).alias("member"), (-F.col("logp")).alias("value"))


def loda_values(rows: DataFrame, features: list[str], seed: int = 42, **settings) -> tuple[DataFrame, int]:
    """``rows`` with ``values``, an entry a member by name, of newly fitted projections (:func:`ensemble`), and how many members there are."""
    rows = rows.withColumn("__x", F.array(*(F.col(f).cast("double") for f in features)))
    proj, hist = loda.fit(rows.select("__x"), len(features), x="__x", seed=seed, **settings)
    n = hist.count()
    by_name = sorted(range(n), key=str)
    values = F.array(*(-F.col("logp")[k] for k in by_name))
    return loda.log_densities(rows, proj, hist, "__x").withColumn("values", values).drop("__x", "logp"), n


def score_members(rows: DataFrame, names: list[str], id_col: str = "id") -> DataFrame:
    """``id, member, value`` of scores that the rows already have, a column each."""
    pairs = F.array(*(F.struct(F.lit(c).alias("member"), F.col(c).cast("double").alias("value")) for c in names))
    return rows.select(F.col(id_col).alias("id"), F.explode(pairs).alias("m")).select("id", "m.member", "m.value")


#: How each kind of forest values its leaves.
LEAF_VALUES = {"isolation": "inverse_length", "half_space": "half_space_log", "rs": "rs_log"}


def ensemble(kind: str, rows: DataFrame, features: list[str], id_col: str = "id", seed: int = 42, **settings) -> tuple[DataFrame, int]:
    """The member table of a newly fitted ensemble by name, and how many members it has.

    ``isolation``, ``half_space``, ``rs`` (settings of ``forest.fit``; with ``views`` a multiview forest), ``loda``
    (of ``loda.fit``) and ``scores`` (``features`` are the scores).
    """
    if kind == "scores":
        return score_members(rows, features, id_col), len(features)
    if kind == "loda":
        vectors = rows.select(id_col, F.array(*(F.col(f).cast("double") for f in features)).alias("x"))
        proj, hist = loda.fit(vectors, len(features), seed=seed, **settings)
        hist = written(hist, "histograms")  # a model, read in each round
        return loda_members(vectors, proj, hist, "x", id_col), hist.count()
    samples = settings.get("samples", 256)
    model = forest.Model.of(written(forest.fit(rows, features, kind, seed=seed, id_col=id_col, **settings), "forest"), features)
    values = model.region_scores(LEAF_VALUES[kind], samples)
    return forest_members(rows, model, values / (np.linalg.norm(values) or 1.0), id_col), int((model.left < 0).sum())


def summary(members: DataFrame, weights: Weights) -> DataFrame:
    """``id, score, variance``: the weighted sum and the variance of its terms that are not 0."""
    table = members
    w = F.lit(float(weights.other))
    if weights.known:
        table = members.join(F.broadcast(weights.table(members.sparkSession)), "member", "left")  # as many as labels reach
        w = F.coalesce(F.col("w"), w)
    v = F.col("value") * w
    return table.groupBy("id").agg(F.sum(v).alias("score"), F.coalesce(F.var_pop(F.when(F.col("value") != 0, v)), F.lit(0.0)).alias("variance"))


def vectors(members: DataFrame, ids: list[int]) -> tuple[list[str], np.ndarray]:
    """Member names and values of a few rows, in the order of ``ids``; as large as the labels are many."""
    few = members.sparkSession.createDataFrame([(k, int(i)) for k, i in enumerate(ids)], "k int, id long")
    found = members.join(F.broadcast(few), "id").select("k", "member", "value").collect()
    names = sorted({r.member for r in found})
    at = {m: k for k, m in enumerate(names)}
    x = np.zeros((len(ids), len(names)))
    for r in found:
        x[r.k, at[r.member]] = r.value
    return names, x


def learn(weights: Weights, start: Weights, names: list[str], x: np.ndarray, y: np.ndarray, q: float, cfg: Config, x_tau: np.ndarray | None = None) -> Weights:
    """Unit weights after feedback on rows ``x`` over ``names``, near ``start`` where the prior is used.

    Members that no labelled row has move alike, so they are one coordinate that counts as often as they are.
    """
    names = [*names, *(m for m in weights.known if m not in set(names))]
    wide = lambda v: np.concatenate([v, np.zeros((*v.shape[:-1], len(names) - v.shape[-1]))], -1)
    x, x_tau = wide(x), None if x_tau is None else wide(x_tau)
    times = np.array([1.0] * len(names) + [max(0, weights.n - len(names))])
    first, w0 = np.append(weights.of(names), weights.other), np.append(start.of(names), start.other)
    plain = replace(cfg, prior=False)

    def prior(v: np.ndarray) -> float:
        return float((times * (v - w0) ** 2).sum() / (2 * cfg.sigma2)) if cfg.prior else 0.0

    value = lambda v: active.loss(v[:-1], x, y, q, plain, x_tau) + prior(v)
    slope = lambda v: np.append(active.gradient(v[:-1], x, y, q, plain, x_tau), 0.0) + ((v - w0) / cfg.sigma2 if cfg.prior else 0.0)
    out = active.rmsprop(first, value, slope, cfg.rate, cfg.epochs)
    size = np.sqrt((times * out**2).sum()) or 1.0
    return Weights(weights.n, float(out[-1] / size), {m: float(v / size) for m, v in zip(names, out[:-1], strict=True)})


def at_quantile(scored: DataFrame, tau: float) -> tuple[float, int | None]:
    """The score that the share tau lies above, and the best row at it or below."""
    q = float(quantile_values(scored, "score", [1 - tau])[0])
    row = scored.where(F.col("score") <= q).orderBy(F.col("score").desc(), "id").limit(1).collect()
    return q, row[0].id if row else None


@dataclass
class State:
    w: Weights
    asked: list[int] = field(default_factory=list)
    labels: list[int] = field(default_factory=list)
    history: list[dict] = field(default_factory=list)


class Session:
    """Rounds of asking and learning over a member table, which is written once; each round scores it once."""

    id_col = "id"

    def __init__(self, members: DataFrame, n: int, cfg: Config | None = None, query: str = "top", weights: Weights | None = None, costs: DataFrame | None = None):
        self.cfg, self.query, self.costs = cfg or Config(), query, costs
        self.members = written(members, "members")
        self.start = weights or Weights.uniform(n)
        self.state = State(self.start)

    def step(self, label_of: Callable[[int], int]) -> list[int]:
        s = self.state
        scored = summary(self.members, s.w).persist()
        try:
            asked = scored.sparkSession.createDataFrame([(i,) for i in s.asked], "id long")
            fresh = scored.join(F.broadcast(asked), "id", "left_anti")
            found = [int(r.id) for r in STRATEGIES[self.query](fresh, self).select("id").collect()]  # a batch
            if not found:
                return []
            s.asked += found
            s.labels += [int(label_of(i)) for i in found]
            q, tau_id = at_quantile(scored, self.cfg.tau)
        finally:
            scored.unpersist()
        names, x = vectors(self.members, [*s.asked, tau_id])
        s.w = learn(s.w, self.start, names, x[:-1], np.array(s.labels), q, self.cfg, x[-1])
        s.history.append({"asked": len(s.asked), "found": sum(s.labels), "q_tau": q})
        return found

    def run(self, label_of: Callable[[int], int], listener: Callable | None = None) -> State:
        while len(self.state.asked) < self.cfg.budget and self.step(label_of):
            if listener:
                listener(self.state)
        return self.state


def subspace_diverse(best: DataFrame, memberships: DataFrame, costs: DataFrame, n: int) -> list[int]:
    """``n`` ids of the candidates ``best`` (``id, score``) that share few regions with each other.

    Regions are those of a compact cover of the candidates (``memberships``: id, region; ``costs``: region,
    volume), so that a region says where a row lies and not how deep. Candidates are few.
    """
    own = memberships.join(F.broadcast(best.select("id")), "id", "left_semi")
    chosen = describe.compact_regions(own, costs)
    return active.least_overlap(own.where(F.col("region").isin(chosen)), best, n)


def ask_subspace(fresh: DataFrame, session: Session) -> DataFrame:
    """Of the ``explore`` best rows those in different regions; a region costs what the session's ``costs`` say, or 1."""
    best = fresh.orderBy(F.col("score").desc(), "id").limit(session.cfg.explore).persist()
    table = session.members.select("id", F.col("member").alias("region"))
    costs = session.costs if session.costs is not None else table.join(F.broadcast(best.select("id")), "id", "left_semi").select("region", F.lit(1.0).alias("volume")).distinct()
    ids = subspace_diverse(best, table, costs, session.cfg.batch)
    best.unpersist()
    return fresh.where(F.col("id").isin(ids))


#: Queries that need scores, ids and members; "diverse" wants features, which a member table has not.
STRATEGIES: dict[str, Callable] = {k: f for k, f in active.STRATEGIES.items() if k != "diverse"} | {"subspace": ask_subspace}


def pretrain(members: DataFrame, labels: DataFrame, weights: Weights, cfg: Config, rounds: int = 10) -> tuple[Weights, list[float]]:
    """The best of ``rounds`` updates on given labels (``id, y``) by AUC over them, and the AUC before and after each.

    Only anomalies pull: all rows are labelled, so they need only come to the top. tau is their share.
    Without a label of each kind nothing is learnt.
    """
    known = written(members.join(F.broadcast(labels.select("id", "y")), "id"), "labelled")
    counts = {r.y: r.n for r in known.select("id", "y").distinct().groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts.get(1) or not counts.get(0):
        return weights, []
    ids = [r.id for r in labels.where("y = 1").select("id").distinct().orderBy("id").collect()]  # given labels
    cfg = replace(cfg, tau=counts[1] / (counts[0] + counts[1]))
    y, start, best, past = np.ones(len(ids)), weights, weights, []
    for k in range(rounds + 1):
        scored = summary(known.drop("y"), weights).join(F.broadcast(labels.select("id", "y")), "id").persist()
        # auc() takes low scores for anomalies
        past.append(float(auc(scored.select("id", (-F.col("score")).alias("score"), "y"), "score").first().auc))
        if past[-1] > max(past[:-1], default=-1.0):
            best = weights
        if k < rounds:
            q, tau_id = at_quantile(scored, cfg.tau)
            names, x = vectors(known, [*ids, tau_id])
            weights = learn(weights, start, names, x[:-1], y, q, cfg, x[-1])
        scored.unpersist()
    return best, past


def one_round(members: DataFrame, weights: DataFrame, tau: float, batch: int, digits: int = 8) -> DataFrame:
    """``id, score, q_tau`` of the rows that a round at given weights (``member, w``) asks first.

    Scores are rounded, so that the order in which terms were added decides no tie.
    """
    scored = active.weighted_summary(members, weights).select("id", F.round("score", digits).alias("score"))
    q = quantile_values(scored, "score", [1 - tau])[0]
    return scored.orderBy(F.col("score").desc(), "id").limit(batch).withColumn("q_tau", F.lit(q))
