"""Random split forests as tables: building, routing, regions, scores.

A forest is a DataFrame with a row per node: ``tree, node, left, right, feature, threshold, n,
depth, log_vol``; a leaf has left = -1. Each tree grows in its own task from a bounded sample
of its own, so any number of trees grows in parallel; the forest is a model of bounded size
(``trees * 2 ** (depth + 1)`` nodes at most), which is broadcast to score rows in one scan.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from outlyer.functions.ranking import arithmetic_order
from outlyer.functions.tables import written
from outlyer.functions.vectors import average_path_length

NODES = "tree int, node int, left int, right int, feature int, threshold double, n long, depth int, log_vol double"
KINDS = ("isolation", "half_space", "rs")


def grow(x: np.ndarray, kind: str, depth: int, rng: np.random.Generator, offset: int = 0) -> list[tuple]:
    """Nodes of one tree over the rows of ``x``; features are numbered from ``offset``.

    Isolation trees split at random inside the node's rows. Half-space trees split the middle of
    a randomly enlarged box to full depth, RS trees at a random part of it.
    """
    low, high = x.min(0), x.max(0)
    if kind == "half_space":
        s = rng.uniform(size=x.shape[1])
        reach = 2 * np.maximum(s, 1 - s)
        low, high = low + (high - low) * (s - reach), low + (high - low) * (s + reach)
    nodes: list[list] = []
    todo = [(np.arange(len(x)), low, high, 0, -1, 0, 0.0)]
    while todo:
        rows, lo, hi, level, parent, side, log_vol = todo.pop()
        me = len(nodes)
        nodes.append([me, -1, -1, -1, 0.0, len(rows), level, log_vol])
        if parent >= 0:
            nodes[parent][1 + side] = me
        wide = np.flatnonzero((x[rows].max(0) > x[rows].min(0)) if kind == "isolation" and len(rows) else hi > lo)
        if level >= depth or not len(wide) or (kind == "isolation" and len(rows) < 2):
            continue
        f = int(rng.choice(wide))
        a, b = (x[rows, f].min(), x[rows, f].max()) if kind == "isolation" else (lo[f], hi[f])
        part = 0.5 if kind == "half_space" else rng.uniform(0.02, 0.98)
        cut = a + (b - a) * part
        share = (cut - lo[f]) / (hi[f] - lo[f]) if hi[f] > lo[f] else 0.5
        nodes[me][3], nodes[me][4] = f + offset, float(cut)
        left, right = rows[x[rows, f] <= cut], rows[x[rows, f] > cut]
        upper, lower = hi.copy(), lo.copy()
        upper[f] = lower[f] = cut
        todo.append((right, lower, hi, level + 1, me, 1, log_vol + np.log(max(1e-12, 1 - share))))
        todo.append((left, lo, upper, level + 1, me, 0, log_vol + np.log(max(1e-12, share))))
    return [tuple(n) for n in nodes]


def fit(rows: DataFrame, features: list[str], kind: str = "isolation", trees: int = 100, samples: int = 256, depth: int = 15, seed: int = 42, views: list[int] | None = None, first: int = 0, id_col: str = "id") -> DataFrame:
    """A forest over ``features``. ``views`` cuts them into slices, and trees are dealt to slices in turn.

    Each tree draws ``samples`` rows of its own, without putting back, from a pool of ``trees * samples`` rows at
    most; both draws go by hashes of the id, and of tree and id. A row may be in many trees.
    """
    if kind not in KINDS:
        raise ValueError(kind)
    slices, at = [], 0
    for size in views or [len(features)]:
        slices.append((at, size))
        at += size
    pool = rows.select(id_col, *(F.col(f).cast("double") for f in features)).dropna().orderBy(arithmetic_order(id_col, seed), id_col).limit(trees * samples)
    pool = written(pool, "pool")
    keyed = pool.select("*", F.explode(F.sequence(F.lit(first), F.lit(first + trees - 1))).alias("tree")).withColumn("__key", F.xxhash64(F.lit(seed), "tree", id_col))
    # the lowest hashes of a tree lie in this share of all, far more than enough of them
    share = min(1.0, 2 * samples / max(1, pool.count()))
    keyed = keyed.where(F.pmod(F.col("__key"), F.lit(1_000_000)) < share * 1_000_000)
    lowest = Window.partitionBy("tree").orderBy(F.pmod(F.col("__key"), F.lit(1_000_000)), "__key", id_col)  # twice the samples
    dealt = keyed.withColumn("__k", F.row_number().over(lowest)).where(F.col("__k") <= samples).drop("__k", "__key")

    def one(g: pd.DataFrame) -> pd.DataFrame:
        tree = int(g.tree.iloc[0])
        offset, size = slices[tree % len(slices)]
        x = g.sort_values(id_col)[features[offset : offset + size]].to_numpy(float)
        nodes = grow(x, kind, depth, np.random.default_rng((seed, tree)), offset)
        return pd.DataFrame([(tree, *n) for n in nodes], columns=["tree", "node", "left", "right", "feature", "threshold", "n", "depth", "log_vol"])

    return dealt.groupBy("tree").applyInPandas(one, NODES)


@dataclass
class Model:
    """A forest's nodes as arrays on end; children and roots point into them."""

    features: list[str]
    trees: np.ndarray
    roots: np.ndarray
    tree: np.ndarray
    node: np.ndarray
    left: np.ndarray
    right: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    n: np.ndarray
    depth: np.ndarray
    log_vol: np.ndarray

    @classmethod
    def of(cls, forest: DataFrame, features: list[str]) -> Model:
        """The forest's nodes, which are a model of bounded size, on the driver."""
        t = forest.toPandas().sort_values(["tree", "node"]).reset_index(drop=True)
        first = t.groupby("tree").apply(lambda g: g.index[0], include_groups=False)
        place = {(a, b): k for k, (a, b) in enumerate(zip(t.tree, t.node, strict=True))}
        to = lambda c: np.array([place.get((a, b), -1) for a, b in zip(t.tree, t[c], strict=True)])
        return cls(features, first.index.to_numpy(), first.to_numpy(), *(t[c].to_numpy() for c in ("tree", "node")), to("left"), to("right"), *(t[c].to_numpy() for c in ("feature", "threshold", "n", "depth", "log_vol")))

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """Places of each row's leaf, a column a tree; rows equal to a threshold go left."""
        at = np.repeat(self.roots[None, :], len(x), 0)
        rows = np.arange(len(x))[:, None]
        while True:
            inner = self.left[at] >= 0
            if not inner.any():
                return at
            f = np.where(inner, self.feature[at], 0)
            goes = np.where(x[rows, f] <= self.threshold[at], self.left[at], self.right[at])
            at = np.where(inner, goes, at)

    def region_scores(self, kind: str, samples: int) -> np.ndarray:
        """A score of each node, higher for the more anomalous."""
        length = np.maximum(1, self.depth).astype(float)
        if kind == "inverse_length":
            return 1 / length
        if kind == "power_length":
            return 2.0**-length
        if kind == "constant":
            return np.full(len(length), -1.0)
        if kind == "negative_length":
            return -length
        if kind == "half_space_log":
            return -np.log(np.maximum(1e-12, (self.n + 1) / (samples + 1) * 2.0 ** (length - 1)))
        if kind == "rs_log":
            return -(np.log(np.maximum(1, self.n) / samples) - self.log_vol)
        raise ValueError(kind)


def _arrays(parts: list[pd.Series]) -> np.ndarray:
    return np.column_stack([p.to_numpy(float) for p in parts])


def route(rows: DataFrame, model: Model) -> DataFrame:
    """``rows`` with ``leaves``: for each tree, in the order of the model, the node that a row ends in."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("array<int>")
    def leaf_nodes(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        m = shared.value
        for p in parts:
            yield pd.Series(list(m.node[m.leaves(_arrays(list(p)))].astype(np.int32)), dtype=object)

    return rows.withColumn("leaves", leaf_nodes(*(F.col(f).cast("double") for f in model.features)))


def score(rows: DataFrame, model: Model, values: np.ndarray, out: str = "score") -> DataFrame:
    """``rows`` with the mean of ``values`` (one a node) over each row's leaves."""
    shared = rows.sparkSession.sparkContext.broadcast((model, values))

    @F.pandas_udf("double")
    def mean(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        m, v = shared.value
        for p in parts:
            yield pd.Series(v[m.leaves(_arrays(list(p)))].mean(1), dtype=float)

    return rows.withColumn(out, mean(*(F.col(f).cast("double") for f in model.features)))


def isolation_values(model: Model, samples: int) -> np.ndarray:
    """Path length of each node, corrected for the rows it holds, so that score = 2 ** (-mean / c)."""
    from outlyer.functions.vectors import path_length

    extra = np.array([0.0 if k <= 1 else path_length(k) for k in range(int(model.n.max()) + 1)])
    return model.depth + extra[model.n]


def isolation_score(rows: DataFrame, model: Model, samples: int = 256) -> DataFrame:
    """``rows`` with ``score`` in 0..1, higher for the more anomalous."""
    c = average_path_length(F.lit(samples))
    return score(rows, model, isolation_values(model, samples), "__h").withColumn("score", F.pow(F.lit(2.0), -F.col("__h") / c)).drop("__h")


def half_space_score(rows: DataFrame, model: Model) -> DataFrame:
    """Mean of n 2 ** depth at the leaves; the lower the more anomalous."""
    return score(rows, model, model.n * 2.0 ** (model.depth + 1))


def rs_score(rows: DataFrame, model: Model) -> DataFrame:
    """Mean density n exp(-log volume) at the leaves; the lower the more anomalous."""
    return score(rows, model, model.n * np.exp(-model.log_vol))


def leaf_features(routed: DataFrame, trees: Column, id_col: str = "id") -> DataFrame:
    """``id, tree, node`` of the leaves, in long form."""
    return routed.select(id_col, F.posexplode("leaves").alias("at", "node")).withColumn("tree", F.element_at(trees, F.col("at") + 1)).select(id_col, "tree", "node")


def regions(forest: DataFrame, features: list[str], leaf_only: bool = True) -> DataFrame:
    """``tree, node, region, path_length, n, log_vol`` and ``lo_f, hi_f`` (null: no bound) of the nodes."""

    def boxes(g: pd.DataFrame) -> pd.DataFrame:
        nodes = {int(r.node): r for r in g.itertuples()}
        out, todo = [], [(0, {})]
        while todo:
            k, box = todo.pop()
            r = nodes[k]
            leaf = r.left < 0
            if leaf or (not leaf_only and k):
                bounds = [box.get(f, (None, None)) for f in range(len(features))]
                out.append((int(r.tree), k, f"{int(r.tree)}:{k}", max(1, int(r.depth)), int(r.n), float(r.log_vol), *(b[0] for b in bounds), *(b[1] for b in bounds)))
            if not leaf:
                f, lo, hi = int(r.feature), *box.get(int(r.feature), (None, None))
                todo.append((int(r.right), {**box, f: (r.threshold, hi)}))
                todo.append((int(r.left), {**box, f: (lo, r.threshold)}))
        names = ["tree", "node", "region", "path_length", "n", "log_vol", *(f"lo_{f}" for f in features), *(f"hi_{f}" for f in features)]
        frame = pd.DataFrame(out, columns=names)
        return frame.astype({c: float for c in names[6:]})

    schema = "tree int, node int, region string, path_length int, n long, log_vol double, " + ", ".join(f"lo_{f} double" for f in features) + ", " + ", ".join(f"hi_{f} double" for f in features)
    out = forest.groupBy("tree").applyInPandas(boxes, schema)
    clean = [F.when(~F.isnan(c), F.col(c)).alias(c) for c in (f"{e}_{f}" for e in ("lo", "hi") for f in features)]
    return out.select("tree", "node", "region", "path_length", "n", "log_vol", *clean)


def region_score(kind: str, samples: int) -> Column:
    """A region's score from ``path_length, n, log_vol``, higher for the more anomalous."""
    length, n = F.col("path_length").cast("double"), F.col("n").cast("double")
    return {
        "inverse_length": 1 / length,
        "power_length": F.pow(F.lit(2.0), -length),
        "constant": F.lit(-1.0),
        "negative_length": -length,
        "half_space_log": -F.log((n + 1) / (samples + 1) * F.pow(F.lit(2.0), length - 1)),
        "rs_log": -(F.log(F.greatest(n, F.lit(1.0)) / samples) - F.col("log_vol")),
    }[kind]


def path_nodes(routed: DataFrame, forest: DataFrame, trees: Column, id_col: str = "id") -> DataFrame:
    """``id, tree, node`` of every node on the way to the leaves: a join with the leaves' ancestors."""

    def climb(g: pd.DataFrame) -> pd.DataFrame:
        parent = {c: r.node for r in g.itertuples() if r.left >= 0 for c in (r.left, r.right)}
        out = []
        for leaf in g.node[g.left < 0]:
            k = leaf
            while k is not None:
                out.append((int(g.tree.iloc[0]), int(leaf), int(k)))
                k = parent.get(k)
        return pd.DataFrame(out, columns=["tree", "leaf", "node"])

    way = forest.groupBy("tree").applyInPandas(climb, "tree int, leaf int, node int")
    return leaf_features(routed, trees, id_col).withColumnRenamed("node", "leaf").join(F.broadcast(way), ["tree", "leaf"]).select(id_col, "tree", "node")


def from_decision_tree(model, features: list[str], tree: int = 0) -> list[tuple]:
    """Nodes of an MLlib decision tree, its leaves' share of label 1 in place of log_vol."""
    out = []

    def walk(node, depth):
        me = len(out)
        out.append(None)
        stats = list(node.impurityStats().stats())
        share = stats[1] / max(1e-12, sum(stats))
        if node.numDescendants() == 0:
            out[me] = (tree, me, -1, -1, -1, 0.0, int(sum(stats)), depth, float(share))
        else:
            split = node.split()
            left, right = walk(node.leftChild(), depth + 1), walk(node.rightChild(), depth + 1)
            out[me] = (tree, me, left, right, int(split.featureIndex()), float(split.threshold()), int(sum(stats)), depth, float(share))
        return me

    walk(model._java_obj.rootNode(), 0)
    return out
