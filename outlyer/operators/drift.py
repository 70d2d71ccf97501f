"""Drift of a forest's node distributions: counts, KL divergence, thresholds, replacement."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def leaf_distribution(leaves: DataFrame, regions: DataFrame, delta: float = 1e-16) -> DataFrame:
    """``tree, node, p``: shares of rows per leaf, each leaf with delta / leaves added.

    ``leaves`` has ``tree, node`` a row and tree; ``regions`` lists all leaves.
    """
    counts = leaves.groupBy("tree", "node").agg(F.count(F.lit(1)).alias("c"))
    full = regions.select("tree", "node").distinct().join(counts, ["tree", "node"], "left")
    w = Window.partitionBy("tree")
    share = F.coalesce("c", F.lit(0)) / F.greatest(F.lit(1), F.sum(F.coalesce("c", F.lit(0))).over(w)) + delta / F.count(F.lit(1)).over(w)
    full = full.withColumn("s", share)
    return full.select("tree", "node", (F.col("s") / F.sum("s").over(w)).alias("p"))


def divergence(p: DataFrame, q: DataFrame) -> DataFrame:
    """``tree, kl``: sum p (log p - log q)."""
    both = p.join(q.withColumnRenamed("p", "q"), ["tree", "node"])
    return both.groupBy("tree").agg(F.sum(F.col("p") * (F.log("p") - F.log("q"))).alias("kl"))


def normalised_divergence(p: DataFrame, q: DataFrame) -> DataFrame:
    """``tree, kl, worst, ratio``: KL over that of p in rising against falling order."""
    up = p.withColumn("k", F.row_number().over(Window.partitionBy("tree").orderBy("p", "node")))
    down = p.withColumn("k", F.row_number().over(Window.partitionBy("tree").orderBy(F.col("p").desc(), "node"))).select("tree", "k", F.col("p").alias("q"))
    worst = up.join(down, ["tree", "k"]).groupBy("tree").agg(F.sum(F.col("p") * (F.log("p") - F.log("q"))).alias("worst"))
    return divergence(p, q).join(worst, "tree").withColumn("ratio", F.when(F.col("worst") > 0, F.col("kl") / F.col("worst")).otherwise(0.0))


def threshold(kls: DataFrame, alpha: float = 0.05) -> DataFrame:
    """``threshold``: the 1 - alpha quantile of the trees' divergences."""
    return kls.agg(F.percentile("kl", F.lit(1 - alpha)).alias("threshold"))


def trees_to_replace(kls: DataFrame, limit: DataFrame) -> DataFrame:
    return kls.crossJoin(F.broadcast(limit)).where(F.col("kl") > F.col("threshold")).select("tree", "kl")  # one row


def blended_counts(old: DataFrame, buffer: DataFrame, weight: float | None = None) -> DataFrame:
    """``tree, node, n``: the buffer's counts, or (1 - weight) old + weight buffer."""
    both = old.select("tree", "node", F.col("n").alias("o")).join(buffer.select("tree", "node", F.col("n").alias("b")), ["tree", "node"], "full")
    o, b = F.coalesce("o", F.lit(0)).cast("double"), F.coalesce("b", F.lit(0)).cast("double")
    return both.select("tree", "node", (b if weight is None else (1 - weight) * o + weight * b).alias("n"))


def replace_trees(forest: DataFrame, dropped: DataFrame, grown: DataFrame) -> DataFrame:
    """The forest without dropped trees and with new ones, whose numbers must be free."""
    return forest.join(F.broadcast(dropped.select("tree")), "tree", "left_anti").unionByName(grown)


def tau_again(anomalies: int, seen: int, tau: float) -> float:
    """The known share of anomalies and 0.01 where it reaches tau, else tau."""
    share = anomalies / seen if seen else 0.0
    return share + 0.01 if share >= tau else tau
