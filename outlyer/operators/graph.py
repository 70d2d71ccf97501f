"""Graph learning over edge tables: normalisation, propagation, scores."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from outlyer.functions.ranking import arithmetic_order, scrambled_pair
from outlyer.functions.tables import written
from outlyer.functions.vectors import dot


def normalised(edges: DataFrame) -> DataFrame:
    """``src, dst, w`` with weights over the root of both ends' degrees."""
    degree = edges.groupBy("src").agg(F.sum("w").alias("d"))
    a, b = degree.toDF("src", "ds"), degree.toDF("dst", "dd")
    return edges.join(a, "src").join(b, "dst").select("src", "dst", (F.col("w") / F.sqrt(F.col("ds") * F.col("dd"))).alias("w"))


def propagate(edges: DataFrame, nodes: DataFrame, x: str = "x") -> DataFrame:
    """``id, x``: each node's weighted sum of its neighbours' vectors."""
    part = edges.join(nodes.select(F.col("id").alias("dst"), F.posexplode(x).alias("k", "v")), "dst")
    sums = part.groupBy(F.col("src").alias("id"), "k").agg(F.sum(F.col("w") * F.col("v")).alias("v"))
    # an entry a feature
    return sums.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("k", "v"))).alias("a")).select("id", F.transform("a", lambda s: s["v"]).alias(x))


def sample_edges(edges: DataFrame, share: float, seed: int = 42) -> DataFrame:
    """A share of the undirected edges, both directions; self loops stay."""
    one = edges.where("src < dst").withColumn("__k", scrambled_pair(F.col("src"), F.col("dst"), seed))
    kept = one.where(F.col("__k") < share * 2147483647).drop("__k")
    return kept.unionByName(kept.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")).unionByName(edges.where("src = dst"))


def smoothed(edges: DataFrame, nodes: DataFrame, layers: int = 2) -> DataFrame:
    """``member, id, x``: features propagated ``layers`` times over each member's edges (``member, src, dst, w``).

    All members go together, keyed by member and node: a layer is one join and one sum for all of them.
    """
    key = ["member", "src"]
    degree = edges.groupBy(*key).agg(F.sum("w").alias("d"))
    hat = edges.join(degree.withColumnRenamed("d", "ds"), key).join(degree.select("member", F.col("src").alias("dst"), F.col("d").alias("dd")), ["member", "dst"])
    hat = written(hat.select("member", "src", "dst", (F.col("w") / F.sqrt(F.col("ds") * F.col("dd"))).alias("w")), "hat")
    now = hat.select("member").distinct().join(nodes.select("id", "x"))  # members are few; a model's side
    width = max(1, nodes.agg(F.max(F.size("x"))).first()[0] or 0)
    for _ in range(layers):
        flat = now.where(F.size("x") > 0).select("member", F.col("id").alias("dst"), "x")
        # a column a feature, as a row a feature would be many times the edges
        sums = hat.join(flat, ["member", "dst"]).groupBy("member", F.col("src").alias("id")).agg(F.max(F.size("x")).alias("n"), *(F.sum(F.col("w") * F.get("x", F.lit(k))).alias(f"v{k}") for k in range(width)))
        now = sums.select("member", "id", F.slice(F.array(*(f"v{k}" for k in range(width))), F.lit(1), F.col("n")).alias("x"))
    return now


def member_edges(edges: DataFrame, members: int, share: float, seed: int = 42) -> DataFrame:
    """``member, src, dst, w``: for each member its own share of the undirected edges, both directions; self loops stay."""
    one = edges.where("src <= dst").select(F.explode(F.sequence(F.lit(0), F.lit(members - 1))).alias("member"), "src", "dst", "w")
    draw = scrambled_pair(F.col("src"), F.col("dst"), F.lit(seed) + F.col("member") * 7919)
    kept = one.where((F.col("src") == F.col("dst")) | (draw < share * 2147483647))
    return kept.unionByName(kept.where("src < dst").select("member", F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))


def linear_logits(rows: DataFrame, weights: np.ndarray, offsets: np.ndarray) -> DataFrame:
    """``rows`` with ``logits`` of the column ``x``, an entry a class; ``weights`` are classes by features."""
    out = [dot(F.col("x"), F.array(*map(F.lit, map(float, w)))) + F.lit(float(b)) for w, b in zip(weights, offsets, strict=True)]
    return rows.withColumn("logits", F.array(*out))


def fitted_logits(rows: DataFrame, classes: int, epochs: int = 100, regular: float = 1e-4) -> DataFrame:
    """``rows`` (``x``, and ``y`` or null) with ``logits`` of a softmax regression that MLlib fits where the rows are."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    train = rows.where("y is not null").select(array_to_vector("x").alias("features"), F.col("y").cast("double").alias("label"))
    model = LogisticRegression(maxIter=epochs, regParam=regular, family="multinomial", standardization=False).fit(train)
    w, b = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
    # classes above those that have labels are never likely
    w, b = np.vstack([w, np.zeros((classes - len(w), w.shape[1]))]), np.concatenate([b, np.full(classes - len(b), -1e6)])
    return linear_logits(rows, w, b)


def classify(edges: DataFrame, nodes: DataFrame, classes: int, layers: int = 2, epochs: int = 100) -> DataFrame:
    """``id, logits`` of a linear graph convolution: features propagated ``layers`` times, then softmax regression.

    Nodes are ``id, x, y``, y null without a label. No node reaches the driver.
    """
    return ensemble(edges.withColumn("member", F.lit(0)), nodes, classes, layers, epochs).select("id", "logits")


def ensemble(edges: DataFrame, nodes: DataFrame, classes: int, layers: int = 2, epochs: int = 100) -> DataFrame:
    """``member, id, logits`` of a linear graph convolution a member (:func:`member_edges`)."""
    smooth = written(smoothed(edges, nodes, layers).join(nodes.select("id", "y"), "id"), "smooth")
    found = [fitted_logits(smooth.where(F.col("member") == m), classes, epochs) for m in sorted(r.member for r in smooth.select("member").distinct().collect())]
    return reduce(DataFrame.unionByName, found).select("member", "id", "logits")


def probabilities(logits: DataFrame) -> DataFrame:
    """``id, label, p`` by softmax."""
    top = F.array_max("logits")
    e = F.transform("logits", lambda v: F.exp(v - top))
    total = F.aggregate(e, F.lit(0.0), lambda s, v: s + v)
    return logits.select("id", F.posexplode(F.transform(e, lambda v: v / total)).alias("label", "p"))


def mean_logits(members: DataFrame) -> DataFrame:
    """``id, logits``: the mean of several members' logits."""
    flat = members.select("id", F.posexplode("logits").alias("k", "v")).groupBy("id", "k").agg(F.avg("v").alias("v"))
    return flat.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("k", "v"))).alias("a")).select("id", F.transform("a", lambda s: s["v"]).alias("logits"))


def margins(probs: DataFrame) -> DataFrame:
    """``id, first, second, margin``: the two likeliest labels and their distance."""
    k = F.row_number().over(Window.partitionBy("id").orderBy(F.col("p").desc(), "label"))
    two = probs.withColumn("k", k).where("k <= 2")
    pick = lambda c, n: F.max(F.when(F.col("k") == n, F.col(c)))
    return two.groupBy("id").agg(pick("label", 1).alias("first"), pick("label", 2).alias("second"), (pick("p", 1) - pick("p", 2)).alias("margin"))


def errors(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """``error`` on labelled nodes and ``micro_f1`` on the rest, from ``id, label`` and ``id, y, labelled``."""
    both = predicted.join(truth, "id")
    hit = (F.col("label") == F.col("y")).cast("double")
    return both.agg(F.avg(F.when(F.col("labelled"), 1 - hit)).alias("error"), F.avg(F.when(~F.col("labelled"), hit)).alias("micro_f1"))


def suggest_attack(edges: DataFrame, nodes: DataFrame, target: int, hops: int = 2, n: int = 5) -> DataFrame:
    """Nodes around a target whose features weigh most in its propagated vector: ``node, influence``."""
    hat = normalised(edges)
    reach = nodes.where(F.col("id") == target).select(F.col("id").alias("node"), F.lit(1.0).alias("influence"))
    for _ in range(hops):
        reach = reach.join(hat, reach.node == hat.src).groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("influence") * F.col("w")).alias("influence"))
    return reach.where(F.col("node") != target).orderBy(F.col("influence").desc(), "node").limit(n)


def diffusion(edges: DataFrame, nodes: DataFrame, alpha: float = 0.9, rounds: int = 20) -> DataFrame:
    """``id, value``: labels (y, null for 0) spread by (1 - alpha) sum (alpha S) ** k y."""
    hat = normalised(edges)
    y = nodes.select("id", F.coalesce(F.col("y").cast("double"), F.lit(0.0)).alias("y"))
    now = y.withColumnRenamed("y", "value")
    for k in range(rounds):
        spread = hat.join(now.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id")).agg(F.sum(F.col("w") * F.col("value")).alias("s"))
        now = y.join(spread, "id", "left").select("id", (alpha * F.coalesce("s", F.lit(0.0)) + (1 - alpha) * F.col("y")).alias("value"))
        if k % 5 == 4:
            now = written(now, "diffusion")
    return now


def shuffled(edges: DataFrame, seed: int = 42) -> DataFrame:
    return edges.orderBy(arithmetic_order("src", seed), "dst")


def demo_graph(spark) -> DataFrame:
    """A ring of twelve nodes with three chords, undirected."""
    pairs = [(k, (k + 1) % 12) for k in range(12)] + [(0, 6), (3, 9), (2, 7)]
    return spark.createDataFrame(pd.DataFrame([(a, b, 1.0) for p in pairs for a, b in (p, p[::-1])], columns=["src", "dst", "w"]))
