"""A detector that learns from labels against classifiers that do, over runs."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from outlyer.functions.ranking import arithmetic_order
from outlyer.functions.tables import written
from outlyer.operators import active, learn, members


def paired_curves(scored: DataFrame, methods: list[str], budget: int, ks: list[int] | None = None) -> DataFrame:
    """``run, method, k, found``: anomalies among the ``k`` best of each method's scores, for each k up to ``budget``.

    ``scored`` is ``run, id, y`` and a column a method, higher for the more anomalous; ties by id. Of each run and
    method only ``budget`` rows go further.
    """
    cells = F.explode(F.array(*(F.struct(F.lit(m).alias("method"), F.col(m).cast("double").alias("score")) for m in methods))).alias("m")
    long = scored.select("run", "id", "y", cells).select("run", "id", "y", "m.*")
    order = [F.col("score").desc(), F.col("id")]
    best = long.withColumn("k", F.row_number().over(Window.partitionBy("run", "method").orderBy(*order))).where(F.col("k") <= budget)
    seen = F.sum("y").over(Window.partitionBy("run", "method").orderBy("k").rowsBetween(Window.unboundedPreceding, 0))  # budget rows
    curve = best.select("run", "method", "k", seen.cast("long").alias("found"))
    return curve.where(F.col("k").isin(ks)) if ks else curve


def mean_curves(curves: DataFrame) -> DataFrame:
    """``method, k, mean, std, runs`` over runs."""
    return curves.groupBy("method", "k").agg(F.avg("found").alias("mean"), F.stddev_pop("found").alias("std"), F.count(F.lit(1)).alias("runs"))


def detector_scores(rows: DataFrame, features: list[str], labels: DataFrame, cfg: active.Config, seed: int, updates: int = 3, kind: str = "isolation", **settings) -> DataFrame:
    """``id, score`` of an ensemble that has learnt from ``labels`` (id, y): of its updates the one that ranks them best."""
    table, n = members.ensemble(kind, rows, features, seed=seed, **settings)
    table = written(table, "members")
    weights, _ = members.pretrain(table, labels, members.Weights.uniform(n), replace(cfg, seed=seed), updates)
    return members.summary(table, weights).select("id", "score")


def classifier_scores(rows: DataFrame, features: list[str], labels: DataFrame, seed: int, kind: str = "forest") -> DataFrame:
    """``id, score``: the probability of label 1 by an MLlib classifier fitted on ``labels`` (id, y)."""
    from pyspark.ml.functions import vector_to_array

    train = rows.select("id", *features).join(F.broadcast(labels.select("id", "y")), "id")
    model = learn.fit(train, features, kind, seed=seed)
    out = model.transform(learn.assembled(rows.select("id", *features), features))
    return out.select("id", vector_to_array("probability")[1].alias("score"))


def detector_against_classifier(rows: DataFrame, features: list[str], runs: int, labelled: int, budget: int, cfg: active.Config | None = None, label_draw: Callable | None = None, **settings) -> DataFrame:
    """``run, method, k, found`` of both on the rows that neither has seen the label of.

    ``rows`` has ``id, y`` and the features. A run draws ``labelled`` rows by a hash of the id, both methods learn
    from the same, and both rank the same others.
    """
    cfg = cfg or active.Config()
    draw = label_draw or (lambda run: rows.select("id", "y").orderBy(arithmetic_order("id", 1000 + run), "id").limit(labelled))
    found = []
    for run in range(runs):
        labels = written(draw(run), "labels")
        scores = [detector_scores(rows, features, labels, cfg, run, **settings).withColumnRenamed("score", "detector")]
        if labels.select("y").distinct().count() > 1:
            scores.append(classifier_scores(rows, features, labels, run).withColumnRenamed("score", "classifier"))
        else:
            scores.append(rows.select("id", F.lit(0.0).alias("classifier")))
        both = rows.select("id", "y").join(F.broadcast(labels.select("id")), "id", "left_anti").join(scores[0], "id").join(scores[1], "id")
        found.append(written(both.withColumn("run", F.lit(run)), "scores"))
    return paired_curves(reduce(DataFrame.unionByName, found), ["detector", "classifier"], budget)
