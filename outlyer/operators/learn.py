"""Supervised helpers on MLlib, and small trainers for bounded training sets."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("tree", "forest", "logistic", "svm", "mlp")


def assembled(rows: DataFrame, features: list[str]) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=features, outputCol="features").transform(rows)


def fit(rows: DataFrame, features: list[str], kind: str, y: str = "y", seed: int = 42):
    """An MLlib classifier over assembled features."""
    from pyspark.ml import classification as C

    classes = int(rows.agg(F.max(y)).first()[0]) + 1
    make = {
        "tree": lambda: C.DecisionTreeClassifier(labelCol=y, maxDepth=5, seed=seed),
        "forest": lambda: C.RandomForestClassifier(labelCol=y, numTrees=20, maxDepth=5, seed=seed),
        "logistic": lambda: C.LogisticRegression(labelCol=y, regParam=1e-3),
        "svm": lambda: C.LinearSVC(labelCol=y, regParam=1e-3) if classes == 2 else C.OneVsRest(classifier=C.LinearSVC(regParam=1e-3), labelCol=y),
        "mlp": lambda: C.MultilayerPerceptronClassifier(labelCol=y, layers=[len(features), 16, classes], seed=seed),
    }
    return make[kind]().fit(assembled(rows, features))


def predict(rows: DataFrame, features: list[str], model) -> DataFrame:
    """``rows`` with ``prediction``."""
    return model.transform(assembled(rows, features)).select(*rows.columns, "prediction")


def perceptron(x: np.ndarray, y: np.ndarray, epochs: int = 5, rate: float = 1.0) -> np.ndarray:
    """Unit weights (the last is the offset) by error-driven steps over a bounded training set; y is -1 or 1."""
    a = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(a.shape[1])
    for _ in range(epochs):
        for row, label in zip(a, y, strict=True):
            if label * (row @ w) <= 0:
                w = w + rate * label * row
    n = np.linalg.norm(w)
    return w / n if n else w


def pairwise_vote(predictions: list[DataFrame], id_col: str = "id") -> DataFrame:
    """``id, label``: the majority of one-against-one predictions; ties to the smaller label."""
    votes = predictions[0]
    for p in predictions[1:]:
        votes = votes.unionByName(p)
    counts = votes.groupBy(id_col, "label").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(id_col).agg(F.max_by("label", F.struct("n", -F.col("label"))).alias("label"))


def normal_samples(spark, groups: list[tuple[int, list[float], list[list[float]]]], seed: int = 42) -> DataFrame:
    """``id, y, x0, x1, ...``: rows of one multivariate normal a class, made on the executors."""
    out, first = None, 0
    for y, (n, mean, cov) in enumerate(groups):
        low = np.linalg.cholesky(np.array(cov, float))
        z = spark.range(first, first + n).select("id", *(F.randn(seed + 100 * y + k).alias(f"z{k}") for k in range(len(mean))))
        x = [sum((F.col(f"z{j}") * float(low[k, j]) for j in range(k + 1)), F.lit(float(mean[k]))).alias(f"x{k}") for k in range(len(mean))]
        part = z.select("id", F.lit(y).alias("y"), *x)
        out, first = part if out is None else out.unionByName(part), first + n
    return out
