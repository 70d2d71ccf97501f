"""Density and reconstruction outliers: kernel density, local outlier factor, Gaussians, PCA, mixtures."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from outlyer.functions.ranking import arithmetic_order
from outlyer.operators.joins import nearest

#: Rows that a kernel or neighbour model holds at most.
MODEL_ROWS = 5_000


def kernel_density(rows: DataFrame, sample: DataFrame, bandwidth: float, x: str = "x", id_col: str = "id") -> DataFrame:
    """``id, density``: mean Gaussian kernel over the centres ``sample``, of which ``MODEL_ROWS`` count at most.

    The centres are a model of bounded size: where there are more, those first in the order of a hash of the id are
    taken. Rows are scored in one scan without a shuffle, a few hundred at a time against all centres.
    """
    centres = sample.orderBy(arithmetic_order(id_col), id_col).limit(MODEL_ROWS).select(x).toPandas()[x]
    shared = rows.sparkSession.sparkContext.broadcast(np.array(centres.tolist(), float))

    @F.pandas_udf("double")
    def mean(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = shared.value
        for p in parts:
            v = np.array(p.tolist(), float).reshape(len(p), -1)
            out = np.zeros(len(v))
            for k in range(0, len(v) if len(c) else 0, 256):
                part = v[k : k + 256]
                d2 = sum((part[:, None, j] - c[None, :, j]) ** 2 for j in range(c.shape[1]))
                out[k : k + 256] = np.exp(-d2 / (2 * bandwidth * bandwidth)).mean(1)
            yield pd.Series(out)

    return rows.select(id_col, mean(x).alias("density"))


def scott_bandwidth(n: int, d: int) -> float:
    return n ** (-1.0 / (d + 4))


def local_outlier_factor(rows: DataFrame, k: int = 10, x: str = "x", id_col: str = "id") -> DataFrame:
    """``id, lof`` among rows of a bounded table (or a bounded sample): neighbours, reach, density ratio."""
    near = nearest(rows, rows, k + 1, x, id_col).where("id <> other")
    near = near.withColumn("pos", F.row_number().over(Window.partitionBy("id").orderBy("d2", "other"))).where(F.col("pos") <= k).withColumn("d", F.sqrt("d2"))
    reach = near.groupBy("id").agg(F.max("d").alias("kd"))
    dens = near.join(reach.withColumnRenamed("id", "other"), "other").groupBy("id").agg((1 / F.greatest(F.avg(F.greatest("d", "kd")), F.lit(1e-12))).alias("lrd"))
    other = dens.toDF("other", "lrd_o")
    return near.join(other, "other").join(dens, "id").groupBy("id").agg((F.avg("lrd_o") / F.first("lrd")).alias("lof"))


def moments(rows: DataFrame, features: list[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """Count, mean and covariance (population) from one aggregation; d squared numbers reach the driver."""
    pairs = [(a, b) for i, a in enumerate(features) for b in features[i:]]
    one = rows.agg(F.count(F.lit(1)).alias("n"), *(F.avg(f).alias(f"m_{f}") for f in features), *(F.covar_pop(a, b).alias(f"c_{a}_{b}") for a, b in pairs)).first()
    mean = np.array([one[f"m_{f}"] for f in features], float)
    cov = np.zeros((len(features),) * 2)
    for a, b in pairs:
        i, j = features.index(a), features.index(b)
        cov[i, j] = cov[j, i] = one[f"c_{a}_{b}"] or 0.0
    return one.n, mean, cov


def _linear(features: list[str], mean: np.ndarray, w: np.ndarray):
    return sum(((F.col(f) - float(m)) * float(v) for f, m, v in zip(features, mean, w, strict=True)), F.lit(0.0))


def pca_error(rows: DataFrame, features: list[str], components: int = 1) -> DataFrame:
    """``rows`` with ``error``: distance to the plane of the first components."""
    _, mean, cov = moments(rows, features)
    _, vectors = np.linalg.eigh(cov)
    rest = vectors[:, : len(features) - components]
    total = sum((_linear(features, mean, rest[:, k]) ** 2 for k in range(rest.shape[1])), F.lit(0.0))
    return rows.withColumn("error", F.sqrt(total))


def gaussian_log_density(rows: DataFrame, features: list[str]) -> DataFrame:
    """``rows`` with ``log_density`` under one full-covariance Gaussian."""
    _, mean, cov = moments(rows, features)
    factor = np.linalg.inv(np.linalg.cholesky(cov + 1e-9 * np.eye(len(features))))
    d2 = sum((_linear(features, mean, factor[k]) ** 2 for k in range(len(features))), F.lit(0.0))
    const = len(features) * np.log(2 * np.pi) + np.linalg.slogdet(cov)[1]
    return rows.withColumn("log_density", -0.5 * (d2 + float(const)))


def mixture_by_bic(rows: DataFrame, features: list[str], most: int = 5, seed: int = 42) -> tuple[int, object]:
    """The number of components, 2 to ``most``, with the least BIC, and its MLlib model."""
    from pyspark.ml.clustering import GaussianMixture
    from pyspark.ml.feature import VectorAssembler

    x = VectorAssembler(inputCols=features, outputCol="features").transform(rows)
    n, d, best = x.count(), len(features), None
    for k in range(2, most + 1):
        fitted = GaussianMixture(k=k, seed=seed, maxIter=50).fit(x)
        free = (k - 1) + k * d + k * d * (d + 1) / 2
        bic = -2 * fitted.summary.logLikelihood + free * np.log(n)
        if best is None or bic < best[0]:
            best = bic, k, fitted
    return best[1], best[2]


def pseudo_anomalies(rows: DataFrame, features: list[str], n: int, seed: int = 42, trees: int = 20) -> DataFrame:
    """``rows`` with ``p_background``: a forest's chance that a row is uniform noise and not data."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    from outlyer.operators.select import uniform_box

    lim = rows.agg(*(g(f).alias(f"{e}_{f}") for f in features for e, g in (("l", F.min), ("h", F.max)))).first()
    noise = uniform_box(rows.sparkSession, n, {f: (lim[f"l_{f}"], lim[f"h_{f}"]) for f in features}, seed)
    both = rows.select(*features, F.lit(0.0).alias("y")).unionByName(noise.select(*features, F.lit(1.0).alias("y")))
    v = VectorAssembler(inputCols=features, outputCol="features")
    model = RandomForestClassifier(labelCol="y", numTrees=trees, seed=seed).fit(v.transform(both))
    return model.transform(v.transform(rows)).withColumn("p_background", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def regression_influence(rows: DataFrame, x: str, y: str, flag: str) -> DataFrame:
    """``slope, intercept`` with and without flagged rows."""
    clean = ~F.col(flag)
    part = lambda c: F.when(clean, F.col(c))
    return rows.agg(
        F.regr_slope(y, x).alias("slope_all"), F.regr_intercept(y, x).alias("intercept_all"),
        F.regr_slope(part(y), part(x)).alias("slope_clean"), F.regr_intercept(part(y), part(x)).alias("intercept_clean"),
    )


def median_deviation(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """``id``-wise robust z: distance to the group's median over its median distance."""
    mid = rows.join(rows.groupBy(*by).agg(F.percentile(value, F.lit(0.5)).alias("__m")), by)
    far = mid.withColumn("__d", F.abs(F.col(value) - F.col("__m")))
    return far.join(far.groupBy(*by).agg(F.percentile("__d", F.lit(0.5)).alias("__s")), by).withColumn("robust_z", F.when(F.col("__s") > 0, F.col("__d") / F.col("__s"))).drop("__m", "__d", "__s")
