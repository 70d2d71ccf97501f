"""LODA: sparse random projections with regular histograms.

The model is two bounded tables (projections by features, projections by bins); rows are projected
by expressions, histograms are aggregations, and scoring is one scan with a broadcast. Many projections
are fitted by two scans that keep a few numbers a projection of each task, without a row a projection.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outlyer.functions.tables import written
from outlyer.functions.vectors import dot, matrix

FLOOR = 1e-8


def projections(spark, features: int, k: int, sparsity: float | None = None, seed: int = 42, keep: list[int] | None = None, exclude: list[int] | None = None) -> DataFrame:
    """``proj, w``: k random unit vectors with the given share of zeros (1 - 1 / sqrt(d) by default)."""
    rng = np.random.default_rng(seed)
    share = 1 - 1 / np.sqrt(features) if sparsity is None else sparsity
    out = []
    for p in range(k):
        w = rng.normal(size=features)
        free = [f for f in range(features) if f not in (keep or []) and f not in (exclude or [])]
        zero = rng.choice(free, min(len(free), int(features * share)), replace=False) if free else []
        w[[*map(int, zero), *(exclude or [])]] = 0.0
        length = np.linalg.norm(w)
        out.append((p, (w / length if length else w).tolist()))
    return spark.createDataFrame(out, "proj int, w array<double>")


def project(rows: DataFrame, proj: DataFrame, x: str = "x", id_col: str = "id") -> DataFrame:
    """``id, proj, z``: each row on each projection (a model table)."""
    return rows.join(F.broadcast(proj)).select(id_col, "proj", dot(F.col(x), F.col("w")).alias("z"))


def histograms(projected: DataFrame, bins: int | None = None) -> DataFrame:
    """``proj, lo, width, bins, density``: regular histograms; an array of densities each.

    Without ``bins`` each projection has as many as the square root of its rows, up to 100.
    """
    size = F.lit(bins) if bins else F.greatest(F.lit(2), F.least(F.lit(100), F.floor(F.sqrt("rows")))).cast("int")
    lim = projected.groupBy("proj").agg(F.min("z").alias("lo"), F.max("z").alias("hi"), F.count(F.lit(1)).alias("rows"))
    lim = lim.withColumn("bins", size).withColumn("width", F.greatest((F.col("hi") - F.col("lo")) / F.col("bins"), F.lit(1e-12)))
    binned = projected.join(F.broadcast(lim), "proj").groupBy("proj", "lo", "width", "bins", "rows", _bin().alias("bin")).agg(F.count(F.lit(1)).alias("c"))
    return _packed(binned)


def _packed(binned: DataFrame) -> DataFrame:
    density = binned.withColumn("d", F.col("c") / (F.col("rows") * F.col("width")))
    # an array of bins a projection: bounded
    packed = density.groupBy("proj", "lo", "width", "bins").agg(F.map_from_entries(F.collect_list(F.struct("bin", "d"))).alias("m"))
    return packed.select("proj", "lo", "width", "bins", F.transform(F.sequence(F.lit(0), F.col("bins") - 1), lambda i: F.coalesce(F.element_at("m", i), F.lit(0.0))).alias("density"))


def _bin():
    return F.greatest(F.lit(0), F.least(F.col("bins") - 1, F.floor((F.col("z") - F.col("lo")) / F.col("width")).cast("int")))


def densities(projected: DataFrame, hist: DataFrame) -> DataFrame:
    """``id, proj, logp``: log density of each row on each projection, floored."""
    found = projected.join(F.broadcast(hist), "proj")
    return found.withColumn("logp", F.log(F.greatest(F.lit(FLOOR), F.element_at("density", _bin() + 1)))).drop("z", "lo", "width", "bins", "density")


def score(logps: DataFrame, id_col: str = "id") -> DataFrame:
    """``score``: minus the sum of log densities, higher for the more anomalous."""
    return logps.groupBy(id_col).agg((-F.sum("logp")).alias("score"))


def _places(x: pa.Array, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row on each projection, a column each, summed as :func:`dot` does, and the rows that have no place."""
    v, missing = matrix(x, w.shape[1])
    z = np.zeros((len(v), len(w)))
    for f in range(w.shape[1]):
        z += v[:, f : f + 1] * w[:, f]
    return z, missing


def _bins_of(z: np.ndarray, missing: np.ndarray, lo: np.ndarray, width: np.ndarray, bins: np.ndarray) -> np.ndarray:
    """What :func:`_bin` says of each place."""
    with np.errstate(all="ignore"):
        at = np.clip(np.nan_to_num(np.floor((z - lo) / width), nan=0.0), 0, bins - 1).astype(np.int64)
    at[missing] = bins - 1
    return at


def counts(rows: DataFrame, proj: DataFrame, bins: int | None = None, x: str = "x") -> DataFrame:
    """``proj, lo, width, bins, rows, bin, c``: the counts of :func:`histograms`, by one scan for the limits and one for the bins."""
    given = proj.orderBy("proj").collect()  # a model
    names, w = np.array([r.proj for r in given], np.int32), np.array([r.w for r in given], float)

    def limits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lo, hi, n = np.full(len(w), np.nan), np.full(len(w), -np.inf), 0
        seen = np.zeros(len(w), bool)
        for b in batches:
            z, missing = _places(b.column(0), w)
            n += len(z)
            z = z[~missing]
            if len(z):
                lo, hi, seen[:] = np.fmin(lo, np.fmin.reduce(z)), np.maximum(hi, z.max(0)), True  # NaN is above all
        if n:
            some = ~seen
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(lo, mask=some), pa.array(hi, mask=some), pa.array(np.full(len(w), n))], ["proj", "lo", "hi", "rows"])

    size = F.lit(bins) if bins else F.greatest(F.lit(2), F.least(F.lit(100), F.floor(F.sqrt("rows")))).cast("int")
    lim = rows.select(x).mapInArrow(limits, "proj int, lo double, hi double, rows long").groupBy("proj").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("rows").alias("rows"))
    lim = lim.withColumn("bins", size).withColumn("width", F.greatest((F.col("hi") - F.col("lo")) / F.col("bins"), F.lit(1e-12)))
    lim = written(lim.select("proj", "lo", "width", "bins", "rows"), "limits")
    ends = lim.orderBy("proj").toPandas()  # a row a projection
    lo, width, most = (ends[c].to_numpy(float) for c in ("lo", "width", "bins"))
    most = most.astype(np.int64)

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(w), int(most.max(initial=0))), np.int64)
        for b in batches:
            at = _bins_of(*_places(b.column(0), w), lo, width, most)
            for k in range(len(w)):
                total[k] += np.bincount(at[:, k], minlength=total.shape[1])
        k, at = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(names[k]), pa.array(at.astype(np.int32)), pa.array(total[k, at])], ["proj", "bin", "c"])

    found = rows.select(x).mapInArrow(binned, "proj int, bin int, c long").groupBy("proj", "bin").agg(F.sum("c").alias("c"))
    return written(found.join(F.broadcast(lim), "proj").select("proj", "lo", "width", "bins", "rows", "bin", "c"), "counts")


def histograms_of(rows: DataFrame, proj: DataFrame, bins: int | None = None, x: str = "x") -> DataFrame:
    """:func:`histograms` of ``rows`` on projections."""
    return _packed(counts(rows, proj, bins, x))


def log_densities(rows: DataFrame, proj: DataFrame, hist: DataFrame, x: str = "x") -> DataFrame:
    """``rows`` with ``logp``, an entry a projection in their order: what :func:`densities` gives, in one scan."""
    model = proj.join(hist, "proj").orderBy("proj").collect()  # a model
    w, lo, width = np.array([r.w for r in model], float), np.array([r.lo for r in model], float), np.array([r.width for r in model], float)
    bins = np.array([r.bins for r in model], np.int64)
    logs = np.zeros((len(model), int(bins.max(initial=1))))
    for k, r in enumerate(model):
        logs[k, : r.bins] = np.log(np.maximum(FLOOR, r.density))
    shared = rows.sparkSession.sparkContext.broadcast((w, lo, width, bins, logs))

    @F.arrow_udf("array<double>")
    def logp(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        w, lo, width, bins, logs = shared.value
        for p in parts:
            found = logs[np.arange(len(w)), _bins_of(*_places(p, w), lo, width, bins)]
            yield pa.ListArray.from_arrays(np.arange(len(p) + 1, dtype=np.int32) * len(w), found.ravel())

    return rows.withColumn("logp", logp(x) if model else F.lit(None).cast("array<double>"))


def row_scores(rows: DataFrame, proj: DataFrame, hist: DataFrame, x: str = "x") -> DataFrame:
    """``rows`` with the ``score`` of :func:`score`, in one scan."""
    return log_densities(rows, proj, hist, x).withColumn("score", -F.aggregate("logp", F.lit(0.0), lambda s, v: s + v)).drop("logp")


def fit(rows: DataFrame, features: int, least: int = 5, most: int = 30, x: str = "x", seed: int = 42, tolerance: float = 0.01) -> tuple[DataFrame, DataFrame]:
    """Projections and histograms: as few as leave the mean score steady within ``tolerance``."""
    spark = rows.sparkSession
    proj = projections(spark, features, most, seed=seed)
    found = counts(rows, proj, x=x)
    hist = _packed(found)
    # rows of a bin have one density
    logp = F.log(F.greatest(F.lit(FLOOR), F.col("c") / (F.col("rows") * F.col("width"))))
    means = found.groupBy("proj").agg((-F.sum(F.col("c") * logp) / F.sum("c")).alias("nll")).orderBy("proj").toPandas()  # a row a projection
    running = np.cumsum(means.nll.to_numpy()) / np.arange(1, len(means) + 1)
    change = np.abs(np.diff(running)) / max(1e-12, abs(running[0])) if len(means) else []
    k = next((i + 2 for i, c in enumerate(change) if i + 2 >= least and c < tolerance), most)
    return proj.where(F.col("proj") < k), hist.where(F.col("proj") < k)
