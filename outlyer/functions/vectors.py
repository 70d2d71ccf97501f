"""Columns over feature arrays and scalars: products, norms, scaling, transforms."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: Euler's constant as the path-length formula has it.
EULER = 0.5772156649


def dot(x: Column, w: Column) -> Column:
    """Inner product of two arrays of doubles."""
    return F.aggregate(F.zip_with(x, w, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def matrix(x: pa.ListArray, d: int) -> tuple[np.ndarray, np.ndarray]:
    """A batch of arrays as a matrix of ``d`` columns, and which rows are missing or have not ``d`` numbers (zeros there)."""
    width = pc.fill_null(pc.list_value_length(x), -1).to_numpy(zero_copy_only=False)
    flat = x.flatten()
    if not flat.null_count and (width == d).all():
        return flat.to_numpy(zero_copy_only=False).astype(float, copy=False).reshape(len(x), d), np.zeros(len(x), bool)
    whole = width == d
    out = np.zeros((len(x), d))
    inside = np.repeat(whole, np.maximum(width, 0))
    out[whole] = pc.fill_null(flat, 0).to_numpy(zero_copy_only=False).astype(float)[inside].reshape(-1, d)
    gaps = np.zeros((len(x), d), bool)
    gaps[whole] = flat.is_null().to_numpy(zero_copy_only=False)[inside].reshape(-1, d)
    return out, ~whole | gaps.any(1)


def norm(x: Column) -> Column:
    return F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v))


def unit(x: Column) -> Column:
    """``x`` over its length; a zero vector stays, and one with a missing value has no values."""
    n = norm(x)
    return F.when(n == 0, x).otherwise(F.transform(x, lambda v: v / n))


def squared_distance(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)


def angle(x: Column, w: Column) -> Column:
    """Degrees between two unit vectors."""
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(x, w)))))


def average_path_length(n: Column) -> Column:
    """Expected path of an unsuccessful search among n; 1 up to one row."""
    m = n.cast("double")
    return F.when(m <= 1, 1.0).otherwise(2 * (F.log(m) + EULER) - 2 * (m - 1) / m)


def path_length(n: float) -> float:
    return 1.0 if n <= 1 else 2 * (math.log(n) + EULER) - 2 * (n - 1) / n


def log_transform(x: Column, eps: float = 1.0) -> Column:
    return F.log(x + eps)


def exp_transform(x: Column, eps: float = 1.0) -> Column:
    return F.exp(x) - eps


def leaky_relu(x: Column, slope: float = 0.2) -> Column:
    return F.greatest(x, slope * x)


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def polynomial(x: Column, y: Column, degree: int = 5) -> dict[str, Column]:
    """All monomials of x and y of degree 1 to ``degree``, by name."""
    return {f"p{i}_{d - i}": F.pow(x, F.lit(i)) * F.pow(y, F.lit(d - i)) for d in range(1, degree + 1) for i in range(d, -1, -1)}


def feature_ranges(rows: DataFrame, features: list[str]) -> DataFrame:
    """``feature, lo, hi``: a row a feature, from one pass."""
    return _melted(rows.agg(*(f(c).alias(f"{n}_{c}") for c in features for n, f in (("lo", F.min), ("hi", F.max)))), features, ("lo", "hi"))


def feature_statistics(rows: DataFrame, features: list[str]) -> DataFrame:
    """``feature, mean, variance`` over values that are numbers; zeros where there is none."""
    known = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    aggs = [f(known(c)).alias(f"{n}_{c}") for c in features for n, f in (("mean", F.avg), ("variance", F.var_pop))]
    out = _melted(rows.agg(*aggs), features, ("mean", "variance"))
    return out.select("feature", *(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("mean", "variance")))


def _melted(one: DataFrame, features: list[str], names: tuple[str, ...]) -> DataFrame:
    rows = F.array(*(F.struct(F.lit(c).alias("feature"), *(F.col(f"{n}_{c}").alias(n) for n in names)) for c in features))
    return one.select(F.explode(rows).alias("r")).select("r.*")


def center_by_range(rows: DataFrame, features: list[str], center: bool = True) -> DataFrame:
    """Each feature less its mean (if ``center``), over its range; null where the range is 0."""
    sums = rows.agg(*(f(c).alias(f"__{n}_{c}") for c in features for n, f in (("a", F.avg), ("l", F.min), ("h", F.max))))
    scaled = rows.crossJoin(F.broadcast(sums))  # one row
    for c in features:
        width = F.col(f"__h_{c}") - F.col(f"__l_{c}")
        scaled = scaled.withColumn(c, F.when(width != 0, (F.col(c) - (F.col(f"__a_{c}") if center else 0)) / width))
    return scaled.select(rows.columns)


def scale_between(rows: DataFrame, col: str, low: float = -1.0, high: float = 1.0, fit_on: DataFrame | None = None) -> DataFrame:
    """``scaled``: ``col`` moved from its range in ``fit_on`` to low..high."""
    lim = (rows if fit_on is None else fit_on).agg(F.min(col).alias("__l"), F.max(col).alias("__h"))
    width = F.col("__h") - F.col("__l")
    return rows.crossJoin(F.broadcast(lim)).withColumn("scaled", F.when(width != 0, low + (F.col(col) - F.col("__l")) * (high - low) / width).otherwise(F.lit(low))).drop("__l", "__h")
