"""Time series inside groups: differences, lags, shingles, scaling, simple forecasts."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from outlyer.functions.ranking import row_numbers


def _order(by: list[str], order: list[str]):
    return Window.partitionBy(*by).orderBy(*order)


def difference(rows: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """``diff``: value less the one before; 0 at the start."""
    return rows.withColumn("diff", F.coalesce(F.col(value) - F.lag(value).over(_order(by, order)), F.lit(0.0)))


def undifference(rows: DataFrame, by: list[str], order: list[str], diff: str, initial) -> DataFrame:
    """``restored``: the running sum of differences on top of ``initial``."""
    return rows.withColumn("restored", initial + F.sum(diff).over(_order(by, order).rowsBetween(Window.unboundedPreceding, 0)))


def lags(rows: DataFrame, by: list[str], order: list[str], value: str, n: int) -> DataFrame:
    """``lags``: the last n values up to here, zeros before the start."""
    return rows.withColumn("lags", F.array(*(F.coalesce(F.lag(value, k).over(_order(by, order)), F.lit(0.0)) for k in range(n - 1, -1, -1))))


def shingles(rows: DataFrame, by: list[str], order: list[str], value: str, size: int, skip: int | None = None) -> DataFrame:
    """``start, shingle``: windows of ``size`` values at every ``skip``-th row, zeros past the end."""
    skip = skip or size
    w = _order(by, order)
    pos = rows.withColumn("start", F.row_number().over(w) - 1).withColumn("shingle", F.array(*(F.coalesce(F.lead(value, k).over(w), F.lit(0.0)) for k in range(size))))
    return pos.where(F.col("start") % skip == 0).select(*by, "start", "shingle")


def next_step(rows: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """``now, next`` pairs of consecutive values."""
    return rows.withColumn("next", F.lead(value).over(_order(by, order))).where("next is not null").withColumnRenamed(value, "now")


def last_value_forecast(rows: DataFrame, by: list[str], order: str, value: str, steps: int) -> DataFrame:
    """``step, forecast``: the last value, repeated."""
    last = rows.groupBy(*by).agg(F.max_by(value, order).alias("forecast"))
    return last.select(*by, F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("step"), "forecast")


def autocorrelation(rows: DataFrame, by: list[str], order: list[str], value: str, most: int) -> DataFrame:
    """``lag, acf`` of each group for lags 1 to ``most``."""
    whole = Window.partitionBy(*by)
    centred = rows.withColumn("__d", F.col(value) - F.avg(value).over(whole))
    w = _order(by, order)
    products = [F.sum(F.col(f"__d{k}") * F.col("__d")).alias(f"c{k}") for k in range(1, most + 1)]
    for k in range(1, most + 1):
        centred = centred.withColumn(f"__d{k}", F.lag("__d", k).over(w))
    one = centred.groupBy(*by).agg(F.sum(F.col("__d") * F.col("__d")).alias("c0"), *products)
    parts = F.array(*(F.struct(F.lit(k).alias("lag"), (F.coalesce(F.col(f"c{k}"), F.lit(0.0)) / F.col("c0")).alias("acf")) for k in range(1, most + 1)))
    return one.where("c0 > 0").select(*by, F.explode(parts).alias("r")).select(*by, "r.*")


#: Rows of a series that one task works on.
BLOCK = 50_000


def in_blocks(rows: DataFrame, by: list[str], order: str, value: str, need: int, block: int = BLOCK) -> DataFrame:
    """``by, order, v, pos, n, block, own``: a series cut into blocks, each with the ``need`` rows before it (``own`` false).

    ``pos`` counts a series' rows from 0 and ``n`` is how many it has. Windows over a block then see as far
    back as they must, and a long series is many tasks' work.
    """
    block = max(block, need + 1)
    src = rows.select(*by, order, F.col(value).cast("double").alias("v")).where("v is not null")
    placed = row_numbers(src, [*by, order], "__row")
    ends = placed.groupBy(*by).agg(F.min("__row").alias("__first"), F.count(F.lit(1)).alias("n"))
    placed = placed.join(ends, by).withColumn("pos", F.col("__row") - F.col("__first")).drop("__row", "__first")
    here = F.floor(F.col("pos") / block)
    twice = F.when(F.col("pos") % block >= block - need, F.array(F.struct(here.alias("block"), F.lit(True).alias("own")), F.struct((here + 1).alias("block"), F.lit(False).alias("own"))))
    return placed.withColumn("__b", F.explode(F.coalesce(twice, F.array(F.struct(here.alias("block"), F.lit(True).alias("own")))))).select(*by, order, "v", "pos", "n", "__b.block", "__b.own")


def _polynomial(d: int, season: int) -> np.ndarray:
    """Weights of a value and those before it in its difference, ``d`` times at lag 1 and once at ``season``."""
    c = np.array([1.0])
    for lag in [1] * d + ([season] if season else []):
        c = np.convolve(c, np.concatenate([[1.0], np.zeros(lag - 1), [-1.0]]))
    return c


def _sum(terms: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, terms, F.lit(0.0))


def normal_equations(table: DataFrame, by: list[str], x: list[str], y: str) -> DataFrame:
    """``by, rows, a, b``: of each group the sums of products of a constant and the columns ``x``, a triangle in a
    row, and of them with ``y``. One aggregation; rows with a null do not count."""
    full = table.dropna(subset=[*x, y])
    cols = [F.lit(1.0), *(F.col(c) for c in x)]
    pairs = [F.sum(cols[i] * cols[j]) for i in range(len(cols)) for j in range(i + 1)]
    return full.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), F.array(*pairs).alias("a"), F.array(*(F.sum(c * F.col(y)) for c in cols)).alias("b"))


def solved(equations: DataFrame, by: list[str], out: str = "w") -> DataFrame:
    """``by, w``: the least-squares weights, the constant first. A group is one small system."""

    @F.pandas_udf("array<double>")
    def solve(a: pd.Series, b: pd.Series) -> pd.Series:
        found = []
        for tri, rhs in zip(a, b, strict=True):
            m = np.zeros((len(rhs),) * 2)
            m[np.tril_indices(len(rhs))] = tri
            m = m + m.T - np.diag(np.diag(m))
            found.append(np.linalg.lstsq(m, np.asarray(rhs, float), rcond=1e-12)[0])
        return pd.Series(found, dtype=object)

    return equations.select(*by, solve("a", "b").alias(out))


def _with_lags(table: DataFrame, by: list[str], col: str, lags_: list[int], name: str) -> tuple[DataFrame, list[str]]:
    w = Window.partitionBy(*by, "block").orderBy("pos")
    for k in lags_:
        table = table.withColumn(f"{name}{k}", F.lag(col, k).over(w))
    return table, [f"{name}{k}" for k in lags_]


def _fitted(x: list[str], w: str) -> Column:
    return F.get(w, F.lit(0)) + _sum([F.get(w, F.lit(k + 1)) * F.col(c) for k, c in enumerate(x)])


def arma(rows: DataFrame, by: list[str], order: str, value: str, p: int = 1, q: int = 0, d: int = 0, season: int = 0, seasonal: bool = False, long: int | None = None, train: float = 1.0, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Weights of each series (``by, w``, and ``names`` of what they weigh) and its rows with ``y`` and ``fit``.

    An ARMA(p, q) on the differenced series, with seasonal terms at lag ``season`` if ``seasonal``, by two
    regressions: a long autoregression gives the shocks, then values are regressed on those before them and
    on the shocks before them. Each is one aggregation a series over its first ``train`` part.
    """
    c = _polynomial(d, season)
    ar = [*range(1, p + 1), *([season] if seasonal and season > p else [])]
    ma = [*range(1, q + 1), *([season] if seasonal and season > q and q else [])]
    m = long or max([*ar, *ma, 1]) + 4
    table = in_blocks(rows, by, order, value, len(c) - 1 + max([0, *ar, *([k + m for k in ma])]), block)
    table, past = _with_lags(table, by, "v", list(range(1, len(c))), "v")
    known = _sum([F.col(x) * float(k) for x, k in zip(past, c[1:], strict=True)])
    table = table.withColumn("known", -known).withColumn("y", F.col("v") - F.col("known"))
    table, x = _with_lags(table, by, "y", ar, "y")
    learns = F.col("own") & (F.col("pos") < F.floor(F.col("n") * train))
    if ma:
        table, far = _with_lags(table, by, "y", [k for k in range(1, m + 1) if k not in ar], "y")
        far = [f"y{k}" for k in range(1, m + 1)]
        first = solved(normal_equations(table.where(learns), by, far, "y"), by, "__w")
        table = table.join(first, by).withColumn("e", F.col("y") - _fitted(far, "__w")).drop("__w")
        table, shocks = _with_lags(table, by, "e", ma, "e")
        x = [*x, *shocks]
    weights = solved(normal_equations(table.where(learns), by, x, "y"), by)
    out = table.where("own").join(weights, by).withColumn("fit", _fitted(x, "w"))
    return weights.withColumn("names", F.array(F.lit("1"), *map(F.lit, x))), out.select(*by, order, "pos", "n", "v", "known", "y", "fit")


def rolling_errors(rows: DataFrame, by: list[str], order: str, value: str, p: int = 4, d: int = 1, season: int = 0, train: float = 0.66, q: int = 0, seasonal: bool = False, block: int = BLOCK) -> DataFrame:
    """``step, actual, forecast, error`` of one-step forecasts over the last part of each series.

    The model of :func:`arma`, fitted on the first ``train`` of it; each step sees the true history. Series
    whose first part is too short for it have no rows.
    """
    need = p + d + season + q + 1
    enough = rows.groupBy(*by).agg(F.floor(F.count(value) * train).alias("__cut")).where(F.col("__cut") > need + 1).select(*by)
    _, out = arma(rows.join(enough, by, "left_semi"), by, order, value, p, q, d, season, seasonal, train=train, block=block)
    out = out.where(F.col("pos") >= F.floor(F.col("n") * train)).withColumn("forecast", F.col("fit") + F.col("known"))
    return out.select(*by, F.col("pos").cast("int").alias("step"), F.col("v").alias("actual"), "forecast", F.abs(F.col("v") - F.col("forecast")).alias("error"))


def regression_errors(rows: DataFrame, by: list[str], order: list[str], value: str, n: int = 5) -> DataFrame:
    """One-step errors of a linear regression on n lags, fitted over all groups at once by MLlib."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    lagged = rows
    for k in range(1, n + 1):
        lagged = lagged.withColumn(f"lag{k}", F.lag(value, k).over(_order(by, order)))
    lagged = VectorAssembler(inputCols=[f"lag{k}" for k in range(1, n + 1)], outputCol="features").transform(lagged.dropna(subset=[f"lag{k}" for k in range(1, n + 1)]))
    fitted = LinearRegression(featuresCol="features", labelCol=value, regParam=1e-6).fit(lagged).transform(lagged)
    return fitted.withColumn("error", F.abs(F.col(value) - F.col("prediction"))).select(*by, *order, value, F.col("prediction").alias("forecast"), "error")


def skip_grams(rows: DataFrame, by: list[str], order: list[str], token: str, reach: int = 2) -> DataFrame:
    """``centre, context`` of tokens at most ``reach`` apart."""
    w = _order(by, order)
    around = F.array(*(f(token, k).over(w) for k in range(1, reach + 1) for f in (F.lag, F.lead)))
    return rows.withColumn("__a", around).select(F.col(token).alias("centre"), F.explode("__a").alias("context")).where("context is not null")


def simulate_activities(spark, n_series: int, length: int, seed: int = 42) -> DataFrame:
    """``series_id, t, value, activity``: a Markov chain over sine, moving average and fast sine."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i in b.id:
                rng = np.random.default_rng(seed + int(i))
                values, names, state = [], [], 0
                while len(values) < length:
                    n = int(rng.poisson(30)) + 1
                    noise = rng.normal(0, 0.1, n + 1)
                    t = np.arange(n)
                    values.extend((np.sin(t / 3), noise[1:] + 0.6 * noise[:-1], np.sin(t))[state] + 0.05 * rng.normal(size=n))
                    names.extend([state] * n)
                    state = int(rng.choice([k for k in range(3) if k != state]))
                yield pd.DataFrame({"series_id": i, "t": range(length), "value": values[:length], "activity": names[:length]})

    return spark.range(n_series).mapInPandas(work, "series_id long, t int, value double, activity int")


def shingle_rows(rows: DataFrame, by: list[str], order: list[str], value: str, size: int, skip: int | None = None) -> DataFrame:
    """Shingles as instances: ``id`` over all series and a column a place, for any detector."""
    s = shingles(rows, by, order, value, size, skip)
    flat = s.select(*by, "start", *(F.col("shingle")[k].alias(f"x{k}") for k in range(size)))
    return row_numbers(flat, [*by, "start"], "id")


def label_centroids(rows: DataFrame, label: str, x: str) -> DataFrame:
    """``label, centre``: the mean vector of each label."""
    flat = rows.select(label, F.posexplode(x).alias("k", "v")).groupBy(label, "k").agg(F.avg("v").alias("v"))
    return flat.groupBy(label).agg(F.array_sort(F.collect_list(F.struct("k", "v"))).alias("a")).select(label, F.transform("a", lambda s: s["v"]).alias("centre"))
