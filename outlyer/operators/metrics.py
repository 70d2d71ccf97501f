"""Ranking metrics and summaries: AUC, precision, discovery curves, quantiles, diversity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from outlyer.functions.ranking import row_numbers, running_sums


def top_k(rows: DataFrame, score: str, k: int, id_col: str = "id") -> DataFrame:
    """The k highest scores; ties by id."""
    return rows.orderBy(F.col(score).desc(), id_col).limit(k)


def budget_size(n: int, tau: float, most: int) -> int:
    """round-half-even(tau n), at most ``most``."""
    return min(most, round(tau * n))


def auc(rows: DataFrame, score: str, y: str = "y", id_col: str = "id") -> DataFrame:
    """``auc`` of scores of which the lower are the more anomalous; ties by id, not averaged.

    A rank is counted from the highest score, so anomalies should have high ranks.
    """
    ranked = row_numbers(rows.select(id_col, score, y), [score, id_col], "rk")
    n, m = F.count(F.lit(1)), F.count_if(F.col(y) == 1)
    won = F.sum(F.when(F.col(y) == 1, F.lit(-1) * F.col("rk"))) + n * m - m - m * (m - 1) / 2
    return ranked.agg(F.when((m > 0) & (m < n), won / (m * (n - m))).alias("auc"))


def precision_at(rows: DataFrame, score: str, ks: list[int], y: str = "y", id_col: str = "id") -> DataFrame:
    """``k, precision``: the share of anomalies among the k highest scores."""
    best = rows.orderBy(F.col(score).desc(), id_col).limit(max(ks)).select(y, score, id_col)
    pos = F.row_number().over(Window.partitionBy().orderBy(F.col(score).desc(), id_col))  # max(ks) rows
    marked = best.withColumn("pos", pos)
    one = marked.agg(*(F.sum(F.when(F.col("pos") <= k, F.col(y))).alias(f"k{k}") for k in ks))
    return one.select(F.explode(F.array(*(F.struct(F.lit(k).alias("k"), (F.col(f"k{k}") / k).alias("precision")) for k in ks))).alias("r")).select("r.*")


def average_precision(rows: DataFrame, score: str, y: str = "y", id_col: str = "id") -> DataFrame:
    """``ap, lowest``: mean precision at the anomalies, and the 1-based rank of the last one."""
    seen = running_sums(row_numbers(rows.select(id_col, score, y), [f"-{score}", id_col], "pos"), [f"-{score}", id_col], {"hits": F.col(y)})
    hit = seen.where(F.col(y) == 1)
    return hit.agg(F.avg(F.col("hits") / (F.col("pos") + 1)).alias("ap"), F.max(F.col("pos") + 1).alias("lowest"))


def discovery(rows: DataFrame, order: list[str], y: str = "y") -> DataFrame:
    """``rows`` in order with ``seen``: anomalies found so far."""
    return running_sums(rows, order, {"seen": F.col(y)})


def ranks(rows: DataFrame, score: str, within: list[str] | None = None) -> DataFrame:
    """``rank`` (competition) and ``frac_rank`` (ties averaged) of falling scores, inside groups."""
    w = Window.partitionBy(*(within or [])).orderBy(F.col(score).desc())
    same = F.count(F.lit(1)).over(Window.partitionBy(*(within or []), score))
    return rows.withColumn("rank", F.rank().over(w)).withColumn("frac_rank", F.col("rank") + (same - 1) / 2.0)


def quantile_values(rows: DataFrame, score: str, shares: list[float]) -> list[float | None]:
    """Interpolated quantiles of a whole table: scores are counted by value, counts are summed block by block, and the
    two values around each place are fetched. No task holds all scores, and scores with many ties cost a row a value."""
    counted = rows.where(F.col(score).isNotNull()).groupBy(F.col(score).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("c"))
    upto = running_sums(counted, ["v"], {"upto": F.col("c")}).persist()
    n = upto.agg(F.sum("c")).first()[0] or 0
    places = {p for share in shares for p in (int(share * (n - 1)), min(n - 1, int(share * (n - 1)) + 1))} if n else set()
    found = {p: None for p in places}
    if places:
        at = F.array(*(F.lit(p).cast("long") for p in sorted(places)))
        held = upto.select("v", F.filter(at, lambda p: (p < F.col("upto")) & (p >= F.col("upto") - F.col("c"))).alias("p")).where(F.size("p") > 0)
        found |= {p: r.v for r in held.collect() for p in r.p}  # two rows a share at most
    upto.unpersist()
    out = []
    for share in shares:
        place = share * (n - 1)
        low = int(place)
        out.append(None if not n else found[low] if place == low else (low + 1 - place) * found[low] + (place - low) * found[min(n - 1, low + 1)])
    return out


def deciles(rows: DataFrame, score: str) -> DataFrame:
    """``q``: minimum, the nine deciles and maximum, interpolated."""
    return rows.sparkSession.createDataFrame([(quantile_values(rows, score, [k / 10 for k in range(11)]),)], "q array<double>")


def quantile(rows: DataFrame, score: str, tau: float) -> DataFrame:
    """``q_tau``: the score that the share tau lies above."""
    return rows.sparkSession.createDataFrame([(quantile_values(rows, score, [1 - tau])[0],)], "q_tau double")


def confusion_counts(rows: DataFrame, predicted: Column, y: Column) -> DataFrame:
    p, y = predicted == 1, y == 1
    return rows.agg(*(F.count_if(c).alias(n) for n, c in (("tp", p & y), ("fp", p & ~y), ("tn", ~p & ~y), ("fn", ~p & y))))


def distinct_so_far(rows: DataFrame, order: list[str], label: str, within: list[str]) -> DataFrame:
    """``n_classes``: distinct labels among the first rows of each run.

    A label counts where it first occurs, so the running part is a sum and not a growing set.
    """
    first = F.row_number().over(Window.partitionBy(*within, label).orderBy(*order)) == 1
    marked = rows.withColumn("__new", first.cast("int"))
    return marked.withColumn("n_classes", F.sum("__new").over(Window.partitionBy(*within).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def distinct_per_batch(rows: DataFrame, order: list[str], label: str, within: list[str], batch: int) -> DataFrame:
    """``batch, n_classes`` for each ``batch`` rows of a run."""
    pos = F.row_number().over(Window.partitionBy(*within).orderBy(*order)) - 1
    return rows.withColumn("batch", F.floor(pos / batch)).groupBy(*within, "batch").agg(F.countDistinct(label).alias("n_classes"))


def averages_over_runs(results: DataFrame, by: list[str], value: str) -> DataFrame:
    """``mean, std`` (population) of a metric over runs."""
    return results.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.count(F.lit(1)).alias("runs"))


def vocabulary(words: DataFrame, word: str, size: int) -> DataFrame:
    """``word, n, code``: the ``size`` - 1 most frequent words, coded from 1; 0 is for all others."""
    top = words.groupBy(word).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), word).limit(size - 1)
    return top.withColumn("code", F.row_number().over(Window.partitionBy().orderBy(F.col("n").desc(), word)))  # size - 1 rows


def histogram_choice(rows: DataFrame, col: str, most: int | None = None) -> DataFrame:
    """``bins, score``: the penalised likelihood of regular histograms of 1 to ``most`` bins.

    The score is sum c log(density) - (D + (ln D) ** 2.5); ``most`` defaults to n / ln n, at most 500.
    """
    lim = rows.agg(F.min(col).alias("lo"), F.max(col).alias("hi"), F.count(col).alias("n")).first()
    if not lim.n or lim.hi == lim.lo:
        return rows.sparkSession.createDataFrame([(1, 0.0)], "bins int, score double")
    import math

    most = most or max(2, min(500, int(lim.n / math.log(max(3, lim.n)))))
    width = float(lim.hi - lim.lo)
    place = F.least(F.floor((F.col(col) - lim.lo) / width * F.col("bins")), F.col("bins") - 1)
    counted = rows.select(col, F.explode(F.sequence(F.lit(1), F.lit(most))).alias("bins")).groupBy("bins", place.alias("bin")).agg(F.count(F.lit(1)).alias("c"))
    fit = F.sum(F.col("c") * F.log(F.col("c") * F.col("bins") / (lim.n * width)))
    return counted.groupBy("bins").agg(fit.alias("fit")).select("bins", (F.col("fit") - (F.col("bins") + F.pow(F.log(F.col("bins")), F.lit(2.5)))).alias("score"))


def best_bins(rows: DataFrame, col: str, most: int | None = None) -> DataFrame:
    """``bins`` of the highest score, the smallest of equal ones."""
    return histogram_choice(rows, col, most).agg(F.max_by("bins", F.struct(F.round("score", 9), -F.col("bins"))).alias("bins"))
