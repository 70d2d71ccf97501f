"""Row selection, sampling and set operations over instances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from outlyer.functions.ranking import arithmetic_order


def gather(rows: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    """Rows named by ``ids`` (columns pos, id), with their position in the list."""
    return rows.join(ids, id_col)


def without(rows: DataFrame, others: DataFrame, id_col: str = "id") -> DataFrame:
    return rows.join(others.select(id_col).distinct(), id_col, "left_anti")


def first_unmarked(ranked: DataFrame, marked: DataFrame, n: int = 1, rank: str = "pos", id_col: str = "id") -> DataFrame:
    """The first n by rank that are not marked."""
    return without(ranked, marked, id_col).orderBy(rank).limit(n)


def in_box(x: Column, y: Column, x_range: tuple[float, float], y_range: tuple[float, float]) -> Column:
    """Half-open rectangle."""
    return (x >= x_range[0]) & (x < x_range[1]) & (y >= y_range[0]) & (y < y_range[1])


def sample(rows: DataFrame, n: int, seed: int = 42, id_col: str = "id") -> DataFrame:
    """n rows without replacement, the same on every engine and layout."""
    return rows.orderBy(arithmetic_order(id_col, seed), id_col).limit(n)


def capped_by_label(rows: DataFrame, caps: dict[int, int], y: str = "y", seed: int = 42, id_col: str = "id") -> DataFrame:
    """``rows`` with ``in_set``: a random cap of rows of each label, 1 for those inside."""
    chosen = None
    for label, cap in caps.items():
        part = sample(rows.where(F.col(y) == label), cap, seed, id_col).select(id_col)
        chosen = part if chosen is None else chosen.unionAll(part)
    return rows.join(chosen.withColumn("__in", F.lit(1)), id_col, "left").withColumn("in_set", F.coalesce("__in", F.lit(0))).drop("__in")


def labelled_subset(rows: DataFrame, most: int, y: str = "y", seed: int = 42, id_col: str = "id") -> DataFrame:
    """At most ``most`` labelled rows: half of them anomalies where there are as many, nominals for the rest."""
    anomalies = sample(rows.where(F.col(y) == 1), max(1, most // 2), seed, id_col)
    left = most - anomalies.count()
    return anomalies.unionByName(sample(rows.where(F.col(y) == 0), left, seed, id_col))


def move(unlabelled: DataFrame, labelled: DataFrame, feedback: DataFrame, id_col: str = "id") -> tuple[DataFrame, DataFrame]:
    """Rows with feedback (id, y) go from the unlabelled to the labelled."""
    moved = unlabelled.drop("y").join(feedback.select(id_col, "y"), id_col)
    return without(unlabelled, feedback, id_col), labelled.unionByName(moved, allowMissingColumns=True)


def rearrange(n: int, add: int, move_: int) -> list[int]:
    """0..n-1 with the element at ``move_`` put at ``add``."""
    rest = [k for k in range(n) if k != move_]
    return rest[:add] + [move_] + rest[add:]


def rearranged(array: Column, n: int, add: int, move_: int) -> Column:
    return F.transform(F.array(*map(F.lit, rearrange(n, add, move_))), lambda k: F.element_at(array, k + 1))


def grid(spark, lo: float, hi: float, n: int) -> DataFrame:
    """``x, y`` of an n by n grid over lo..hi."""
    step = (hi - lo) / (n - 1)
    cells = spark.range(n * n)
    return cells.select((lo + (F.col("id") % n) * step).alias("x"), (lo + F.floor(F.col("id") / n) * step).alias("y"))


def uniform_box(spark, n: int, ranges: dict[str, tuple[float, float]], seed: int = 42) -> DataFrame:
    return spark.range(n).select("id", *((F.rand(seed + k) * (hi - lo) + lo).alias(c) for k, (c, (lo, hi)) in enumerate(ranges.items())))


def evenly_spaced(rows: DataFrame, pos: str, n_rows: int, n: int) -> DataFrame:
    """n rows at even distances of their position."""
    at = sorted({round(k * (n_rows - 1) / max(1, n - 1)) for k in range(n)})
    return rows.where(F.col(pos).isin(at))


def batches(rows: DataFrame, within: list[str], order: list[str], size: int) -> DataFrame:
    """``rows`` with ``batch``, each ``size`` rows in order inside a group."""
    pos = F.row_number().over(Window.partitionBy(*within).orderBy(*order)) - 1
    return rows.withColumn("batch", F.floor(pos / size))
