"""Windows over events; each works on a batch and on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def tumbling(events: DataFrame, time: str, width: str, by: list[str], late: str | None = None) -> DataFrame:
    """``start, n, total`` of each group and window; ``late`` sets the watermark of a stream."""
    return sliding(events, time, width, width, by, late)


def sliding(events: DataFrame, time: str, width: str, step: str, by: list[str], late: str | None = None) -> DataFrame:
    src = events.withWatermark(time, late) if late else events
    out = src.groupBy(F.window(time, width, step), *by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(*by, F.col("window.start").alias("start"), "n", "total")


def sessions(events: DataFrame, time: str, gap: str, by: list[str], late: str | None = None) -> DataFrame:
    """``start, n`` of runs of events without a gap."""
    src = events.withWatermark(time, late) if late else events
    out = src.groupBy(F.session_window(time, gap), *by).agg(F.count(F.lit(1)).alias("n"))
    return out.select(*by, F.col("session_window.start").alias("start"), "n")


def count_windows(rows: DataFrame, by: list[str], order: list[str], size: int) -> DataFrame:
    """``rows`` with ``win``: each ``size`` rows of a group, in order; the last may be short."""
    pos = F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1
    return rows.withColumn("win", F.floor(pos / size))


def keep_top(state: DataFrame, buffer: DataFrame, score: str, most: int, id_col: str = "id") -> DataFrame:
    """The rows that stay after a window: the ``most`` highest scores of old and new."""
    return state.unionByName(buffer).orderBy(F.col(score).desc(), id_col).limit(most)
