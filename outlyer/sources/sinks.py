"""Sinks: results, models, rules, matrices. All are plain Spark writes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_results(long: DataFrame, path: str) -> None:
    """A folder for each metric of ``fid, run, iter, metric, value``."""
    long.write.partitionBy("metric").mode("overwrite").parquet(path)


def totals(long: DataFrame) -> DataFrame:
    """Metric ``num_total``: seen plus not seen, position by position."""
    both = long.where(F.col("metric").isin("num_seen", "num_not_seen"))
    return both.groupBy("fid", "run", "iter").agg(F.lit("num_total").alias("metric"), F.sum("value").alias("value"))


def wide(long: DataFrame, iterations: int) -> DataFrame:
    """A row a run with 1-based ids; runs that ended early are padded with -1."""
    cols = [F.coalesce(F.max(F.when(F.col("iter") == k, F.col("value") + 1)), F.lit(-1.0)).alias(f"v{k + 1}") for k in range(iterations)]
    return long.groupBy("fid", "run").agg(*cols)


def write_model(path: str, **tables: DataFrame) -> None:
    """A model's tables under one folder."""
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{path}/{name}")


def read_model(spark: SparkSession, path: str, *names: str) -> tuple[DataFrame, ...]:
    return tuple(spark.read.parquet(f"{path}/{n}") for n in names)


def write_rules(rules: DataFrame, path: str) -> None:
    """``kind, iter, rule`` as text, a folder for each kind and iteration."""
    rules.select("kind", "iter", F.col("rule").alias("value")).write.partitionBy("kind", "iter").mode("overwrite").text(path)


def matrix_lines(sparse: DataFrame, members: int, fmt: str = "%.6e") -> DataFrame:
    """``id, value``: comma-joined dense lines of ``id, member, value``."""
    filled = sparse.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("member", "value"))).alias("m"))
    cell = F.transform(F.sequence(F.lit(0), F.lit(members - 1)), lambda k: F.format_string(fmt, F.coalesce(F.element_at("m", k), F.lit(0.0))))
    return filled.select("id", F.array_join(cell, ",").alias("value"))


def documents(tokens: DataFrame, by: list[str], order: list[str], token: str) -> DataFrame:
    """``document``: the tokens of a group in order, space-joined."""
    packed = tokens.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*order, token))).alias("a"))
    return packed.select(*by, F.array_join(F.transform("a", lambda s: s[token]), " ").alias("document"))
