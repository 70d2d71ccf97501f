"""Mixing sources to target weights by iterative proportional fitting (raking).

Token mass is summed into cells of (source, language, topic). Raking scales the cells until their
marginals over each dimension meet the targets; a step is one window sum over the cell table, so
all of it stays in DataFrame expressions. The ratio of a cell's fitted weight to its own mass,
divided by the largest ratio, is the probability with which each of its documents is taken: the
expected mix is then exactly the fitted one, and no document is needed twice. The draw compares
the probability with a hash of the document's id, so it is repeatable and needs no shuffle.

The documents are scanned twice and never shuffled: cells are pre-aggregated in each task, so a
source with a third of all rows costs a row a task and cell.

Defined cases: null or missing levels count as ``unknown``; empty texts have no tokens, fall into
cells like others and are taken with their cell's probability; a cell without tokens has
probability 0 unless the whole table has none; repeated rows share id and thus fate; an empty
table gives an empty result; columns named like the results are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from outlyer.llm.common import scratch, text_of

#: Words, cut by the same characters in every engine.
TOKEN = r"[^\x20\x09-\x0D]+"
#: Raking steps over all dimensions.
SWEEPS = 8


def token_count(col: str = "text") -> Column:
    return F.regexp_count(text_of(col), F.lit(TOKEN)).cast("long")


def form_topic(col: str = "text") -> Column:
    """A coarse topic from the text's form: tables, symbol runs, shouting, notes, articles, books."""
    text = text_of(col)
    return (
        F.when(F.contains(text, F.lit(" | ")), "table")
        .when(F.contains(text, F.lit("&&&")) | F.contains(text, F.lit("###")), "symbols")
        .when(F.contains(text, F.lit("!! ")), "shouting")
        .when(F.length(text) < 600, "note")
        .when(F.length(text) < 6000, "article")
        .otherwise("book")
    )


def tempered_targets(cells: DataFrame, dim: str, power: float) -> DataFrame:
    """Targets of a dimension: its token shares to the given power, summing to 1 (0 without tokens)."""
    levels = cells.groupBy(dim).agg(F.sum("mass").alias("m"))
    raised = F.when(F.col("m") > 0, F.pow(F.col("m").cast("double"), F.lit(power))).otherwise(0.0)
    total = F.sum("t").over(Window.partitionBy())
    return levels.select(F.col(dim), raised.alias("t")).withColumn("t", F.when(total > 0, F.col("t") / total).otherwise(0.0))


def rake(cells: DataFrame, targets: dict[str, DataFrame], sweeps: int = SWEEPS) -> DataFrame:
    """``cells`` (dimensions and ``mass``) with ``weight``, whose marginals approach ``targets``.

    A target table has a dimension's column and its share ``t``; levels without a target get none
    of the weight. ``weight`` is 0 where ``mass`` is.
    """
    for dim, table in targets.items():
        cells = cells.join(table.withColumnRenamed("t", f"t_{dim}"), dim, "left")
    cells = cells.withColumn("weight", F.col("mass").cast("double"))
    for _ in range(sweeps):
        for dim in targets:
            have = F.sum("weight").over(Window.partitionBy(dim))
            want = F.coalesce(F.col(f"t_{dim}"), F.lit(0.0))
            cells = cells.withColumn("weight", F.when(have > 0, F.col("weight") * want / have).otherwise(0.0))
    return cells.drop(*(f"t_{dim}" for dim in targets))


def calibrated(docs: DataFrame, dims: dict[str, Column], powers: dict[str, float], sweeps: int = SWEEPS, seed: str = "mix") -> DataFrame:
    """``docs``, all columns kept, with the dimensions' levels, tokens, weight, prob and sampled.

    ``dims`` maps result columns to expressions; ``powers`` gives the tempering of each (1 keeps
    its shares as they are, 0 makes its levels equal).
    """
    keep = [c for c in docs.columns if c not in {*dims, "tokens", "weight", "prob", "sampled"}]
    level = {d: F.coalesce(e.cast("string"), F.lit("unknown")) for d, e in dims.items()}
    leveled = docs.select(*(F.col(f"`{c}`") for c in keep), token_count().alias("__tokens"), *(e.alias(f"__{d}") for d, e in level.items()))
    cells = scratch(
        leveled.groupBy(*(F.col(f"__{d}").alias(d) for d in dims)).agg(F.sum("__tokens").alias("mass"), F.count(F.lit(1)).alias("rows")), "cells"
    )
    fitted = rake(cells, {d: tempered_targets(cells, d, powers[d]) for d in dims}, sweeps)
    whole = Window.partitionBy()
    ratio = F.when(F.col("mass") > 0, F.col("weight") / F.col("mass")).otherwise(0.0)
    top = F.max("ratio").over(whole)
    fitted = fitted.withColumn("ratio", ratio).withColumn("prob", F.when(top > 0, F.col("ratio") / top).otherwise(1.0))
    fitted = scratch(fitted.select(*(F.col(d).alias(f"__{d}") for d in dims), "weight", "prob"), "fitted")
    draw = F.conv(F.substring(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f"-{seed}"))), 1, 8), 16, 10).cast("double") / 2**32
    dealt = leveled.join(fitted, [f"__{d}" for d in dims])
    return dealt.select(
        *(F.col(f"`{c}`") for c in keep), *(F.col(f"__{d}").alias(d) for d in dims), F.col("__tokens").alias("tokens"),
        F.round("weight", 6).alias("weight"), F.round("prob", 6).alias("prob"), (draw < F.col("prob")).alias("sampled"),
    )
