"""Connected components of a graph of links, as DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outlyer.llm.common import scratch


def components(links: DataFrame) -> DataFrame:
    """``id, label`` for every end of ``links`` (columns a, b); label is the smallest id reached.

    Each round takes the smallest label among a node's neighbours and then that label's own label,
    so that paths halve. A node with very many links costs a row a task and label; the joins are
    plain ones, whose hot keys adaptive execution splits. Rounds end when no label changes.
    """
    both = scratch(links.select("a", "b").unionAll(links.select("b", "a")).toDF("id", "other"), "links")
    labels = scratch(both.groupBy("id").agg(F.least(F.col("id"), F.min("other")).alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("id", "other"), "other").groupBy("id").agg(F.min("label").alias("near"))
        lower = scratch(labels.join(near, "id").select("id", F.least("label", "near").alias("label"), (F.col("near") < F.col("label")).alias("changed")), "lower")
        if lower.where("changed").isEmpty():
            return labels
        jump = lower.select(F.col("id").alias("label"), F.col("label").alias("further"))
        labels = scratch(lower.select("id", "label").join(jump, "label").select("id", F.col("further").alias("label")), "labels")
