"""From raw documents to shards: reject, deduplicate, decontaminate, mix, deal out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as
the next one's docs. All but the last return the columns of ``docs``; the last adds shard and slot.
A stage drops only the rows that its decision names, and the rest go on unchanged. Rows without an
id pass the stages that decide by id. An empty table passes all of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from outlyer.llm import decontamination, mixing, near_dedup, quality, resharding
from outlyer.llm.common import BROADCAST_IDS, scratch
from outlyer.llm.queries import MIX_POWERS, NEW_SHARDS, OLD_SHARDS, mix_dims, table


def _aside(docs: DataFrame, used: set[str]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``docs`` with its columns outside ``used`` under names that no operator gives, and what gives them back."""
    names = {c: c if c in used else f"__own_{k}" for k, c in enumerate(docs.columns)}
    return docs.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items())), lambda out: out.select(*(F.col(f"`{n}`").alias(c) for c, n in names.items()))


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for good."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    rows, restored = _aside(docs, {"doc_id", "text"})
    return restored(quality.score(rows, model).where("predicted = 1"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: the one with the smallest id."""
    dropped = scratch(near_dedup.groups(docs).where("not kept").select("doc_id").distinct(), "dropped")
    few = dropped.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(dropped) if few else dropped, "doc_id", "left_anti").select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark")).select(docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose token shares meet the targets."""
    dims = {f"mix_{d}": column for d, column in mix_dims().items()}
    rows, restored = _aside(docs, {"doc_id", "text", "source", "lang"})
    return restored(mixing.calibrated(rows, dims, {f"mix_{d}": p for d, p in MIX_POWERS.items()}).where("sampled"))


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with shard and slot."""
    return resharding.assign(docs, resharding.hash_layout(OLD_SHARDS), shards=NEW_SHARDS)


STAGES = [
    ("quality", reject_low_quality),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix),
    ("sharding", shard),
]

#: Signatures, a fitted classifier and a flow have no SQL; the tests check run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
