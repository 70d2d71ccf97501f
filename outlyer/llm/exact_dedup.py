"""Exact deduplication by content hash, with the bytes compared inside each group.

Texts are equal when they are identical after each run of white space (space, tab to carriage
return) became one space; null counts as empty.

1. One scan turns every text into a 128-bit hash and a digest of fixed size. These narrow rows
   go to a scratch table; the text is not shuffled.
2. Hashes that occur more than once are counted with map-side combining, so a hash that a third
   of all rows share costs one row a task.
3. Only texts under such hashes are read again and grouped *by the text itself*, which compares
   bytes; copies meet map-side before the shuffle. Two different texts under one hash become two
   classes.
4. Narrow rows are joined to their class. Both sides come from plain shuffles, so adaptive
   execution splits a hot class.

Defined cases: an empty table gives an empty result; null ids rank last; of rows repeated with
the same id and text one stays; a text of any length is read whole; extra columns of the input are ignored by :func:`classes` and kept
by :func:`deduplicate`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outlyer.llm.common import scratch, text_of

#: Runs of these become one space.
WHITE_SPACE = r"[\x20\x09-\x0D]+"
#: Up to so many repeated hashes (16 bytes each) are broadcast; more are joined by a shuffle.
BROADCAST_KEYS = 500_000


def normalised(col: str = "text"):
    return F.regexp_replace(text_of(col), WHITE_SPACE, " ")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256."""
    texts = docs.select(F.col(id_col).alias("id"), normalised(text_col).alias("norm")).withColumn("h", F.unhex(F.md5("norm")))
    digests = scratch(
        texts.select("id", "h", F.sha2("norm", 256).alias("sha"), F.monotonically_increasing_id().alias("uid")), "digests"
    )
    hashes = scratch(digests.groupBy("h").count().where("count > 1").select("h"), "hashes")
    repeated = F.broadcast(hashes) if hashes.count() <= broadcast_keys else hashes
    by_bytes = (
        texts.join(repeated, "h", "left_semi")
        .groupBy("norm")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.unhex(F.md5("norm")).alias("h"), F.sha2("norm", 256).alias("sha"), "n")
    )
    # A class is named by both digests; were two texts to share even those, the job says so.
    verified = (
        by_bytes.groupBy("h", "sha")
        .agg(F.count(F.lit(1)).alias("texts"), F.sum("n").alias("n"))
        .select("h", "sha", F.when(F.col("texts") == 1, F.col("n")).otherwise(F.raise_error(F.lit("two texts share md5 and sha-256")).cast("long")).alias("group_size"))
        .where("group_size > 1")
    )
    first = digests.groupBy("h", "sha").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "uid")).alias("first"))
    groups = scratch(verified.join(first, ["h", "sha"]).select("h", "sha", "group_size", "first.id", "first.uid").toDF("h", "sha", "group_size", "first_id", "first_uid"), "classes")
    return digests.join(groups, ["h", "sha"], "left").select(
        F.col("id").alias(id_col),
        F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("first_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("group_size").isNull() | (F.col("uid") == F.col("first_uid"))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without later copies, all columns kept.

    Of equal texts the row with the smallest id stays, whatever other rows have that id; of rows that
    share text and smallest id any one stays. Texts that occur once are not shuffled.
    """
    repeated = classes(docs, id_col, text_col).where("group_size > 1")
    groups = scratch(repeated.groupBy("text_sha256").agg(F.min("keep_id").alias("__first")).withColumnRenamed("text_sha256", "__sha"), "groups")
    few = groups.count() <= BROADCAST_KEYS
    groups = groups.withColumn("__repeated", F.lit(True))
    marked = docs.withColumn("__sha", F.sha2(normalised(text_col), 256)).join(F.broadcast(groups) if few else groups, "__sha", "left")
    single = marked.where("__repeated is null").select(docs.columns)
    first = marked.where(F.col("__repeated") & F.col(id_col).eqNullSafe(F.col("__first"))).dropDuplicates(["__sha"]).select(docs.columns)
    return single.unionAll(first)
