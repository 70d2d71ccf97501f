"""What the corpus operators share: scratch tables, tokens and labelled samples."""

from __future__ import annotations

import re
import tempfile
import uuid
from contextlib import contextmanager
from functools import lru_cache

import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word is a run of letters, digits or underscores; case does not count.
WORD = re.compile(r"\w+")
#: ASCII, all but the characters of words as spaces.
_SPACED = "".join(chr(c) if WORD.match(chr(c)) else " " for c in range(128))


def words_of(text: str | None) -> list[str]:
    """The words of a text, in lower case; of ASCII texts by cutting at spaces, which gives the same faster."""
    low = (text or "").lower()
    return low.translate(_SPACED).split() if low.isascii() else WORD.findall(low)


@lru_cache(maxsize=1)
def _local_root() -> str:
    return tempfile.mkdtemp(prefix="spark-scratch-")


def scratch(df: DataFrame, tag: str, compression: str = "lz4_raw") -> DataFrame:
    """``df`` written once to the shared checkpoint folder and read back.

    Later jobs start from the files, so a lost executor costs no recomputation of what lies
    before. The folder is ``spark.checkpoint.dir``; where it is unset, only a local session
    gets a temporary one. The files go when the application ends.
    """
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = _local_root()
    path = f"{root.rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.option("compression", compression).parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 2_000):
    """Python sees at most so many rows at a time in jobs that run inside; documents are large rows."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def text_of(col: str = "text") -> Column:
    """The text, null counting as empty."""
    return F.coalesce(F.col(col), F.lit(""))


def crc_of_id(col: str = "doc_id") -> Column:
    """crc32 of the id's decimal text; null counts as 0."""
    return F.coalesce(F.crc32(F.col(col).cast("string").cast("binary")), F.lit(0))


def held_out(col: str = "doc_id") -> Column:
    """Rows that no model may learn from."""
    return F.pmod(crc_of_id(col), F.lit(5)) == 0


class WordHash(dict):
    """64-bit hashes of words, remembered up to ``most`` words at a time."""

    def __init__(self, most: int = 100_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: str) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def labelled_ids(labels: DataFrame, label: str, most: int) -> DataFrame:
    """Ids with a label that models may learn from: ``doc_id, y``.

    At most ``most`` rows, taken in the order of a hash of doc_id, so that the sample is the same
    whatever the partitioning. Null labels and ids are left out; of several labels for one id the
    largest counts.
    """
    chosen = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
        .groupBy("doc_id")
        .agg(F.max(label).cast("int").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(most)
    )
    return scratch(chosen, "labelled")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """Documents of :func:`labelled_ids`: ``doc_id, text, y, fold``.

    The chosen ids are ``most`` rows at any size of the corpus, and so are broadcast: no text is
    shuffled. ``fold`` is crc32(doc_id) mod 5, 1 to 4.
    """
    chosen = labelled_ids(labels, label, most)
    return (
        docs.select("doc_id", text_of().alias("text"))
        .join(F.broadcast(chosen), "doc_id")
        .withColumn("fold", F.pmod(crc_of_id(), F.lit(5)).cast("int"))
    )


#: Up to so many ids are broadcast; more are joined by a shuffle.
BROADCAST_IDS = 500_000


def only(rows: DataFrame, ids: DataFrame, on: str | list[str]) -> DataFrame:
    """Rows whose key is among ``ids`` (a scratch table of distinct keys), by a join fit for its size."""
    few = ids.count() <= BROADCAST_IDS
    return rows.join(F.broadcast(ids) if few else ids, on, "left_semi")


def numbered(df: DataFrame, order: list[Column], tag: str, out: str, rows: int = 200_000) -> DataFrame:
    """``df`` (a scratch table) with its 0-based place ``out`` in the order of ``order``, nulls first where ascending.

    Rows are dealt by ranges of the whole order, and of their place in the table where that is equal, so
    that no value is too frequent for one task; the sizes of the ranges, a row for each, are summed up.
    """
    parts = df.count() // rows + 1
    dealt = df.withColumn("__tie", F.monotonically_increasing_id()).repartitionByRange(parts, *order, "__tie").sortWithinPartitions(*order, "__tie")
    dealt = scratch(dealt.drop("__tie").withColumn("__at", F.monotonically_increasing_id()), tag)
    # the upper bits of that number are the task's, the lower 33 count its rows
    dealt = dealt.withColumn("__part", F.shiftright("__at", 33)).withColumn("__at", F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)))
    along = Window.partitionBy().orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    first = dealt.groupBy("__part").agg(F.count(F.lit(1)).alias("__n")).select("__part", F.coalesce(F.sum("__n").over(along), F.lit(0)).alias("__first"))
    return dealt.join(F.broadcast(first), "__part").withColumn(out, F.col("__first") + F.col("__at")).drop("__part", "__at", "__first")
