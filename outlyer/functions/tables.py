"""Tables written between jobs, so that later jobs start from files."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


@lru_cache(maxsize=1)
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="spark-tables-")


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written once under ``spark.checkpoint.dir`` and read back; its files go with the application.

    Where that is unset, a local session takes a temporary folder and any other one fails.
    """
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = _own_folder()
    path = f"{root.rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def parts_for(spark: SparkSession, rows: int, at_once: int = 500_000) -> Iterator[None]:
    """Shuffles of jobs that run inside have enough parts for ``rows``, ``at_once`` a task, and never fewer than the session's own."""
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    spark.conf.set(key, str(max(int(before), -(-rows // at_once))))
    try:
        yield
    finally:
        spark.conf.set(key, before)
