"""Documents that look like a target text, drawn by hashed n-gram importance.

Words of a block of documents are numbered, runs of one to three words are tuples of numbers, and each
distinct tuple of the block is hashed once, its bytes following those of the tuple a word shorter; the
places of a tuple then take its bucket. Buckets of each document are written once: they are counted for
the gains, and read again for the scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outlyer.llm.common import numbered, scratch, small_batches

BUCKETS = 10_000
#: Bytes of words: digits, a-z and all beyond ASCII; A-Z are made lower before.
_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_LOW = (1 << 32) - 1


def words_of(text: bytes | None) -> list[bytes]:
    """Words of a text in UTF-8."""
    return (text or b"").translate(_BYTES).split()


class _Numbers(dict):
    """Words of a block, numbered from 1; 0 lies between documents."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self) + 1
        return n


def _grown(keys: np.ndarray, before: np.ndarray, spaced: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The tuple number at each place, and the hash of each tuple, for tuples (shorter one, word) ``keys``."""
    found, at = np.unique(keys, return_inverse=True)
    tails = map(spaced.__getitem__, (found & _LOW).tolist())
    return at, np.fromiter(map(crc32, tails, before[found >> 32].tolist()), np.uint32, len(found))


def buckets_of(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all features of a block, the number of features and of words of each text."""
    numbers, parts = _Numbers(), []
    for t in texts:
        w = words_of(t)
        parts.append(np.fromiter(map(numbers.__getitem__, w), np.int64, len(w)))
    n_words = np.array([len(p) for p in parts], np.int64)
    x = np.zeros(int(n_words.sum()) + 2 * len(parts) + 2, np.int64)
    starts = np.cumsum(n_words + 2) - n_words - 2
    for s, p in zip(starts, parts, strict=True):
        x[s : s + len(p)] = p
    spaced = [b" ", *(b" " + w for w in numbers)]
    one = np.fromiter((crc32(w) for w in [b"", *numbers]), np.uint32, len(spaced))
    n = len(x) - 2
    has = np.stack([x[:n] > 0, (x[:n] > 0) & (x[1 : n + 1] > 0), (x[:n] > 0) & (x[1 : n + 1] > 0) & (x[2:] > 0)], 1)
    hashes = np.zeros((n, 3), np.uint32)
    hashes[:, 0] = one[x[:n]]
    pairs, two = _grown(x[:n][has[:, 1]] << 32 | x[1 : n + 1][has[:, 1]], one, spaced)
    hashes[has[:, 1], 1] = two[pairs]
    pair_at = np.zeros(n, np.int64)
    pair_at[has[:, 1]] = pairs
    triples, three = _grown(pair_at[has[:, 2]] << 32 | x[2:][has[:, 2]], two, spaced)
    hashes[has[:, 2], 2] = three[triples]
    n_features = n_words + np.maximum(n_words - 1, 0) + np.maximum(n_words - 2, 0)
    return (hashes[has] % BUCKETS).astype("<u2"), n_features, n_words


def features(docs: DataFrame, tag: str, batch: int = 2_000) -> DataFrame:
    """``doc_id, n_words, n_features, buckets`` (two bytes each) of every text, written once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            found, n, words = buckets_of(b.column(1).to_pylist())
            ends = np.cumsum([0, *(2 * n)])
            data = found.tobytes()
            blobs = [data[s:e] for s, e in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words), pa.array(n), pa.array(blobs, pa.binary())], ["doc_id", "n_words", "n_features", "buckets"])

    kind = dict(docs.dtypes)["doc_id"]
    texts = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    with small_batches(docs.sparkSession, batch):
        return scratch(texts.mapInArrow(run, f"doc_id {kind}, n_words long, n_features long, buckets binary"), tag)


def counts(rows: DataFrame) -> DataFrame:
    """``bucket, c`` of all buckets with features; a task's counts are summed before they leave it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for b in batches:
            for blob in b.column(0):
                total += np.bincount(np.frombuffer(blob.as_py(), "<u2"), minlength=BUCKETS)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(total[held])], ["bucket", "c"])

    return rows.select("buckets").mapInArrow(run, "bucket int, c long").groupBy("bucket").agg(F.sum("c").alias("c"))


def gains(source: DataFrame, target: DataFrame) -> np.ndarray:
    """The gain of each bucket, from features of the source and the target: a fixed number of values."""
    spark = source.sparkSession
    s, t = counts(source).withColumnRenamed("c", "s"), counts(target).withColumnRenamed("c", "t")
    all_ = spark.range(BUCKETS).select(F.col("id").cast("int").alias("bucket")).join(s, "bucket", "left").join(t, "bucket", "left").na.fill(0, ["s", "t"]).collect()
    out = np.zeros(BUCKETS, np.int64)
    total_s, total_t = float(sum(r.s for r in all_)), float(sum(r.t for r in all_))
    for r in all_:
        out[r.bucket] = np.floor(1000 * np.log((r.t + 1.0) * (total_s + BUCKETS) / ((r.s + 1.0) * (total_t + BUCKETS))))
    return out


def scores(rows: DataFrame, gain: np.ndarray, seed: int) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score`` of features' rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sums = [int(gain[np.frombuffer(blob.as_py(), "<u2")].sum()) for blob in b.column(3)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(sums, pa.int64())], ["doc_id", "n_words", "n_features", "weight"])

    kind = dict(rows.dtypes)["doc_id"]
    weighed = rows.select("doc_id", "n_words", "n_features", "buckets").mapInArrow(run, f"doc_id {kind}, n_words long, n_features long, weight long")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    return weighed.withColumn("score", F.col("weight") + noise)


def resample(docs: DataFrame, target: DataFrame, share: int = 5, least_words: int = 20, seed: int = 42) -> DataFrame:
    """Every document's ``doc_id, n_features, weight, score, rank``; ``rank`` from 1 for those drawn, else null.

    ``share`` is in hundredths of the documents with ``least_words`` words or more. ``docs`` needs doc_id
    and text, ``target`` only text; other columns do not matter. A null text has no words; a null id is
    read as an empty one, and its row is scored as any other; repeated rows are scored and drawn one by
    one; ties go to the smaller id (null first); an empty table, or an empty target, is allowed. Texts of any length are read whole.
    """
    source = features(docs, "features")
    goal = features(target.select(F.lit(0).alias("doc_id"), "text"), "target")
    scored = scratch(scores(source, gains(source, goal), seed), "scored")
    fit = F.col("n_words") >= least_words
    ranked = numbered(scored.where(fit), [F.col("score").desc(), F.col("doc_id")], "ranked", "place")
    drawn = share * ranked.count() // 100
    rank = F.when(F.col("place") < drawn, F.col("place") + 1).cast("long")
    everyone = ranked.withColumn("rank", rank).drop("place").unionByName(scored.where(~fit).withColumn("rank", F.lit(None).cast("long")))
    return everyone.select(F.col("doc_id"), "n_features", "weight", "score", "rank")
