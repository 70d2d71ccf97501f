"""Cross-entropy difference between a target and a background bigram model.

Both models share one vocabulary, their order and their smoothing. The background model counts all documents, the target
model all labelled good ones that may be learnt from. The vocabulary has every word that makes up 1 / ``VOCABULARY`` of the
corpus or more (so it has ``VOCABULARY`` words at most, whatever the corpus), and one class for all other words. It has V kinds in all;
either model gives a word w after v

    P(w | v) = (c(v, w) + MU P(w)) / (c(v) + MU),   P(w) = (c(w) + 1) / (N + V)

and a document is scored by the mean over its words of target loss minus background loss: the
lower, the more it resembles the target.

Counts are exact and stay on Spark, as tables that grow with the corpus. A task adds up its own words or pairs before they are
shuffled. A pair's key holds the places of its two words in the vocabulary, the frequent ones first, so that keys are short and
no two pairs share one. Pairs that occur at least once in ``FREQUENT`` words of the corpus are at most ``FREQUENT`` many: their losses
are broadcast and added up where a text is read. All other pairs of a text are joined to the table of counts; such a pair is rare by
definition, so no key of that join is hot. Sums go by two 64-bit hashes of the text, and are divided by the rows that have it.

Defined cases: null texts count as empty; texts without words have losses and score 0; without
target documents both models are the background's, and scores are 0; an empty table gives no rows; each of repeated rows
gets its score; columns named like the results are replaced; a text of any length is read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outlyer.llm.common import BROADCAST_IDS, held_out, scratch, text_of, words_of

MU = 20.0
#: A word is in the vocabulary if it makes up one in so many words of the corpus.
VOCABULARY = 1 << 20
#: Bits of a word's place in a key: room for the vocabulary, the other words' class and the start.
BITS = 21
#: Most pairs whose losses are broadcast, 24 bytes each.
FREQUENT = 1 << 20
#: Stands before a document's first word.
START = np.uint64(0x9E3779B97F4A7C15)
#: Words that a task holds at a time, and words or pairs that it adds up before it hands them over.
WORDS_AT_ONCE, KEYS_AT_ONCE = 1_000_000, 4_000_000
#: Rows that a task hands over at a time.
CHUNK = 200_000


class WordPlaces(dict):
    """Places of words in the order in which a task meets them, and their hashes."""

    def __init__(self):
        super().__init__()
        self.hashes: list[int] = []

    def __missing__(self, word: str) -> int:
        self[word] = at = len(self)
        self.hashes.append(xxhash.xxh3_64_intdigest(word))
        return at


def read(texts) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]]:
    """Some texts on end: their words as places in an array of hashes, that array, the words' texts, where texts begin, and the first text's number."""
    places, arrays, first, held = WordPlaces(), [], 0, 0
    for k, text in enumerate(texts):
        found = words_of(text)
        arrays.append(np.fromiter(map(places.__getitem__, found), np.int64, len(found)))
        held += len(found)
        if held >= WORDS_AT_ONCE or k == len(texts) - 1:
            sizes = np.array([len(a) for a in arrays])
            if held:
                yield np.concatenate(arrays), np.array(places.hashes, np.uint64), np.repeat(np.arange(len(arrays)), sizes), (np.cumsum(sizes) - sizes)[sizes > 0], first
            places, arrays, first, held = WordPlaces(), [], k + 1, 0


def added(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Keys and their counts, those of one key put together, in the order of keys."""
    key, *counts = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[first], *(np.add.reduceat(c[order], first) for c in counts)


def tallied(docs: DataFrame, counts_of, names: list[str]) -> DataFrame:
    """``key`` and the sums of ``names`` over all documents (text, t: in the target).

    ``counts_of(words, hashes, begins, target)`` gives distinct keys and their counts in some texts.
    """

    def add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts, held = [], 0

        def flush():
            key, *counts = added(parts)
            for k in range(0, len(key), CHUNK):
                at = slice(k, k + CHUNK)
                yield pd.DataFrame({"key": key[at].view(np.int64)} | {n: c[at] for n, c in zip(names, counts, strict=True)})

        for b in batches:
            target = b.t.notna().to_numpy()
            for words, hashes, owner, begins, first in read(b.text.tolist()):
                parts.append(counts_of(words, hashes, begins, target[first + owner]))
                held += len(parts[-1][0])
                if held > KEYS_AT_ONCE:
                    parts, held = [added(parts)], 0
                    if (held := len(parts[0][0])) > KEYS_AT_ONCE // 2:
                        yield from flush()
                        parts, held = [], 0
        if parts:
            yield from flush()

    found = docs.mapInPandas(add_up, ", ".join(f"{n} long" for n in ["key", *names]))
    return found.groupBy("key").agg(*(F.sum(n).alias(n) for n in names))


@dataclass
class Vocabulary:
    """``hashes``, sorted, with their places; ``table``: a row for each place, with both models' P(w) and c(v).

    Words come first, by frequency, then the class of all others, then the start.
    """

    hashes: np.ndarray
    places: np.ndarray
    table: pd.DataFrame
    words: int
    target_words: int

    def encode(self, words: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.hashes, words), len(self.hashes) - 1)
        return np.where(self.hashes[at] == words, self.places[at], len(self.table) - 2).astype(np.uint64)

    def keys(self, words: np.ndarray, hashes: np.ndarray, begins: np.ndarray) -> np.ndarray:
        after = self.encode(hashes)[words]
        before = np.empty_like(after)
        before[1:] = after[:-1]
        before[begins] = len(self.table) - 1
        return (before << np.uint64(BITS)) | after


def word_counts(words: np.ndarray, hashes: np.ndarray, begins: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, ...]:
    """Words with their counts in both corpora, as words and as what stands before one; the start stands before texts only."""
    ends = np.append(begins[1:], len(words)) - 1
    count = lambda w: np.append(np.bincount(w, minlength=len(hashes)), 0)
    all_, own = count(words), count(words[target])
    before, before_own = all_ - count(words[ends]), own - count(words[ends][target[ends]])
    before[-1], before_own[-1] = len(begins), target[begins].sum()
    return np.append(hashes, START), all_, own, before, before_own


COUNTS = ["w_b", "w_t", "v_b", "v_t"]


def vocabulary(flagged: DataFrame) -> Vocabulary:
    counts = scratch(tallied(flagged, word_counts, COUNTS), "words")
    start = int(START.astype(np.int64))
    total = counts.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTS)).first()
    # at most VOCABULARY words reach this share
    kept = counts.where((F.col("w_b") >= max(total.w_b / VOCABULARY, 1)) | (F.col("key") == start)).toArrow().to_pandas()
    begin = kept[kept.key == start][COUNTS].sum()
    kept = kept[kept.key != start].sort_values(["w_b", "key"], ascending=[False, True], ignore_index=True)
    other = pd.Series({c: total[c] for c in COUNTS}) - kept[COUNTS].sum() - begin
    table = pd.concat([kept[COUNTS], pd.DataFrame([other, begin])], ignore_index=True).astype(np.int64)
    kinds = len(kept) + int(other.w_b > 0)
    if not total.w_t:
        table["w_t"], table["v_t"] = table.w_b, table.v_b
    for k in "bt":
        table[f"p_{k}"] = (table[f"w_{k}"] + 1.0) / (table[f"w_{k}"].sum() + max(kinds, 1))
    hashes = np.append(kept.key.to_numpy(np.int64).view(np.uint64), START)
    places = np.append(np.arange(len(kept)), len(kept) + 1)
    order = np.argsort(hashes)
    table.insert(0, "place", np.arange(len(table), dtype=np.int64))
    return Vocabulary(hashes[order], places[order], table[["place", "p_b", "p_t", "v_b", "v_t"]], total.w_b, total.w_t)


@dataclass
class Models:
    """``pairs``: key, b, t: how often w follows v in the corpus and in the target; without a target both are the corpus's."""

    vocabulary: Vocabulary
    pairs: DataFrame


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", text_col: str = "text") -> Models:
    good = labels.where(F.col("doc_id").isNotNull() & (F.col(label) == 1) & ~held_out()).select("doc_id")
    ids = scratch(good.distinct(), "target")
    few = ids.count()
    marks = ids.withColumn("t", F.lit(True))
    flagged = docs.select("doc_id", text_of(text_col).alias("text")).join(F.broadcast(marks) if few <= BROADCAST_IDS else marks, "doc_id", "left").select("text", "t")
    known = vocabulary(flagged)
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def pair_counts(words: np.ndarray, hashes: np.ndarray, begins: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, ...]:
        # the mark of the target is the last bit while keys are sorted
        key = np.sort((shared.value.keys(words, hashes, begins) << np.uint64(1)) | target)
        first = np.flatnonzero(np.concatenate([[True], key[1:] >> np.uint64(1) != key[:-1] >> np.uint64(1)]))
        return key[first] >> np.uint64(1), np.diff(np.append(first, len(key))), np.add.reduceat((key & np.uint64(1)).astype(np.int64), first)

    pairs = scratch(tallied(flagged, pair_counts, ["b", "t"]), "pairs", "zstd")
    return Models(known, pairs if known.target_words else pairs.withColumn("t", F.col("b")))


def score(docs: DataFrame, models: Models, text_col: str = "text") -> DataFrame:
    """``docs``, all columns kept, with tokens, target_loss, background_loss and score."""
    spark, known = docs.sparkSession, models.vocabulary
    often = F.col("b") >= known.words / FREQUENT
    top = models.pairs.where(often).toArrow().to_pandas().sort_values("key")
    v, w = (known.table.iloc[c.to_numpy()].reset_index(drop=True) for c in (top.key // (1 << BITS), top.key % (1 << BITS)))
    losses = [-np.log((top[k].to_numpy() + MU * w[f"p_{k}"].to_numpy()) / (v[f"v_{k}"].to_numpy() + MU)) for k in "tb"]
    shared = spark.sparkContext.broadcast((known, top.key.to_numpy(np.int64).view(np.uint64), *losses))

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, keys, target, background = shared.value
        for b in batches:
            n, x, y = b.num_rows, b["x"].to_numpy(), b["y"].to_numpy()
            tokens, sums = np.zeros(n, np.int64), np.zeros((2, n))
            for words, hashes, owner, begins, first in read(b["text"].to_pylist()):
                wanted, owner = known.keys(words, hashes, begins), first + owner
                at = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
                found = keys[at] == wanted if len(keys) else np.zeros(len(wanted), bool)
                tokens += np.bincount(owner, minlength=n)
                for row, values in zip(sums, (target, background), strict=True):
                    row += np.bincount(owner[found], values[at[found]], minlength=n)
                rare, own = wanted[~found].view(np.int64), owner[~found]
                for k in range(0, len(rare), CHUNK):
                    o = own[k : k + CHUNK]
                    starts = np.flatnonzero(np.concatenate([[True], o[1:] != o[:-1]]))
                    lists = pa.ListArray.from_arrays(np.append(starts, len(o)).astype(np.int32), rare[k : k + CHUNK])
                    none = pa.nulls(len(starts), pa.int64()), pa.nulls(len(starts), pa.float64()), pa.nulls(len(starts), pa.float64())
                    yield pa.RecordBatch.from_arrays([pa.array(x[o[starts]]), pa.array(y[o[starts]]), lists, *none], names=columns)
            # a text's own row meets no pair, as its key is negative: it lies anywhere
            lists = pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32), x | np.int64(-(2**63)))
            yield pa.RecordBatch.from_arrays([b["x"], b["y"], lists, pa.array(tokens), pa.array(sums[0]), pa.array(sums[1])], names=columns)

    columns = ["x", "y", "keys", "tokens", "target", "background"]
    digest = [F.xxhash64(text_of(text_col)).alias("x"), F.xxhash64(F.lit(1), text_of(text_col)).alias("y")]
    found = docs.select(*digest, text_of(text_col).alias("text")).mapInArrow(rate, "x long, y long, keys array<long>, tokens long, target double, background double")
    own = F.when(F.col("tokens").isNotNull(), F.struct("tokens", "target", "background")).alias("own")
    parts = found.select("x", "y", own, F.explode("keys").alias("key"))
    # both tables have a row for each word of the vocabulary, which is bounded
    places = spark.createDataFrame(pa.Table.from_pandas(known.table, preserve_index=False))
    after, ahead = places.select(F.col("place").alias("w"), "p_t", "p_b"), places.select(F.col("place").alias("v"), "v_t", "v_b")
    met = parts.join(models.pairs.where(~often), "key", "left").withColumn("v", F.shiftright("key", BITS)).withColumn("w", F.when(F.col("key") >= 0, F.col("key").bitwiseAND((1 << BITS) - 1)))
    met = met.join(F.broadcast(after), "w", "left").join(F.broadcast(ahead), "v", "left")
    loss = lambda k: -F.log((F.coalesce(F.col(k), F.lit(0)) + MU * F.col(f"p_{k}")) / (F.col(f"v_{k}") + MU))
    plus = lambda c, k: F.sum(F.when(F.col("key") < 0, F.col(f"own.{c}")).otherwise(loss(k))).alias(c)
    sums = met.groupBy("x", "y").agg(F.count("own").alias("rows"), F.coalesce(F.sum("own.tokens"), F.lit(0)).alias("tokens"), plus("target", "t"), plus("background", "b"))
    per = F.greatest(F.col("tokens"), F.lit(1))
    rates = scratch(sums.select("x", "y", (F.col("tokens") / F.col("rows")).cast("long").alias("tokens"), *((F.col(c) / per).alias(f"{c}_loss") for c in ("target", "background"))), "rates")
    new = ("tokens", "target_loss", "background_loss", "score")
    kept = [F.col(f"d.`{c}`") for c in docs.columns if c not in new]
    keyed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns if c not in new)).alias("d"), *(c.alias(f"__{n}") for c, n in zip(digest, "xy", strict=True)))
    rates = rates.withColumnsRenamed({"x": "__x", "y": "__y"})
    out = keyed.join(rates, ["__x", "__y"]).select(*kept, "tokens", "target_loss", "background_loss")
    return out.withColumn("score", F.col("target_loss") - F.col("background_loss"))
