"""Phrases that are said more often than their parts would have it, from count tries of shards.

Texts are cut into shards of up to about two million words of one language, each with its own word list.
Three counts are made, each from the shards to the corpus and back:

* words: seen often enough they get corpus-wide numbers;
* pairs: a shard counts pairs of such words only;
* tries: a shard grows its trie to depth five through frequent pairs only.

Each time a shard's nodes are serialised sorted and cut by ranges of a hash of their prefix (a word, a pair, or the first
three words), so that no frequent word makes a long range. A range's slices from all shards are merged in one
task, which sums nodes, keeps the frequent ones, and hands each shard back which of its own they are. A phrase is no more frequent than
any phrase inside it, so nothing frequent is pruned; no list of the whole corpus goes to one task. In the
merged trie a phrase's left parts are the nodes on the way down to it; its right parts hang on its suffix
link, the node without the first word.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from outlyer.llm.common import scratch, small_batches

#: Words that a shard holds, about; a longer text is one shard.
SHARD_WORDS = 2_000_000
DEPTH = 5
#: 0xFF is no byte of UTF-8, and so marks where pieces end.
_END = b"\xff"
_BYTES = bytes(255 if c in b".,;:!?\x0a\x0b\x0c\x0d" else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))
_LOW = (1 << 32) - 1


def pieces_of(text: bytes | None) -> list[bytes]:
    """Words of a text in UTF-8, A-Z in lower case, and 0xFF where a piece ends."""
    return ((text or b"") + _END).translate(_BYTES).replace(_END, b" \xff ").split()


def _packed(ids: np.ndarray) -> bytes:
    """Numbers below 2 ** 32, byte by byte of like weight, compressed."""
    import zstandard

    planes = np.ascontiguousarray(ids.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpacked(blob: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


class _Numbers(dict):
    """Words of a shard numbered from 1; 0 is where pieces end."""

    def __init__(self):
        super().__init__({_END: 0})

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _lists(values: list[np.ndarray], kind: pa.DataType = pa.int64()) -> pa.Array:
    ends = np.cumsum([0, *map(len, values)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(values) if values else [], kind))


SHARDS = "shard long, lang string, words array<binary>, counts array<long>, ids binary"


def shards(docs: DataFrame, size: int = SHARD_WORDS) -> DataFrame:
    """Texts as shards: word list, counts and the packed stream of word numbers. A text stays in one shard."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, held = TaskContext.get().partitionId() << 24, {}

        def flushed(lang: str) -> pa.RecordBatch:
            nonlocal made
            numbers, parts, _ = held.pop(lang)
            ids = np.concatenate(parts)
            counts = np.bincount(ids, minlength=len(numbers))[1:]
            made += 1
            words = pa.ListArray.from_arrays(pa.array([0, len(counts)], pa.int32()), pa.array(list(numbers)[1:], pa.binary()))
            return pa.RecordBatch.from_arrays([pa.array([made - 1]), pa.array([lang]), words, _lists([counts]), pa.array([_packed(ids)], pa.binary())], ["shard", "lang", "words", "counts", "ids"])

        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                numbers, parts, n = held.setdefault(lang, (_Numbers(), [], 0))
                words = pieces_of(text.as_py())
                parts.append(np.fromiter(map(numbers.__getitem__, words), np.int32, len(words)))
                held[lang] = (numbers, parts, n + len(words))
                if n + len(words) >= size:
                    yield flushed(lang)
            if sum(h[2] for h in held.values()) >= 2 * size:
                yield from [flushed(lang) for lang in list(held)]
        yield from [flushed(lang) for lang in list(held)]

    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("binary").alias("text"))
    with small_batches(docs.sparkSession):
        return scratch(texts.mapInArrow(cut, SHARDS), "shards", "zstd")


def _each_row(rows: DataFrame, one, schema: str) -> DataFrame:
    """``one`` (a dict of a row's columns to a batch) over large rows, one at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                yield one({name: b.column(i)[k] for i, name in enumerate(b.schema.names)})

    return rows.mapInArrow(run, schema)


def _columns(*cols: np.ndarray) -> bytes:
    """Long numbers, a column after the other, byte by byte of like weight, compressed."""
    import zstandard

    table = np.stack(cols).astype("<i8")
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(table.view(np.uint8).reshape(table.size, 8).T).tobytes())


def _read(blob: bytes, columns: int) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<i8").ravel().reshape(columns, -1)


def _blobs(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary())


def _ranges(prefix: list[np.ndarray], parts: int) -> np.ndarray:
    """The range of each prefix (a column a word): a part of the values of its hash."""
    h = np.full(len(prefix[0]), 0x9E3779B97F4A7C15, np.uint64)
    for column in prefix:
        h = (h ^ column.astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(32)
    return ((h >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _slices(ranges: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """The order that puts ranges together and leaves sorted nodes sorted, and each range with its ends in it."""
    order = np.argsort(ranges, kind="stable")
    found, starts = np.unique(ranges[order], return_index=True)
    return order, list(zip(found.tolist(), starts.tolist(), [*starts[1:].tolist(), len(order)][: len(found)], strict=True))


def _runs(columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order that sorts nodes (a column a word), and where in it each different node begins."""
    order = np.lexsort(columns[::-1])
    new = np.ones(len(order), bool)
    new[1:] = (columns[:, order[1:]] != columns[:, order[:-1]]).any(0)
    return order, np.flatnonzero(new)


#: Nodes that a range has, about.
RANGE = 1_000_000


def frequent_words(cut: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """``lang, word, a, g`` of words seen often enough, with a number; and ``shard, marks``: the places of these words in each shard's list, with g."""
    import xxhash

    parts = (cut.agg(F.sum(F.size("words"))).first()[0] or 0) // RANGE + 1

    def sliced(row: dict) -> pa.RecordBatch:
        lang, words, counts = row["lang"].as_py().encode(), row["words"].values, row["counts"].values
        h = np.fromiter((xxhash.xxh3_64_intdigest(lang + _END + w) for w in words.to_pylist()), np.uint64, len(words))
        order, ends = _slices(((h >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64))
        at = [order[s:e] for _, s, e in ends]
        lists = [pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, at)]), pa.int32()), v.take(pa.array(order))) for v in (words, counts)]
        n = len(ends)
        cols = [pa.array([r for r, _, _ in ends], pa.int64()), pa.array([row["shard"].as_py()] * n, pa.int64()), pa.array([row["lang"].as_py()] * n, pa.string()), _blobs([_columns(a) for a in at]), *lists]
        return pa.RecordBatch.from_arrays(cols, ["range", "shard", "lang", "at", "words", "counts"])

    def merge(t: pa.Table) -> pa.Table:
        n = [len(w) for w in t["words"].combine_chunks()]
        words, counts = t["words"].combine_chunks().flatten(), t["counts"].combine_chunks().flatten().to_numpy()
        lang = t["lang"].combine_chunks().take(pa.array(np.repeat(np.arange(len(n)), n)))
        keys = pc.binary_join_element_wise(lang.cast(pa.binary()), words, pa.scalar(_END, pa.binary())).dictionary_encode()
        index = keys.indices.to_numpy()
        sums = np.zeros(len(keys.dictionary), np.int64)
        np.add.at(sums, index, counts)
        often = np.flatnonzero(sums >= least)
        number = np.full(len(sums), -1, np.int64)
        number[often] = (int(t["range"][0].as_py()) << 32) + np.arange(len(often))
        first = np.full(len(sums), len(index), np.int64)
        np.minimum.at(first, index, np.arange(len(index)))
        g, ends, back = number[index], np.cumsum([0, *n]), []
        for k, (s, e) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
            held = np.flatnonzero(g[s:e] >= 0)
            if len(held):
                back.append((t["shard"][k].as_py(), _columns(_read(t["at"][k].as_py(), 1)[0][held], g[s:e][held])))
        known = pa.array(first[often])
        head = [pa.ListArray.from_arrays(pa.array([0, len(often)] + [len(often)] * len(back), pa.int32()), v) for v in (lang.take(known), words.take(known).cast(pa.string()), pa.array(sums[often]), pa.array(number[often]))]
        return pa.Table.from_arrays([pa.array([None, *(b[0] for b in back)], pa.int64()), _blobs([None, *(b[1] for b in back)]), *head], ["shard", "marks", "lang", "word", "a", "g"])

    parted = _each_row(cut.select("shard", "lang", "words", "counts"), sliced, "range long, shard long, lang string, at binary, words array<binary>, counts array<long>")
    out = scratch(parted.groupBy("range").applyInArrow(merge, "shard long, marks binary, lang array<string>, word array<string>, a array<long>, g array<long>"), "words", "zstd")
    often = out.where("shard is null").select(F.explode(F.arrays_zip("lang", "word", "a", "g")).alias("w")).select("w.*")
    return often, _marks(out)


def _marks(merged: DataFrame) -> DataFrame:
    """``shard, marks``: what the ranges hand back to each shard, which is part of what it gave."""
    return merged.where("shard is not null").groupBy("shard").agg(F.collect_list("marks").alias("marks"))


def _all_marks(row: dict) -> np.ndarray:
    return np.concatenate([_read(b, 2) for b in row["marks"].as_py()], 1)


def _pairs_of(row: dict) -> pa.RecordBatch:
    """The shard's stream in numbers of its frequent words by rising g, and its pairs, sorted."""
    at, g = _all_marks(row)
    order = np.argsort(g)
    at, g = at[order], g[order]
    ids = _unpacked(row["ids"].as_py())
    local = np.zeros(int(ids.max(initial=0)) + 1, np.int64)
    local[at + 1] = np.arange(1, len(at) + 1)
    x = local[ids]
    x = x[(x > 0) | np.concatenate([[True], x[:-1] > 0])]  # one break is as good as many
    keys = x[:-1] << 32 | x[1:]
    keys, counts = np.unique(keys[(x[:-1] > 0) & (x[1:] > 0)], return_counts=True)
    one = [pa.array([row["shard"].as_py()]), _blobs([_packed(x)]), _blobs([_columns(g)]), _blobs([_columns(keys >> 32, keys & _LOW, counts)])]
    return pa.RecordBatch.from_arrays(one, ["shard", "ids", "words", "pairs"])


def frequent_pairs(pairs: DataFrame, least: int, parts: int) -> tuple[DataFrame, DataFrame]:
    """``path, a`` of frequent pairs, and ``shard, marks``: those that each shard has."""

    def sliced(row: dict) -> pa.RecordBatch:
        g = _read(row["words"].as_py(), 1)[0]
        left, right, counts = _read(row["pairs"].as_py(), 3)
        left, right = g[left - 1], g[right - 1]
        order, ends = _slices(_ranges([left, right], parts))
        left, right, counts = left[order], right[order], counts[order]
        cols = [pa.array([r for r, _, _ in ends], pa.int64()), pa.array([row["shard"].as_py()] * len(ends), pa.int64()), _blobs([_columns(left[s:e], right[s:e], counts[s:e]) for _, s, e in ends])]
        return pa.RecordBatch.from_arrays(cols, ["range", "shard", "nodes"])

    def merge(t: pa.Table) -> pa.Table:
        each = [_read(b.as_py(), 3) for b in t["nodes"]]
        nodes = np.concatenate(each, 1)
        order, starts = _runs(nodes[:2])
        sums = np.add.reduceat(nodes[2][order], starts)
        often = sums >= least
        flags = np.zeros(nodes.shape[1], bool)
        flags[order] = np.repeat(often, np.diff([*starts, len(order)]))
        ends, back = np.cumsum([0, *(e.shape[1] for e in each)]), []
        for k, (s, e) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
            if flags[s:e].any():
                back.append((t["shard"][k].as_py(), _columns(*nodes[:2, s:e][:, flags[s:e]])))
        kept = order[starts[often]]
        head = [pa.ListArray.from_arrays(pa.array([0, len(kept)] + [len(kept)] * len(back), pa.int32()), pa.array(v)) for v in (nodes[0][kept], nodes[1][kept], sums[often])]
        return pa.Table.from_arrays([pa.array([None, *(b[0] for b in back)], pa.int64()), _blobs([None, *(b[1] for b in back)]), *head], ["shard", "marks", "left", "right", "a"])

    parted = _each_row(pairs.select("shard", "words", "pairs"), sliced, "range long, shard long, nodes binary")
    out = scratch(parted.groupBy("range").applyInArrow(merge, "shard long, marks binary, left array<long>, right array<long>, a array<long>"), "two", "zstd")
    two = out.where("shard is null").select(F.explode(F.arrays_zip("left", "right", "a")).alias("p")).select(F.array("p.left", "p.right").alias("path"), "p.a")
    return two, _marks(out)


def _tries_of(row: dict, parts: int) -> pa.RecordBatch:
    """Slices of the shard's nodes of depth three to DEPTH whose neighbouring words are all frequent pairs; -1 stands for no word."""
    g = _read(row["words"].as_py(), 1)[0]
    x = _unpacked(row["ids"].as_py())
    left, right = _all_marks(row)
    often = np.sort((np.searchsorted(g, left) + 1) << 32 | (np.searchsorted(g, right) + 1))
    keys = x[:-1] << 32 | x[1:]
    level = np.minimum(np.searchsorted(often, keys), len(often) - 1)
    level = np.where(often[level] == keys, level, -1)
    nodes = []
    for depth in range(3, DEPTH + 1):
        # two nodes of the last depth, a word apart, make one of this depth
        a, b = level[:-1], level[1:]
        where = np.flatnonzero((a >= 0) & (b >= 0))
        _, first, inverse, n = np.unique(a[where] << 32 | b[where], return_index=True, return_inverse=True, return_counts=True)
        level = np.full(len(a), -1, np.int64)
        level[where] = inverse
        path = np.full((DEPTH + 1, len(n)), -1, np.int64)
        path[:depth] = g[x[where[first][:, None] + np.arange(depth)] - 1].T
        path[DEPTH] = n
        nodes.append(path)
    nodes = np.concatenate(nodes, 1)
    nodes = nodes[:, np.lexsort(nodes[DEPTH - 1 :: -1])]
    order, ends = _slices(_ranges(list(nodes[:3]), parts))
    nodes = nodes[:, order]
    return pa.RecordBatch.from_arrays([pa.array([r for r, _, _ in ends], pa.int64()), _blobs([_columns(*nodes[:, s:e]) for _, s, e in ends])], ["range", "nodes"])


def _merged_tries(t: pa.Table, least: int) -> pa.Table:
    nodes = np.concatenate([_read(b.as_py(), DEPTH + 1) for b in t["nodes"]], 1)
    order, starts = _runs(nodes[:DEPTH])
    sums = np.add.reduceat(nodes[DEPTH][order], starts)
    often = sums >= least
    kept = nodes[:DEPTH, order[starts[often]]].T
    size = (kept >= 0).sum(1)
    path = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *size]), pa.int32()), pa.array(kept[kept >= 0]))
    return pa.Table.from_arrays([path, pa.array(sums[often])], ["path", "a"])


def trie(cut: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """``lang, word, a, g`` of frequent words, and ``path, a`` of all frequent phrases of two words or more."""
    parts = (cut.agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda s, c: s + c))).first()[0] or 0) // RANGE + 1
    with small_batches(cut.sparkSession, 1):  # a shard is a large row
        often, marks = frequent_words(cut, least)
        pairs = scratch(_each_row(cut.select("shard", "ids").join(marks, "shard"), _pairs_of, "shard long, ids binary, words binary, pairs binary"), "pairs", "uncompressed")
        two, known = frequent_pairs(pairs, least, parts)
        tries = _each_row(pairs.select("shard", "ids", "words").join(known, "shard"), lambda row: _tries_of(row, parts), "range long, nodes binary")
        deep = scratch(tries.groupBy("range").applyInArrow(lambda t: _merged_tries(t, least), "path array<long>, a long"), "deep")
    return often, two.unionByName(deep)


def linked(often: DataFrame, nodes: DataFrame) -> DataFrame:
    """``lang, phrase, path, a, lefts, rights, pre, suf``: counts of each phrase's first k words, and of the rest, by k."""
    none = F.array().cast("array<long>")
    last = often.select("lang", F.col("word").alias("phrase"), F.col("word").alias("last"), F.array("g").alias("path"), "a", none.alias("lefts"), none.alias("rights"))
    found = []
    for depth in range(2, DEPTH + 1):
        here = nodes.where(F.size("path") == depth).select("path", "a", F.slice("path", 1, depth - 1).alias("pre"), F.slice("path", 2, depth - 1).alias("suf"))
        down = last.select(F.col("path").alias("pre"), "lang", "phrase", F.concat("lefts", F.array("a")).alias("lefts"))
        suffix = last.select(F.col("path").alias("suf"), "last", F.concat(F.array("a"), "rights").alias("rights"))
        last = here.join(down, "pre").join(suffix, "suf").withColumn("phrase", F.concat_ws(" ", "phrase", "last"))
        last = scratch(last, f"depth{depth}")
        found.append(last)
    return reduce(DataFrame.unionByName, found).drop("last")


def collocations(docs: DataFrame, least: int = 100, top: int = 2000, size: int = SHARD_WORDS) -> DataFrame:
    """Each language's ``top`` phrases: ``lang, rank, phrase, a, l, r, n, score``, and ``cut`` (words of the left part).

    ``docs`` has ``text`` and ``lang``; other columns do not matter. A null text is empty, a null
    language is ``und``; an empty table gives no rows. Repeated rows count as often as they occur, and
    texts of any length are read whole. Equal scores and counts go by phrase, in byte order.
    """
    cut = shards(docs, size)
    totals = cut.groupBy("lang").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda s, c: s + c)).alias("n"))
    often, nodes = trie(cut, least)
    found = linked(often, nodes)
    # one word more is enough to look at: what lies in a longer phrase as often lies as often in all between
    longer = found.select(F.explode(F.array("pre", "suf")).alias("path"), "a").groupBy("path").agg(F.max("a").alias("longer"))
    kept = found.join(longer, "path", "left").where(F.col("longer").isNull() | (100 * F.col("longer") < 100 * F.col("a"))).join(totals, "lang")
    whole = "cast({} as decimal(19,0))"
    score = f"(1000 * {whole.format('a')} * {whole.format('n')}) div ({whole.format('l')} * {whole.format('get(rights, i)')})"
    best = F.array_min(F.expr(f"transform(lefts, (l, i) -> named_struct('score', {score}, 'cut', i + 1, 'l', l, 'r', get(rights, i)))"))
    scored = kept.withColumn("b", best).select("lang", "phrase", "a", "b.l", "b.r", "n", "b.score", "b.cut")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    # the best of each part of a language first, so that the last choice has few rows
    part = F.row_number().over(Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(64))).orderBy(*order))
    few = scored.withColumn("__k", part).where(F.col("__k") <= top).drop("__k")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")
    return few.withColumn("rank", rank).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score", "cut")
