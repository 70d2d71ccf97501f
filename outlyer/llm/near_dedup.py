"""Near-duplicate documents by BagMinHash over the multiset of five-word shingles.

1. Signatures. A shingle with count w is a weight on the line (0, w], which is cut into the
   dyadic shells (0, 1], (1, 2], (2, 4], ... Each shell of each shingle has a Poisson process of its
   own; its points carry a time, a register and a place in the shell, all drawn from a hash, and
   points beyond w are passed over. A register keeps the earliest time. Two documents agree in a
   register with exactly the probability of their weighted Jaccard similarity. Points are made in
   order of time, and a shingle stops once it is later than all of its document's registers, so
   a document costs about its number of shingles and not that times the number of registers.
2. Classes of equal word sequences are told by a 128-bit hash; only the smallest id of each goes on.
3. Bands of ``ROWS`` registers are hashed into buckets. Every bucket compares its hub, the member that shares most
   buckets, with all others, and the components of the links so far are taken: from here on only members of
   different components need be compared, as a link inside one changes no group. Buckets with up to ``OUTRIGHT`` such pairs a member compare
   them outright, which is linear in the size of a bucket; of these pairs only those are read whose similarities with the hub let them be linked.
   Members of more mixed buckets are dealt again by their rarest shingles. Let all their shingles (a repeated one counts as several) stand in one order, rare ones
   first. A link's sides share ``SIMILARITY`` of either's shingles, so of all that they share the first one stands in both
   among the first 1 - ``SIMILARITY`` of their own and one more: each is dealt by these only. Those that no other member has deal nobody, so a text that is
   changed in more places than a link allows meets hardly any other, while the texts near to a common one meet, and are one component. The places of the shared shingle bound what two can share; pairs that can't be linked are not read.
   In a bucket that is still more mixed, let a and b be linked, and not both be of the hub's component, so not both be linked to the
   hub. Then what tells a from the hub and what tells b from it (shingles that one has more
   often, or less often) must overlap: were they disjoint, a and b would differ by their sum, which
   is more than a link allows. At least 4/9 of what tells b from the hub is shared. So the members of such buckets that
   hold a member of another component are dealt again by (hub, difference), by the first of their differences in the order of a hash. Linked documents
   a and b differ in (1 / ``SIMILARITY`` - 1) |a| shingles at most, and so do their differences; all of a's that come before the first one
   they share are among these. So that many and one more of a's suffice, and of a linked member the first 5/9 and one more. Dealt buckets with
   members of several components are treated the same way, until none is left. No link
   that would join two groups is lost inside a bucket, whatever its size.
4. Pairs are verified on the texts: multiset overlap of shingles, ``SIMILARITY`` or more.
5. Connected components of the verified links are the groups; the smallest id stays.

At similarity 0.8 a pair shares a band with probability 1 - (1 - 0.8 ** 6) ** 28 = 0.9998; nothing else is left
to chance. Work is linear in the size of a hot group whose members are one component by links to its hubs.

Defined cases: null texts count as empty; texts without words are copies of each other; texts of
less than five words are one shingle; null ids are each a group of their own unless an equal text
has an id; repeated rows share a group, and rows with the same id share their fate (of their texts one is compared); an
empty table gives an empty result; columns other than id and text are not read; a text of any length is read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outlyer.llm.common import WordHash, only, scratch, small_batches, text_of, words_of
from outlyer.llm.components import components

WORDS, SIMILARITY = 5, 0.8
ROWS, BANDS = 6, 28
REGISTERS = ROWS * BANDS
#: A bucket compares members of different components outright while it has so many such pairs a member; most of them by numbers only.
OUTRIGHT = 4
#: The same in buckets of a shingle, where places leave out nearly all of them unread.
OUTRIGHT_PLACED = 16_384
#: Up to so many pairs (three integers each) are broadcast.
BROADCAST_PAIRS = 300_000
#: Counters of shingles by each of two hashes, whatever the corpus.
COUNTERS = 1 << 20
#: Parts that counters are added up in, a row each.
COUNTER_BLOCKS = 64
#: Shingles that a task works on at a time.
AT_ONCE = 400_000
_A, _B, _C = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


def word_hashes(text: str | None, hashes: WordHash) -> np.ndarray:
    found = words_of(text)
    return np.fromiter(map(hashes.__getitem__, found), np.uint64, len(found))


def shingles(words: np.ndarray, size: int = WORDS) -> np.ndarray:
    """A hash of each run of ``size`` words, in order; of all words where there are fewer."""
    if not len(words):
        return words
    size = min(size, len(words))
    h = np.full(len(words) - size + 1, size, np.uint64)
    for k in range(size):
        h = h * _C + words[k : k + len(h)]
    return mix(h)


def bag(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles and their counts."""
    return np.unique(shingles(words), return_counts=True)


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two bags; 1 for two empty ones."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(a[1][i], b[1][j]).sum())
    either = int(a[1].sum() + b[1].sum()) - both
    return both / either if either else 1.0


def weighted_shells(hashes: np.ndarray, counts: np.ndarray, owner: np.ndarray):
    """Owner, seed, length and used length of every shell that a weight reaches into."""
    parts, low, length, k = [], 0, 1, 0
    while len(hashes):
        parts.append((owner, mix(hashes + np.uint64(k * int(_C) % 2**64)), np.full(len(hashes), float(length)), np.minimum(counts - low, length).astype(float)))
        low, k = low + length, k + 1
        length = low
        more = counts > low
        hashes, counts, owner = hashes[more], counts[more], owner[more]
    if not parts:
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0), np.empty(0)
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def signatures(bags: list[tuple[np.ndarray, np.ndarray]], registers: int = REGISTERS, points: int = 1) -> np.ndarray:
    """BagMinHash registers of some documents, a row each; ``points`` of a process are made at a time."""
    owner = np.repeat(np.arange(len(bags)), [len(h) for h, _ in bags])
    owner, seed, length, used = weighted_shells(np.concatenate([h for h, _ in bags]), np.concatenate([c for _, c in bags]), owner)
    first = np.full(len(bags) * registers, np.inf)
    time, drawn = np.zeros(len(owner)), 0
    while len(owner):
        x = mix(seed[:, None] + np.arange(drawn + 1, drawn + points + 1, dtype=np.uint64) * _C)
        step = -np.log1p(-(x >> np.uint64(11)).astype(float) / 2.0**53) / length[:, None]
        step[:, 0] += time
        at = np.cumsum(step, axis=1)
        y = mix(x ^ _A)
        register = ((y >> np.uint64(32)) * np.uint64(registers) >> np.uint64(32)).astype(np.int64)
        inside = (y & np.uint64(0xFFFFFFFF)).astype(float) * (length[:, None] / 2.0**32) < used[:, None]
        np.minimum.at(first, (owner[:, None] * registers + register)[inside], at[inside])
        time, drawn = at[:, -1], drawn + points
        late = first.reshape(-1, registers).max(1)
        on = time < late[owner]
        owner, seed, length, used, time = owner[on], seed[on], length[on], used[on], time[on]
    return first.reshape(-1, registers)


def band_keys(registers: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each row."""
    bits = np.ascontiguousarray(registers).view(np.uint64).reshape(len(registers), BANDS, ROWS)
    keys = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(registers), BANDS)).copy()
    for k in range(ROWS):
        keys = mix(keys * _C + bits[:, :, k])
    return keys.view(np.int64)


def sign(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc, same`` (a hash of the word sequence) and ``bands``, null for texts without words.

    Null ids are set aside before Python sees them, as pandas would turn the ids beside them into floats.
    """

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHash()
        for b in batches:
            same, keys = [], [None] * len(b)
            small, large, held = [], [], 0

            def flush(group, points):
                if group:
                    for (k, _), row in zip(group, band_keys(signatures([x for _, x in group], points=points)), strict=True):
                        keys[k] = row
                    group.clear()

            for k, text in enumerate(b.text):
                words = word_hashes(text, hashes)
                same.append(xxhash.xxh3_128_digest(words.tobytes()))
                if not len(words):
                    continue
                own = bag(words)
                if len(own[0]) < 64:
                    small.append((k, own))
                    if len(small) >= 1000:
                        flush(small, 32)
                    continue
                large.append((k, own))
                held += len(own[0])
                if held > AT_ONCE:
                    flush(large, 1)
                    held = 0
            flush(small, 32)
            flush(large, 1)
            yield pd.DataFrame({"doc": b.doc, "no_id": b.no_id, "same": same, "bands": keys})

    ids = F.col(id_col).cast("long")
    signed = docs.select(F.coalesce(ids, F.lit(0)).alias("doc"), ids.isNull().alias("no_id"), text_of(text_col).alias("text")).mapInPandas(work, "doc long, no_id boolean, same binary, bands array<long>")
    return signed.select(F.when(~F.col("no_id"), F.col("doc")).alias("doc"), "same", "bands")


def differences(member: tuple[np.ndarray, np.ndarray], hub: tuple[np.ndarray, np.ndarray], linked: bool, similarity: float = SIMILARITY) -> np.ndarray:
    """Hashes of what tells a bag from the hub's, one for each shingle too many or too few: those that suffice to meet all links."""
    known = np.union1d(member[0], hub[0])
    have = [np.zeros(len(known), np.int64) for _ in range(2)]
    for n, (h, c) in zip(have, (member, hub), strict=True):
        n[np.searchsorted(known, h)] = c
    more = have[0] - have[1]
    n = np.abs(more)
    level = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - np.minimum(*have), n)
    out = np.sort(mix(np.repeat(known ^ np.where(more > 0, _A, _B), n) + level.astype(np.uint64) * _C))
    alone = int((1 / similarity - 1) * int(member[1].sum()) + 1e-9)  # a link's other side lacks no more of these
    return out[: min(alone, 5 * len(out) // 9) + 1 if linked else alone + 1]


def _with_texts(pairs: DataFrame, texts: DataFrame, one, out: str) -> DataFrame:
    """``a, b`` and ``out``, what ``one`` makes of both bags, of pairs ``a, b`` (a scratch table), from ``doc, text`` rows with unique ids."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, known = WordHash(), {}

        def bag_of(doc, text):
            if doc not in known:
                if len(known) >= 256:
                    known.pop(next(iter(known)))
                known[doc] = bag(word_hashes(text, hashes))
            return known[doc]

        for p in batches:
            yield pd.DataFrame({"a": p.a, "b": p.b, "out": [one(bag_of(a, ta), bag_of(b, tb)) for a, b, ta, tb in zip(p.a, p.b, p.ta, p.tb, strict=True)]})

    few = pairs.count() <= BROADCAST_PAIRS
    both = texts.toDF("a", "ta").join(F.broadcast(pairs) if few else pairs, "a").join(texts.toDF("b", "tb"), "b").select("a", "b", "ta", "tb")
    name, kind = out.split()
    return both.mapInPandas(work, f"a long, b long, out {kind}").withColumnRenamed("out", name)


def verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """``a, b, similarity`` of pairs."""
    return scratch(_with_texts(pairs, texts, overlap, "similarity double"), "verified")


def told_apart(stars: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """``key, doc``: the buckets that members are dealt to by what tells them from their hub, of ``hub, doc``."""

    def extra(hub, member):
        return differences(member, hub, overlap(hub, member) >= similarity, similarity).view(np.int64)

    out = _with_texts(stars.select(F.col("hub").alias("a"), F.col("doc").alias("b")), texts, extra, "extra array<long>")
    return out.select(F.col("b").alias("doc"), F.col("a").alias("hub"), F.explode("extra").alias("d")).select(F.xxhash64("hub", "d").alias("key"), "doc")


def by_rarest(members: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """``key, doc, size, at``: the buckets that members (``doc``) are dealt to by the rarest of their shingles among
    them, and the shingle's place among all ``size`` of its own. Linked ones share such a bucket.

    Frequencies are those of counters that some shingles share by hash. Links need only that all texts have their
    shingles in the same order, whichever it is; and no shingle is taken for rarer than it is.
    """

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHash()
        for b in batches:
            yield pd.DataFrame({"doc": b.doc, "t": [levels(bag(word_hashes(t, hashes))).view(np.int64) for t in b.text]})

    known = scratch(only(texts, members, "doc").mapInPandas(work, "doc long, t array<long>"), "shingles", "zstd")
    often, counters = broadcast_counts(known, COUNTERS), COUNTERS

    def rarest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = []
            for doc, t in zip(b.doc, b.t, strict=True):
                t = np.asarray(t, np.int64).view(np.uint64)
                f = np.minimum(*(n[at] for n, at in zip(often.value, counters_of(t, counters), strict=True)))
                first = np.lexsort((t, f))[: len(t) - int(np.ceil(len(t) * similarity - 1e-9)) + 1]
                at = np.flatnonzero(f[first] > 1)
                found.append(pd.DataFrame({"t": t[first[at]].view(np.int64), "doc": doc, "size": len(t), "at": at}))
            if found:
                yield pd.concat(found)

    return known.mapInPandas(rarest, "t long, doc long, size int, at int").select(F.xxhash64("t").alias("key"), "doc", "size", "at")


def counters_of(t: np.ndarray, counters: int) -> tuple[np.ndarray, np.ndarray]:
    """The two counters of each shingle."""
    return (t >> np.uint64(32)) % np.uint64(counters), t % np.uint64(counters)


def counter_sums(known: DataFrame, counters: int) -> DataFrame:
    """``block, at, n``: how many of the shingles ``t`` fall on the counters ``at`` of each block, for those with any.

    A task hands over ``COUNTER_BLOCKS`` rows at most, whatever it has read, and blocks are added up apart from each other.
    """
    width = -(-2 * counters // COUNTER_BLOCKS)

    def blocks(n: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for k, of in n.items():
            at = np.flatnonzero(of)
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([at + k * width], pa.list_(pa.int32())), pa.array([of[at]], pa.list_(pa.int64()))], ["block", "at", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(COUNTER_BLOCKS * width, np.int64)
        for b in batches:
            for k, at in enumerate(counters_of(b.column(0).flatten().to_numpy().view(np.uint64), counters)):
                n[k * counters : (k + 1) * counters] += np.bincount(at.astype(np.int64), minlength=counters)
        yield from blocks(dict(enumerate(n.reshape(COUNTER_BLOCKS, width))))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = {}
        for b in batches:
            for k, at, more in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
                # a row's counters are different ones
                n.setdefault(k, np.zeros(width, np.int64))[at.values.to_numpy() - k * width] += more.values.to_numpy()
        yield from blocks(n)

    schema = "block int, at array<int>, n array<long>"
    return known.select("t").mapInArrow(count, schema).repartition("block").mapInArrow(add, schema)


def broadcast_counts(known: DataFrame, counters: int):
    """How many of the shingles ``t`` fall on each counter, broadcast. A shingle is as frequent as its lower counter says, or rarer."""
    sums = counter_sums(known, counters).toArrow()  # two numbers a counter
    n = np.zeros(2 * counters, np.int32)
    for at, of in zip(sums["at"], sums["n"], strict=True):
        n[at.values.to_numpy()] = np.minimum(of.values.to_numpy(), 2**31 - 1)
    return known.sparkSession.sparkContext.broadcast((n[:counters], n[counters:]))


def levels(own: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """A hash for each shingle of a bag, and for its first, second, ... occurrence."""
    h, n = own
    level = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return mix(np.repeat(h, n) + level.astype(np.uint64) * _C)


def sized(members: DataFrame) -> DataFrame:
    """``key, doc, n`` of members in buckets of n, two or more."""
    return members.join(members.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "key")


def parted(members: DataFrame, outright: int = OUTRIGHT) -> DataFrame:
    """``members`` (``key, label`` and others) of buckets with several components: ``pairs`` of different ones, the ``most`` to compare outright, and the largest component, ``main``."""
    labels = members.groupBy("key", "label").agg(F.count(F.lit(1)).alias("c"))
    sizes = labels.groupBy("key").agg(F.sum("c").alias("__n"), F.sum(F.col("c") * F.col("c")).alias("same"), F.max(F.struct("c", "label")).alias("main"))
    sizes = sizes.select("key", ((F.col("__n") * F.col("__n") - F.col("same")) / 2).alias("pairs"), (outright * F.col("__n")).alias("most"), F.col("main.label").alias("main")).where("pairs > 0")
    return members.join(sizes, "key")


def with_labels(members: DataFrame, labels: DataFrame | None, doc: str = "doc", out: str = "label") -> DataFrame:
    """``members`` with the component of ``doc``, itself where it has no link."""
    if labels is None:
        return members.withColumn(out, F.col(doc))
    return members.join(labels.toDF(doc, "__label"), doc, "left").withColumn(out, F.coalesce("__label", doc)).drop("__label")


def starred(members: DataFrame, shared: DataFrame) -> DataFrame:
    """``key, doc, hub`` of members; the hub is the one that shares most."""
    hubs = members.join(shared, "doc").groupBy("key").agg(F.max(F.struct("shared", "doc")).alias("hub")).select("key", F.col("hub.doc").alias("hub"))
    return members.select("key", "doc").join(hubs, "key")


def inside(members: DataFrame, similarity: float) -> DataFrame:
    """Pairs ``a, b`` of members (``key, doc, label, main, s, size, at``) of one bucket and different components that may be linked.

    One of them is not of the bucket's largest component, ``main``: only such members meet all others, which is four
    times the pairs of different components at most, where all members would meet the largest component's with each other.

    1 less weighted Jaccard similarity is a metric: two whose similarities ``s`` with the hub differ by
    more than a link's distance are no link. Nor are two that share too little behind the shingle of their
    bucket (:func:`by_rarest`); if it is not their first, they meet in that one's bucket too. Without these nothing is left out.
    """
    x, y = (members.select("key", *(F.col(v).alias(f"{n}{c}") for v, n in (("doc", ""), ("label", "l"), ("main", "m"), ("s", "s"), ("size", "n"), ("at", "k")))) for c in ("a", "b"))
    apart = F.coalesce(F.abs(F.col("sa") - F.col("sb")) > 1 - similarity + 1e-9, F.lit(False))
    # of shingles in one order, the first that both have is at these places
    shared = F.least(F.col("na") - F.col("ka"), F.col("nb") - F.col("kb"))
    few = F.coalesce(shared < similarity / (1 + similarity) * (F.col("na") + F.col("nb")) - 1e-9, F.lit(False))
    return x.where("la <> ma").join(y, "key").where(F.expr("la <> lb and (lb = mb or a < b)") & ~apart & ~few).select("a", "b")


def joined(labels: DataFrame | None, new: DataFrame) -> DataFrame:
    """``id, label`` of all ends of links, after ``new`` ones (``a, b``): only those between components are followed."""
    if labels is None:
        return components(new)
    ends = new.select(F.col("a").alias("id")).unionAll(new.select("b")).distinct()
    known = labels.unionAll(ends.join(labels, "id", "left_anti").select("id", F.col("id").alias("label")))
    met = with_labels(with_labels(new, labels, "a", "la"), labels, "b", "lb").where("la <> lb").select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct()
    lower = components(met).toDF("label", "__lower")
    return scratch(known.join(lower, "label", "left").select("id", F.coalesce("__lower", "label").alias("label")), "labels")


def links(signed: DataFrame, docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Verified links ``a, b, similarity`` between the signed documents (ids are longs): all that are needed to tell their groups."""
    found, _ = linked(signed, docs, similarity)
    return reduce(DataFrame.unionAll, found) if found else docs.sparkSession.createDataFrame([], "a long, b long, similarity double")


def linked(signed: DataFrame, docs: DataFrame, similarity: float = SIMILARITY) -> tuple[list[DataFrame], DataFrame | None]:
    """The verified links (:func:`links`), a table a step, and ``id, label`` of their ends; none and None where there are none."""
    members = scratch(sized(signed.where("bands is not null").select(F.explode("bands").alias("key"), "doc")), "members")
    shared = scratch(members.groupBy("doc").agg(F.sum("n").alias("shared")), "shared")
    texts = scratch(only(docs, shared.select("doc"), "doc").dropDuplicates(["doc"]), "texts", "zstd")
    found, seen, labels = [], [], None

    def compare(pairs: DataFrame) -> bool:
        """Verify pairs that have not been; whether there were links among them."""
        nonlocal labels
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        for before in seen:
            pairs = pairs.join(before.select("a", "b"), ["a", "b"], "left_anti")
        pairs = scratch(pairs, "pairs")
        if pairs.isEmpty():
            return False
        seen.append(verify(pairs, texts))
        new = seen[-1].where(F.col("similarity") >= similarity)
        if new.isEmpty():
            return False
        found.append(new)
        labels = joined(labels, new.select("a", "b"))
        return True

    def apart(stars: DataFrame) -> DataFrame:
        """Pairs of members and hubs that are in different components."""
        both = with_labels(with_labels(stars, labels), labels, "hub", "hub_label")
        return both.where("label <> hub_label").select(F.col("hub").alias("a"), F.col("doc").alias("b"))

    def near(stars: DataFrame) -> DataFrame:
        """``stars`` with ``s``, the similarity with the hub where it is known."""
        known = reduce(DataFrame.unionAll, seen)
        both = known.toDF("hub", "doc", "s").unionAll(known.select("b", "a", "similarity").toDF("hub", "doc", "s"))
        return stars.join(both, ["hub", "doc"], "left").withColumn("s", F.when(F.col("doc") == F.col("hub"), 1.0).otherwise(F.col("s")))

    def placed(stars: DataFrame) -> DataFrame:
        """``stars`` with ``size`` and ``at``, where the bucket is a shingle's."""
        if places is None:
            return stars.withColumn("size", F.lit(None).cast("int")).withColumn("at", F.lit(None).cast("int"))
        return stars.join(places, ["key", "doc"], "left")

    dealt, gone, places = None, None, None
    while True:
        stars = scratch(starred(members, shared), "stars")
        compare(apart(stars))
        if not seen:
            break
        mixed = scratch(parted(near(with_labels(placed(stars), labels)), OUTRIGHT if places is None or dealt is not None else OUTRIGHT_PLACED), "mixed")
        compare(inside(mixed.where("pairs <= most"), similarity))
        if places is None:
            rest = scratch(mixed.where("pairs > most").select("doc").distinct(), "rest")
            if rest.isEmpty():
                break
            places = scratch(by_rarest(rest, texts, similarity), "rarest", "zstd")
            members = scratch(parted(with_labels(places.select("key", "doc"), labels)).select("key", "doc"), "members", "zstd")
            if members.isEmpty():
                break
            continue
        # hubs of larger buckets that have a member of another component, with all their members
        large = mixed.where((F.col("pairs") > F.col("most")) & (F.col("doc") != F.col("hub"))).select("hub", "doc").distinct()
        open_ = scratch(apart(large).select(F.col("a").alias("hub")).distinct(), "open")
        large = large.join(open_, "hub", "left_semi")
        if gone is not None:
            large = large.join(gone, ["hub", "doc"], "left_anti")
        large = scratch(large, "large")
        if large.isEmpty():
            break
        gone = large if gone is None else gone.unionAll(large)
        again = scratch(told_apart(large, texts, similarity), "dealt", "zstd")
        dealt = again if dealt is None else dealt.unionAll(again)
        # a bucket that gets new members has its old ones too
        touched = dealt.join(again.select("key").distinct(), "key", "left_semi").distinct()
        members = scratch(parted(with_labels(touched, labels)).select("key", "doc"), "members", "zstd")
        if members.isEmpty():
            break
    return found, labels


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row per document: id (an integer), class_id (the smallest id of its group) and kept."""
    with small_batches(docs.sparkSession):
        signed = scratch(sign(docs, id_col, text_col), "signed")
    heads = scratch(signed.groupBy("same").agg(F.min("doc").alias("head"), F.count(F.lit(1)).alias("n")), "heads")
    ids = heads.where("head is not null").select(F.col("head").alias("doc"))
    text = docs.select(F.col(id_col).cast("long").alias("doc"), text_of(text_col).alias("text"))
    with small_batches(docs.sparkSession, 1_000):
        _, labels = linked(signed.join(ids, "doc", "left_semi"), text, similarity)
    if labels is None:
        labels = docs.sparkSession.createDataFrame([], "id long, label long")
    classes = scratch(heads.join(labels.withColumnRenamed("id", "head"), "head", "left").select("same", "n", F.coalesce("label", "head").alias("class_id")), "groups")
    return signed.select("doc", "same").join(classes, "same").select(
        F.col("doc").alias(id_col), "class_id", (F.col("doc").isNull() & F.col("class_id").isNull() | F.coalesce(F.col("doc") == F.col("class_id"), F.lit(False))).alias("kept")
    )
