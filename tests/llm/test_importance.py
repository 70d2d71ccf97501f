"""Importance resampling against features counted by dictionary."""

import hashlib
import math
import re
from collections import Counter
from zlib import crc32

from outlyer.llm.importance import buckets_of, resample


def features(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return len(w), [" ".join(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def brute(rows, target, share=5, least=20):
    found = [(i, *features(t)) for i, t in rows]
    bucket = lambda f: crc32(f.encode()) % 10000
    s, t = Counter(bucket(f) for _, _, fs in found for f in fs), Counter(bucket(f) for x in target for f in features(x)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (big_s + 10000) / ((s[b] + 1) * (big_t + 10000)))) for b in {*s, *t}}
    out = []
    for i, n, fs in found:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(f)] for f in fs)
        out.append((i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n))
    fit = sorted((x for x in out if x[4] >= least), key=lambda x: (-x[3], x[0] is not None, x[0] or 0))
    drawn = share * len(fit) // 100
    rest = [(*x[:4], None) for x in out if x[4] < least]
    return sorted([(*x[:4], k + 1 if k < drawn else None) for k, x in enumerate(fit)] + rest, key=str)


def result(docs, target, **kw):
    return sorted((tuple(r) for r in resample(docs, target, **kw).collect()), key=str)


TARGET = ["What is 2 times 3?", None, "", "the plan of the rail"]


def test_same_as_features_by_dictionary(spark):
    import random

    rng = random.Random(3)
    rows = [(k, " ".join(rng.choice(["The", "plan", "of", "rail", "x1", "É", "a-b", "what is 2"]) for _ in range(rng.randrange(70)))) for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    target = spark.createDataFrame([(t,) for t in TARGET], "text string")
    want = brute(rows, TARGET, 25)
    assert result(docs, target, share=25) == want and sum(r[4] is not None for r in want) > 20


def test_odd_rows_ties_and_empty_tables(spark, odd, empty):
    target = spark.createDataFrame([(t, 1) for t in TARGET], "text string, bucket int")
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    assert result(odd, target, share=50, least_words=1) == brute(rows, TARGET, 50, 1)
    assert result(odd, target.limit(0), share=50, least_words=1) == brute(rows, [], 50, 1)
    assert result(empty, target) == []


def test_block_of_texts_like_one_by_one():
    texts = [b"a b c a b c", None, b"", b"c", b"a b"]
    whole, n, words = buckets_of(texts)
    single = [buckets_of([t])[0].tolist() for t in texts]
    assert whole.tolist() == [b for s in single for b in s] and n.tolist() == [15, 0, 0, 1, 3] and words.tolist() == [6, 0, 0, 1, 2]
