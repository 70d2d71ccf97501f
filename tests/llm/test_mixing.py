import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from outlyer.llm import mixing, queries


def test_rake_meets_targets(spark):
    rng = np.random.default_rng(2)
    cells = [(a, b, float(rng.integers(1, 100))) for a in "xyz" for b in "pq"]
    df = spark.createDataFrame(cells, "a string, b string, mass double")
    targets = {"a": spark.createDataFrame([("x", 0.5), ("y", 0.3), ("z", 0.2)], "a string, t double"), "b": spark.createDataFrame([("p", 0.6), ("q", 0.4)], "b string, t double")}
    got = {(r.a, r.b): r.weight for r in mixing.rake(df, targets, 12).collect()}
    w = np.array([m for *_, m in cells]).reshape(3, 2)
    for _ in range(12):
        w = w * (np.array([0.5, 0.3, 0.2]) / w.sum(1))[:, None]
        w = w * np.array([0.6, 0.4]) / w.sum(0)
    assert [got[a, b] for a, b, _ in cells] == pytest.approx(w.ravel().tolist())
    assert w.sum(1).tolist() == pytest.approx([0.5, 0.3, 0.2], rel=1e-6)


def run(df):
    return mixing.calibrated(df, queries.mix_dims(), queries.MIX_POWERS)


def test_draws_and_tokens(make):
    df = make([f"word {k} " * (k % 9) for k in range(200)])
    got = run(df).collect()
    text = {r.doc_id: r.text for r in df.collect()}
    for r in got:
        assert r.tokens == len(re.findall(r"[^\x20\x09-\x0D]+", text[r.doc_id]))
        u = int(hashlib.md5(f"{r.doc_id}-mix".encode()).hexdigest()[:8], 16) / 2**32
        assert r.sampled == (u < r.prob) and 0 <= r.prob <= 1
    assert max(r.prob for r in got) == 1


def test_odd_rows(odd, empty):
    got = run(odd)
    assert got.count() == odd.count() and got.where("source is null or lang is null or prob is null").count() == 0
    assert run(empty).count() == 0
    blank = run(odd.where("doc_id in (0, 1)").withColumn("text", F.lit(None).cast("string")))
    assert {r.prob for r in blank.collect()} == {1.0}


def test_query_equals_sql(spark, sf, same_rows):
    same_rows(queries.op2_mixing(spark, sf), queries.ORACLES["op2_mixing"])
