"""The pipeline on small tables, stage by stage, against what each stage decides."""

import pytest

import corpus_pipeline as P
from outlyer.llm import decontamination, mixing, near_dedup, quality
from outlyer.llm.common import scratch

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, f in P.STAGES:
        nxt = scratch(f(spark, docs, SF), name)
        out.append((name, docs, nxt))
        docs = nxt
    return out


def ids(df):
    return [r.doc_id for r in df.select("doc_id").collect()]


def test_stages_keep_rows_and_columns(stages):
    for name, before, after in stages:
        assert set(ids(after)) <= set(ids(before)) and len(ids(after)) == len(set(ids(after)))
        assert after.columns == before.columns + (["shard", "slot"] if name == "sharding" else [])


def test_decisions_take_effect(spark, stages):
    before, after = {n: b for n, b, _ in stages}, {n: a for n, _, a in stages}
    model = quality.fit(before["quality"], spark.read.parquet(f"{SF}/labels.parquet"))
    assert sorted(ids(quality.score(before["quality"], model).where("score >= 0.3"))) == sorted(ids(after["quality"]))
    assert sorted(ids(near_dedup.groups(before["near_dedup"]).where("kept"))) == sorted(ids(after["near_dedup"]))
    found = decontamination.leaks(before["decontamination"], spark.read.parquet(f"{SF}/benchmark.parquet"))
    assert set(ids(before["decontamination"])) - set(ids(after["decontamination"])) == {r.doc for r in found.collect()}
    mixed = mixing.calibrated(before["mixing"], P.mix_dims(), P.MIX_POWERS).where("sampled")
    assert sorted(ids(mixed)) == sorted(ids(after["mixing"]))
    assert sorted(ids(before["sharding"])) == sorted(ids(after["sharding"])) and after["sharding"].where("shard is null").count() == 0


def test_run_gives_the_last_stage(spark, stages):
    last = {(r.doc_id, r.shard, r.slot) for r in stages[-1][2].collect()}
    assert {(r.doc_id, r.shard, r.slot) for r in P.run(spark, SF).collect()} == last


def test_empty_table(spark, stages):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, f in P.STAGES:
        docs = scratch(f(spark, docs, SF), name)
    assert docs.count() == 0


def test_own_columns_come_through_untouched(spark):
    """Columns named as operators name theirs, null ids, ties, repeated rows and odd texts."""
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = ["score", "predicted", "held_out", "tokens", "prob", "weight", "sampled", "mix_source", "topic", "class_id", "kept"]
    own = docs.select("*", *(F.concat(F.lit(n), F.col("doc_id").cast("string")).alias(n) for n in names))
    odd = docs.where("doc_id < 3").select(F.lit(None).cast("long").alias("doc_id"), *docs.columns[1:], *(F.lit(f"odd {n}").alias(n) for n in names))
    rows = scratch(own.unionByName(odd).unionByName(own.where("doc_id = 5")), "own")
    for name, f in P.STAGES[:-1]:
        after = scratch(f(spark, rows, SF), name)
        assert after.columns == rows.columns
        for r in after.select("doc_id", *names).collect():
            assert all(r[n] == (f"odd {n}" if r.doc_id is None else f"{n}{r.doc_id}") for n in names)
        rows = after
    assert 0 < rows.count() < own.count()
