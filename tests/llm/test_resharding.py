import itertools
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from outlyer.llm import resharding as R


def test_flow_moves_fewest_bytes():
    rng = np.random.default_rng(0)
    for _ in range(30):
        old, new = int(rng.integers(1, 6)), int(rng.integers(1, 7))
        supply = {i: int(rng.integers(0, 50)) for i in range(old)}
        capacity = R.even_capacities(sum(supply.values()), new)
        flow = R.min_cost_flow(supply, capacity)
        assert all(sum(n for (i, _), n in flow.items() if i == k) == supply[k] for k in supply)
        assert all(sum(n for (_, j), n in flow.items() if j == k) <= capacity[k] for k in capacity)
        assert sum(n for (i, j), n in flow.items() if i != j) == sum(supply.values()) - sum(min(supply[k], capacity.get(k, 0)) for k in supply)


def test_flow_with_other_costs():
    cost = {(0, 0): 5, (0, 1): 1, (1, 0): 1, (1, 1): 4}
    supply, capacity = {0: 3, 1: 2}, {0: 3, 1: 2}
    flow = R.min_cost_flow(supply, capacity, lambda i, j: cost[i, j])
    best = min(5 * a + (3 - a) + (3 - a) + 4 * (2 - (3 - a)) for a in range(4) if 0 <= 3 - a <= 2)
    assert sum(n * cost[k] for k, n in flow.items()) == best
    with pytest.raises(ValueError):
        R.min_cost_flow({0: 3}, {0: 2})


def check(df, got, shards):
    rows = df.select("doc_id", "text").collect()
    assert sorted((str(r.doc_id), len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode())) for r in rows) == sorted((str(r.doc_id), r.size, r.text_crc32) for r in got)
    for _, own in itertools.groupby(sorted(got, key=lambda r: r.shard), key=lambda r: r.shard):
        slots = sorted(r.slot for r in own)
        assert slots == list(range(len(slots)))
    assert all(0 <= r.shard < shards for r in got)


def test_sizes_near_equal(make, monkeypatch):
    rng = np.random.default_rng(1)
    df = make(["é" * int(n) for n in rng.integers(0, 60, 3000)])
    monkeypatch.setattr(R, "BLOCK_ROWS", 16)
    got = R.reshard(df, R.hash_layout(5), shards=8).collect()
    check(df, got, 8)
    total = [sum(r.size for r in got if r.shard == k) for k in range(8)]
    assert max(total) - min(total) <= 4 * max(r.size for r in got)
    old = {k: sum(r.size for r in got if r.old_shard == k) for k in range(5)}
    moved = sum(r.size for r in got if r.shard != r.old_shard)
    assert moved <= sum(max(0, s - sum(total) // 8) for s in old.values()) + 5 * 8 * max(r.size for r in got)


def test_odd_rows(odd, empty):
    check(odd, R.reshard(odd, R.hash_layout(3), shards=4).collect(), 4)
    assert R.reshard(empty, R.hash_layout(3), shards=4).count() == 0
    out = R.assign(odd, R.hash_layout(3), shards=4)
    assert out.count() == odd.count() and set(odd.columns) <= set(out.columns) and out.where("shard is null").count() == 0


def test_fewest_moves_is_a_least_flow():
    rng = np.random.default_rng(4)
    for _ in range(200):
        supply = {i: int(rng.integers(0, 30)) for i in range(int(rng.integers(1, 7)))}
        capacity = {j: int(rng.integers(0, 30)) for j in range(int(rng.integers(1, 8)))}
        capacity[0] += max(0, sum(supply.values()) - sum(capacity.values()))
        flow, best = R.fewest_moves(supply, capacity), R.min_cost_flow(supply, capacity)
        moved = lambda f: sum(n for (i, j), n in f.items() if i != j)
        assert moved(flow) == moved(best)
        assert all(sum(n for (i, _), n in flow.items() if i == k) == supply[k] for k in supply)
        assert all(sum(n for (_, j), n in flow.items() if j == k) <= capacity[k] for k in capacity)


def test_every_row_has_its_own_place(odd, make):
    rows = make([(1, "a"), (1, "a"), (1, "b"), (None, "c"), (None, "c"), (None, "d"), (7, "e"), (8, None)])
    for df in (odd, rows):
        out = R.assign(df, R.hash_layout(3), shards=4)
        places = [(r.shard, r.slot) for r in out.collect()]
        assert len(places) == df.count() and len(set(places)) == len(places)
        for k in {s for s, _ in places}:
            assert sorted(b for a, b in places if a == k) == list(range(sum(a == k for a, _ in places)))
        key = lambda d: sorted((str(r.doc_id), str(r.text), str(r.h)) for r in d.collect())
        assert key(out) == key(df)


def test_a_live_table_keeps_its_rows(make, tmp_path, spark):
    df = make([(1, "a"), (1, "a"), (None, "b"), (2, "c")] + [(k, "t" * 10) for k in range(10, 46)]).withColumn("old", F.pmod(F.coalesce("doc_id", F.lit(1)), F.lit(2)).cast("int"))
    target = str(tmp_path / "live")
    df.withColumnRenamed("old", "shard").withColumn("slot", F.lit(0).cast("long")).write.partitionBy("shard").parquet(target)
    live = spark.read.parquet(target)
    placed = R.assign(live.drop("slot").withColumnRenamed("shard", "was"), F.col("was"), keep_old=True, capacities={0: 10**6, 2: 10**6}, cost=lambda i, j: 0 if (i, j) in ((0, 0), (1, 2)) else 1)
    before = sorted((str(r.doc_id), r.text) for r in live.collect())
    affected = {r.shard: (r.rows_in, r.rows_out) for r in R.rewrite_affected(placed, target).collect()}
    spark.catalog.refreshByPath(target)
    after = spark.read.parquet(target)
    assert set(affected) == {1, 2} and affected[1][0] == 0 and affected[2][1] == 0
    assert sorted((str(r.doc_id), r.text) for r in after.collect()) == before
    assert {r.shard for r in after.select("shard").distinct().collect()} == {0, 2}
    still = R.assign(after.drop("slot").withColumnRenamed("shard", "was"), F.col("was"), keep_old=True, capacities={0: 10**6, 2: 10**6})
    assert R.rewrite_affected(still, target).count() == 0 and spark.read.parquet(target).count() == len(before)
