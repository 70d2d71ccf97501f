"""Nearest rows by blocks against brute force."""

import numpy as np
import pandas as pd
import pytest

from outlyer.operators import joins


def brute(x, ids, asked, k):
    out = []
    for q in asked:
        d2 = np.zeros(len(x))
        for f in range(x.shape[1]):
            d2 += (x[q, f] - x[:, f]) ** 2
        out += [(ids[q], ids[j], d2[j], p + 1) for p, j in enumerate(np.lexsort((ids, d2))[:k])]
    return sorted(out)


@pytest.mark.parametrize("copies", [1, 40])
def test_blocks_give_the_nearest_rows_exactly(spark, monkeypatch, copies):
    monkeypatch.setattr(joins, "BLOCK_ROWS", 300)
    monkeypatch.setattr(joins, "BLOCK_QUERIES", 37)
    rng = np.random.default_rng(copies)
    # far from the origin, so that distances by products of matrices are rough
    x = np.repeat(rng.normal(size=(2000 // copies, 8)) + 1e5, copies, 0)
    ids = rng.permutation(len(x))
    rows = spark.createDataFrame(pd.DataFrame({"id": ids, "x": x.tolist()}), "id long, x array<double>")
    got = joins.nearest(rows, rows.where("id % 20 = 0"), 5)
    assert sorted((r.id, r.other, r.d2, r.pos) for r in got.collect()) == brute(x, ids, np.flatnonzero(ids % 20 == 0), 5)


def test_a_task_never_sees_more_than_a_block(spark, monkeypatch):
    monkeypatch.setattr(joins, "BLOCK_ROWS", 100)
    rows = spark.range(1000).selectExpr("id", "array(double(id), 0D) AS x")
    assert joins.nearest(rows, rows.where("id < 10"), 3).count() == 30
    plan = joins.nearest(rows, rows.where("id < 10"), 3)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_missing_vectors_are_last(spark):
    rows = spark.createDataFrame([(0, [0.0, 0.0]), (1, None), (2, [3.0, None]), (3, [1.0]), (4, [9.0, 0.0]), (5, [1.0, 1.0])], "id int, x array<double>")
    got = joins.nearest(rows, rows.where("id = 0"), 4).collect()
    assert sorted((r.pos, r.other, r.d2) for r in got) == [(1, 0, 0.0), (2, 5, 2.0), (3, 4, 81.0), (4, 1, None)]
    assert joins.nearest(rows.where("id > 9"), rows, 2).count() == 0


def test_ids_may_be_text(spark):
    rows = spark.createDataFrame([(c, [float(k)]) for k, c in enumerate("aabbcé")], "id string, x array<double>")
    assert [r.other for r in joins.nearest(rows, rows.where("id = 'c'"), 2).orderBy("pos").collect()] == ["c", "b"]
