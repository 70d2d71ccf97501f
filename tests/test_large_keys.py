"""Draws over ids of any size."""

import pytest
from pyspark.sql import functions as F

from outlyer.functions.ranking import arithmetic_order
from outlyer.operators import graph

P = 2147483647


@pytest.fixture(scope="module")
def wide(spark):
    ids = [0, 3, 3475, 51281, 3_000_000_000, 2**62]
    return spark.createDataFrame([(a, b, 1.0) for a in ids for b in ids if a != b], "src long, dst long, w double")


def test_sampled_edges_draw_without_overflow(wide):
    want = {(a, b) for a, b, _ in wide.collect() if ((min(a, b) * 1000003 + max(a, b)) * 2654435761 + 42) % P < 0.5 * P}
    assert {(r.src, r.dst) for r in graph.sample_edges(wide, 0.5).collect()} == want


def test_members_draw_without_overflow(wide):
    want = {(m, a, b) for m in range(3) for a, b, _ in wide.collect() if ((min(a, b) * 1000003 + max(a, b)) * 2654435761 + 42 + m * 7919) % P < 0.7 * P}
    assert {(r.member, r.src, r.dst) for r in graph.member_edges(wide, 3, 0.7).collect()} == want


def test_order_of_large_ids(wide):
    rows = wide.select(F.col("src").alias("id")).distinct().withColumn("k", arithmetic_order("id")).collect()
    assert all(r.k == (r.id * 2654435761 + 42) % P for r in rows)
