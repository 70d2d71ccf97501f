"""The corpus queries at the smallest size; those with SQL give its rows."""

import pytest

from outlyer.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_rows_as_sql(name, spark, sf, same_rows):
    same_rows(queries.QUERIES[name](spark, sf), queries.ORACLES[name])


def test_resharding_digest(spark, sf):
    got = queries.op4_resharding(spark, sf)
    assert {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"} <= set(got.columns)
    rows = got.collect()
    assert {r.law for r in rows} == {"bytes"} and all(r.grown_shard is None and 0 <= r.shard < 40 for r in rows)
