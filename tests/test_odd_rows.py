"""Queries over odd rows of their tables."""

import datetime

import duckdb
import pytest
from conftest import canonical

from outlyer.plans import registry


@pytest.mark.parametrize("value", [0.0, None, 3.0])
def test_unit_rows_of_zero_and_missing_vectors(spark, tmp_path, value):
    at = datetime.datetime(2024, 1, 1)
    rows = [(0, 1, at, "view", value, '{"k": 0}'), (1, 1, at.replace(hour=5), "view", 2.0, '{"k": 7}'), (2, 1, None, "view", 2.0, '{"k": 7}')]
    spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp_ntz, event_type string, value double, props string").write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    got, want = registry.QUERIES["pf4_unit_rows"](spark, str(tmp_path)), con.sql(registry.ORACLES["pf4_unit_rows"])
    assert canonical([tuple(r) for r in got.collect()], got.columns) == canonical(want.fetchall(), want.columns)
