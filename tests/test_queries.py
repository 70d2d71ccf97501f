"""Every registered query runs; those with SQL give its rows."""

import pytest

from outlyer.plans import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_rows_as_sql(name, spark, sf, same_rows):
    same_rows(registry.QUERIES[name](spark, sf), registry.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs(name, spark, sf):
    rows = registry.QUERIES[name](spark, sf).collect()
    assert rows


def test_entry_has_rows(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 20
    assert set(entry.oracle_sql()) <= set(entry.queries())
