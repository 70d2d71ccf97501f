"""Models over large tables: fitted and scored by scans that keep a few numbers, not by rows of their own."""

import numpy as np
import pandas as pd

from outlyer.operators import describe, loda, members, relevance


def _rows(spark, n=3000):
    x = np.random.default_rng(5).normal(size=(n, 3))
    x[:40] = x[0]
    return spark.createDataFrame(pd.DataFrame({"id": np.arange(n), "x": x.tolist()}), "id long, x array<double>")


def test_projections_are_fitted_and_scored_without_a_row_each(spark, monkeypatch):
    missing = spark.createDataFrame([(9000, None), (9001, [1.0, None, 2.0]), (9002, [float("nan"), 0.0, 0.0])], "id long, x array<double>")
    for rows in (_rows(spark), _rows(spark).unionAll(missing)):
        proj = loda.projections(spark, 3, 12)
        long = loda.project(rows, proj)
        hist = loda.histograms(long)
        want = {r.proj: (r.lo, r.width, r.bins, r.density) for r in hist.collect()}
        assert repr(sorted({r.proj: (r.lo, r.width, r.bins, r.density) for r in loda.histograms_of(rows, proj).collect()}.items())) == repr(sorted(want.items()))
        score = dict(loda.score(loda.densities(long, hist)).collect())
        got = dict(loda.row_scores(rows, proj, hist).select("id", "score").collect())
        assert got.keys() == score.keys() and all(np.isclose(got[k], score[k], rtol=1e-12, atol=0, equal_nan=True) for k in got)
    monkeypatch.setattr(loda, "project", None)  # a row for each row and projection
    proj, hist = loda.fit(_rows(spark), 3)
    assert proj.count() == hist.count() >= 5
    assert members.loda_members(_rows(spark), proj, hist).count() == 3000 * proj.count()


def test_values_by_name_are_those_of_the_member_table(spark):
    rows = _rows(spark).selectExpr("id", "x[0] AS a", "x[1] AS b", "x[2] AS c")
    table, n = members.ensemble("loda", rows, ["a", "b", "c"], least=12)
    wide, m = members.loda_values(rows, ["a", "b", "c"], least=12)
    assert n == m >= 12  # "10" stands before "2"
    want = dict(relevance.as_arrays(table, rows.selectExpr("id", "array(a) AS x")).select("id", "values").collect())
    assert dict(wide.select("id", "values").collect()) == want


def test_mined_rules_count_rows_with_the_same_items_once(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.uniform(size=(4000, 2))
    rows = spark.createDataFrame(pd.DataFrame({"y": ((x[:, 0] > 0.75) & (x[:, 1] < 0.5)).astype(int), "a": x[:, 0], "b": x[:, 1]}))
    held, written = {}, describe.written
    monkeypatch.setattr(describe, "written", lambda df, tag: held.setdefault(tag, written(df, tag)))
    rules = describe.mined_rules(rows, ["a", "b"], levels=(2, 4))
    assert held["cells"].count() == 16 and held["cells"].selectExpr("sum(c)").first()[0] == 4000
    assert "a" in rules[0] and "b" in rules[0]  # of precision 1, by counts over all rows
