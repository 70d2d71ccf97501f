"""Operators against brute force on small rows."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from outlyer.operators import active, describe, drift, forest, graph, joins, learn, loda, metrics, relevance, select, series
from outlyer.sources import readers, sinks


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(size=(300, 2)), rng.normal(6, 0.3, (12, 2))])
    return spark.createDataFrame(pd.DataFrame({"id": range(312), "a": x[:, 0], "b": x[:, 1], "y": [0] * 300 + [1] * 12}))


FIXED = [(0, 0, 1, 2, 0, 2.0, 5, 0, 0.0), (0, 1, -1, -1, -1, 0.0, 2, 1, 0.0), (0, 2, 3, 4, 1, 1.0, 3, 1, 0.0), (0, 3, -1, -1, -1, 0.0, 1, 2, 0.0), (0, 4, -1, -1, -1, 0.0, 2, 2, 0.0)]


def test_fixed_tree_routes(spark):
    nodes = spark.createDataFrame(FIXED, forest.NODES)
    rows = spark.createDataFrame([(0, 1.0, 0.0), (1, 2.0, 5.0), (2, 3.0, 1.0), (3, 3.0, 2.0), (4, 9.0, 9.0)], "id long, a double, b double")
    model = forest.Model.of(nodes, ["a", "b"])
    got = {r.id: r.leaves[0] for r in forest.route(rows, model).collect()}
    assert got == {0: 1, 1: 1, 2: 3, 3: 4, 4: 4}
    edge = joins.in_regions(spark.createDataFrame([(0, 2.0, 0.0)], "id long, a double, b double"), forest.regions(nodes, ["a", "b"]), ["a", "b"])
    assert {r.region for r in edge.collect()} == {"0:1", "0:3"}


@pytest.mark.parametrize("kind", forest.KINDS)
def test_forests_find_the_far_group(points, kind):
    grown = forest.fit(points, ["a", "b"], kind, trees=20, samples=15, depth=8)
    model = forest.Model.of(grown, ["a", "b"])
    assert len(model.trees) == 20 and (model.left >= 0).sum() * 2 == (model.left >= 0).sum() + (model.left < 0).sum() - 20
    if kind == "isolation":
        scored = forest.isolation_score(points, model, 15).select("y", (-F.col("score")).alias("score"), "id")
        assert metrics.auc(scored.withColumn("y", F.col("y")), "score").first().auc > 0.9


def test_auc_by_hand(spark):
    rows = spark.createDataFrame(list(zip(range(6), [0, 1, 0, 0, 1, 0], [2.0, 2.0, 3.0, 4.0, 2.0, 6.0])), "id long, y int, score double")
    assert metrics.auc(rows, "score").first().auc == pytest.approx(0.75)


def test_budgets():
    assert [metrics.budget_size(1, t, 10) for t in (0.5, 1.5, 2.5)] == [0, 2, 2]
    assert drift.tau_again(1, 10, 0.03) == pytest.approx(0.11) and drift.tau_again(0, 10, 0.03) == 0.03
    assert select.rearrange(10, 2, 9) == [0, 1, 9, 2, 3, 4, 5, 6, 7, 8]


def test_series_by_hand(spark):
    rows = spark.createDataFrame([(0, t, float(t + 1)) for t in range(7)], "s int, t int, v double")
    assert [r.shingle for r in series.shingles(rows, ["s"], ["t"], "v", 3, 2).orderBy("start").collect()] == [[1, 2, 3], [3, 4, 5], [5, 6, 7], [7, 0, 0]]
    assert [r.lags for r in series.lags(rows, ["s"], ["t"], "v", 3).orderBy("t").collect()][:4] == [[0, 0, 1], [0, 1, 2], [1, 2, 3], [2, 3, 4]]
    assert [r["diff"] for r in series.difference(rows, ["s"], ["t"], "v").orderBy("t").collect()] == [0, 1, 1, 1, 1, 1, 1]


def test_as_of(spark):
    starts = spark.createDataFrame([(0, 0, "A"), (0, 30, "B"), (0, 65, "C")], "g int, t int, label string")
    rows = spark.createDataFrame([(0, t) for t in (0, 29, 30, 64, 65, 90)], "g int, t int")
    assert [r.label for r in joins.as_of(rows, starts, ["g"]).orderBy("t").collect()] == list("AABBCC")


def test_rolling_forecast_of_a_line(spark):
    rows = spark.createDataFrame([(0, t, 3.0 * t + 1) for t in range(60)], "s int, t int, v double")
    assert series.rolling_errors(rows, ["s"], "t", "v", p=2, d=1).agg(F.max("error")).first()[0] < 1e-6


def test_divergence(spark):
    p, q = (spark.createDataFrame([(0, k, v) for k, v in enumerate(d)], "tree int, node int, p double") for d in ((0.4, 0.2, 0.4), (0.25, 0.25, 0.5)))
    assert drift.divergence(p, q).first().kl == pytest.approx(0.054115, abs=1e-6)


def test_loda_scores_far_points(points):
    rows = points.withColumn("x", F.array("a", "b"))
    proj, hist = loda.fit(rows, 2, 4, 12)
    scored = loda.score(loda.densities(loda.project(rows, proj), hist)).join(rows.select("id", "y"), "id")
    assert metrics.auc(scored.withColumn("score", -F.col("score")), "score").first().auc > 0.8


def test_gradient_matches_differences():
    rng = np.random.default_rng(0)
    x, y, w, w0 = rng.normal(size=(20, 5)), rng.integers(0, 2, 20), rng.normal(size=5), rng.normal(size=5)
    cfg = active.Config()
    g = active.gradient(w, x, y, 0.1, cfg, x[0], w0)
    for k in range(5):
        e = np.zeros(5)
        e[k] = 1e-6
        d = (active.loss(w + e, x, y, 0.1, cfg, x[0], w0) - active.loss(w - e, x, y, 0.1, cfg, x[0], w0)) / 2e-6
        assert d == pytest.approx(g[k], abs=1e-3)


@pytest.mark.parametrize("strategy", sorted(active.STRATEGIES))
def test_feedback_session(points, strategy):
    model = forest.Model.of(forest.fit(points, ["a", "b"], trees=15, samples=20, depth=6), ["a", "b"])
    session = active.Session(points, model, model.region_scores("inverse_length", 20), active.Config(budget=3, batch=1, explore=4, epochs=20), strategy)
    state = session.run(lambda i: int(i >= 300))
    assert len(set(state.asked)) == 3 and np.linalg.norm(state.w) == pytest.approx(1)


def test_cover_is_cheapest():
    rng = np.random.default_rng(5)
    for _ in range(20):
        sets = [set(np.flatnonzero(rng.random(7) < 0.4).tolist()) for _ in range(8)]
        sets = [s for s in sets if s]
        costs = rng.random(len(sets)).tolist()
        chosen, proven = describe.cover(sets, costs)
        whole = set().union(*sets)
        best = min(sum(costs[k] for k in range(len(sets)) if m >> k & 1) for m in range(1 << len(sets)) if set().union(*(sets[k] for k in range(len(sets)) if m >> k & 1)) == whole)
        assert proven and sum(costs[k] for k in chosen) == pytest.approx(best)


def test_ruleset_annealing():
    y = np.array([1] * 10 + [0] * 30)
    covered = np.zeros((40, 4), int)
    covered[:6, 0] = covered[4:10, 1] = covered[8:30, 2] = covered[20:, 3] = 1
    assert describe.bayesian_ruleset(covered, y, [1, 1, 1, 1]) == [0, 1]


def test_compact_description(spark, points):
    nodes = forest.fit(points, ["a", "b"], trees=5, samples=60, depth=6)
    found = describe.describe(points, points.where("y = 1").select("id"), forest.regions(nodes, ["a", "b"]), ["a", "b"], points.where("y = 0"))
    assert found and all(d["precision"] > 0.2 for d in found)


def test_nearest_and_hops(spark):
    rows = spark.createDataFrame([(k, [float(k), 0.0]) for k in range(10)], "id long, x array<double>")
    near = joins.nearest(rows, rows, 3)
    assert {(r.other, r.pos) for r in near.where("id = 0").collect()} == {(0, 1), (1, 2), (2, 3)}
    ring = graph.demo_graph(spark)
    got = {r.node: r.hop for r in joins.within_hops(ring, spark.createDataFrame([(0,)], "node long"), 2).collect()}
    assert got == {0: 0, 1: 1, 11: 1, 6: 1, 2: 2, 10: 2, 5: 2, 7: 2}
    hat = graph.normalised(ring)
    assert hat.where("src = 0 and dst = 6").first().w == pytest.approx(1 / 3)
    assert graph.sample_edges(ring, 0.5).count() % 2 == 0


def test_network_follows_feedback():
    rng = np.random.default_rng(1)
    x = rng.uniform(-1, 1, (60, 2))
    scores = np.column_stack([x[:, 0] > 0, x[:, 0] <= 0]).astype(float)
    y = (x[:, 0] > 0).astype(int)
    net = relevance.train(relevance.Network.start(2, 2), x, x, scores, y, 0.6, active.Config(), epochs=300)
    r = net.relevance(x)
    assert (r * scores).sum(1)[y == 1].mean() > (r * scores).sum(1)[y == 0].mean()


def test_learners(points):
    for kind in ("tree", "logistic", "svm"):
        model = learn.fit(points, ["a", "b"], kind)
        assert learn.predict(points, ["a", "b"], model).where("prediction <> y").count() <= 3
    x = np.array([[0, 0], [0, 1], [3, 3], [4, 3]])
    w = learn.perceptron(x, np.array([-1, -1, 1, 1]), 20)
    assert list(np.sign(x @ w[:-1] + w[-1])) == [-1, -1, 1, 1]


def test_files(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "toy_1.csv").write_text("label,x,y\nnominal,1,2\nanomaly,5,6\n")
    (tmp_path / "a.arff").write_text("@relation r\n@attribute x real\n@data\n1,2\n3,4\n")
    (tmp_path / "rules.txt").write_text(" x > 1 \n\ny < 2\n")
    df = readers.with_line_numbers(readers.read_csv(spark, str(tmp_path / "d" / "toy_1.csv")), "id")
    m = readers.labelled_matrix(df, "label", ["x", "y"])
    assert [(r.id, r.y, r.x) for r in m.orderBy("id").collect()] == [(0, 0, [1.0, 2.0]), (1, 1, [5.0, 6.0])]
    assert [r.value for r in readers.read_arff(spark, str(tmp_path / "a.arff")).orderBy("line").collect()] == ["1,2", "3,4"]
    assert {r.rule for r in readers.read_rules(spark, str(tmp_path / "rules.txt")).collect()} == {"x > 1", "y < 2"}
    assert readers.read_runs(spark, str(tmp_path / "d" / "*.csv")).select("fid").distinct().first().fid == 1
    sinks.write_model(str(tmp_path / "m"), rows=df)
    assert sinks.read_model(spark, str(tmp_path / "m"), "rows")[0].count() == 2
    sinks.write_rules(spark.createDataFrame([("top", 1, "x > 1")], "kind string, iter int, rule string"), str(tmp_path / "r"))
    assert readers.read_rules(spark, str(tmp_path / "r" / "kind=top" / "iter=1")).first().rule == "x > 1"
    lines = sinks.matrix_lines(spark.createDataFrame([(0, 1, 2.0)], "id long, member int, value double"), 3)
    assert lines.first().value == "0.000000e+00,2.000000e+00,0.000000e+00"
    assert math.isclose(sinks.wide(spark.createDataFrame([(0, 0, 0, 4.0)], "fid int, run int, iter int, value double"), 2).first().v1, 5)
