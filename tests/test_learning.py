"""Series models, relevance trained on rows, member trees, covers and per-tree draws."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from outlyer.operators import active, describe, forest, members, relevance, series


def _series(spark, values, s="a"):
    frame = pd.concat([pd.DataFrame({"s": s_, "t": np.arange(len(v)), "v": v}) for s_, v in (values.items() if isinstance(values, dict) else [(s, values)])])
    return spark.createDataFrame(frame, "s string, t long, v double")


def _arma(n, phi, theta, seed, season=0, sphi=0.0):
    rng = np.random.default_rng(seed)
    e = rng.normal(size=n + 200)
    y = np.zeros(n + 200)
    for t in range(12, n + 200):
        y[t] = phi * y[t - 1] + sphi * (y[t - season] if season else 0.0) + e[t] + theta * e[t - 1]
    return y[200:]


@pytest.mark.parametrize("block", [500, 50_000])
def test_arma_weights_on_simulated_series(spark, block):
    rows = _series(spark, {"a": _arma(6000, 0.6, 0.4, 1), "b": _arma(6000, -0.3, 0.5, 2)})
    weights, _ = series.arma(rows, ["s"], "t", "v", p=1, q=1, block=block)
    got = {r.s: dict(zip(r.names, r.w, strict=True)) for r in weights.collect()}
    assert abs(got["a"]["y1"] - 0.6) < 0.05 and abs(got["a"]["e1"] - 0.4) < 0.06
    assert abs(got["b"]["y1"] + 0.3) < 0.07 and abs(got["b"]["e1"] - 0.5) < 0.07


def test_blocks_change_nothing(spark):
    rows = _series(spark, {"a": _arma(700, 0.6, 0.4, 1), "b": _arma(90, 0.6, 0.4, 3)})
    kw = dict(p=2, q=1, d=1, season=7, train=0.7)
    whole = {(r.s, r.step): r.forecast for r in series.rolling_errors(rows, ["s"], "t", "v", **kw).collect()}
    cut = {(r.s, r.step): r.forecast for r in series.rolling_errors(rows, ["s"], "t", "v", block=40, **kw).collect()}
    assert len(whole) == 211 + 28 and whole.keys() == cut.keys()  # the first 489 and 62 are for learning
    assert all(np.isclose(whole[k], cut[k], rtol=1e-6, atol=1e-6) for k in whole)


def test_seasonal_term_and_difference(spark):
    y = _arma(5000, 0.3, 0.0, 5, season=12, sphi=0.5)
    weights, _ = series.arma(_series(spark, y), ["s"], "t", "v", p=1, season=0, seasonal=False)
    w = dict(zip(*[(r.names, r.w) for r in series.arma(_series(spark, y), ["s"], "t", "v", p=1, season=12, seasonal=True, d=0)[0].collect()][0], strict=True))
    assert set(w) == {"1", "y1", "y12"} and weights.count() == 1
    t = np.arange(400)
    wave = _series(spark, 3.0 * t + 10 * np.sin(2 * np.pi * t / 12))
    assert series.rolling_errors(wave, ["s"], "t", "v", p=1, d=1, season=12).agg(F.max("error")).first()[0] < 1e-6
    assert series.rolling_errors(_series(spark, np.arange(4.0)), ["s"], "t", "v").count() == 0


# relevance


def test_gradient_on_rows_equals_differences(spark):
    rng = np.random.default_rng(0)
    x, v, y = rng.normal(size=(40, 3)), rng.random((40, 2)), rng.choice([-1, 0, 1], 40, p=[0.6, 0.2, 0.2])
    net = relevance.Network.start(3, 2, 4, 0.4, 7)
    shares, q, prior = (0.02, 0.1, 0.05), 0.45, 0.4

    def loss(flat):
        p = net.moved(flat).relevance(x)
        s = (p * v).sum(1)
        ce = -(prior * np.log(p) + (1 - prior) * np.log(1 - p)).sum(1)
        return (shares[0] * ce[y < 0]).sum() + (shares[1] * np.maximum(q - s, 0)[y == 1]).sum() + (shares[2] * np.maximum(s - q, 0)[y == 0]).sum()

    flat = np.concatenate([p.ravel() for p in net.parameters()])
    rows = spark.createDataFrame([(a.tolist(), b.tolist(), None if c < 0 else int(c)) for a, b, c in zip(x, v, y, strict=True)], "x array<double>, values array<double>, y int").repartition(5)
    got = {r.k: r.g for r in relevance.gradient(rows, net, q, shares, prior).collect()}
    for k in range(len(flat)):
        step = np.zeros_like(flat)
        step[k] = 1e-6
        assert np.isclose(got[k], (loss(flat + step) - loss(flat - step)) / 2e-6, atol=1e-6)


def test_feedback_finds_more_than_unweighted_scores(spark):
    rng = np.random.default_rng(3)
    n = 300
    x = rng.uniform(-1, 1, (n, 2))
    odd = np.flatnonzero(x[:, 0] > 0.4)[:20]
    values = rng.random((n, 2)) * 0.6
    values[odd, 0] = rng.uniform(0.7, 1.0, len(odd))  # the first member knows them, on the right
    noisy = np.flatnonzero(x[:, 0] < -0.2)
    values[noisy, 1] = rng.uniform(0.6, 1.3, len(noisy))  # the second cries wolf on the left
    y = np.isin(np.arange(n), odd).astype(int)
    rows = spark.createDataFrame([(k, x[k].tolist(), values[k].tolist()) for k in range(n)], "id long, x array<double>, values array<double>").repartition(4)
    plain = y[np.argsort(-values.sum(1), kind="stable")[:15]].sum()
    session = relevance.Session(rows, 2, 2, active.Config(budget=15, batch=3, seed=1), epochs=12)
    session.run(lambda i: int(y[i]))
    assert len(session.asked) == 15 and sum(session.labels) > plain


def test_member_trees_against_brute_force(spark):
    rng = np.random.default_rng(5)
    x = rng.random((200, 2))
    rows = spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(x)], "id long, a double, b double")
    truth = {0: (x[:, 0] > 0.5) & (x[:, 1] < 0.3), 1: x[:, 1] > 0.7, 2: np.zeros(200, bool)}
    targets = spark.createDataFrame([(m, k, int(t[k])) for m, t in truth.items() for k in range(200)], "member int, id long, y int")
    places, ranges = relevance.binned(rows, ["a", "b"])
    leaves = relevance.member_trees(places, ["a", "b"], targets, 2).collect()
    assert {m: sum(r.n for r in leaves if r.member == m) for m in truth} == {0: 200, 1: 200, 2: 200}
    cell = {r.id: (r.b_a, r.b_b) for r in places.collect()}
    for r in leaves:
        inside = [k for k, (a, b) in cell.items() if r.lo_a <= a <= r.hi_a and r.lo_b <= b <= r.hi_b]
        assert len(inside) == r.n and sum(truth[r.member][k] for k in inside) == r.pos
    rules = relevance.member_rules(relevance.member_trees(places, ["a", "b"], targets, 2), ["a", "b"], ranges).collect()
    from outlyer.functions import rules as R

    for r in rules:
        got = R.confusion(rows.join(targets.where(F.col("member") == r.member).select("id", "y"), "id"), [r.rule]).first()
        assert (got.tp, got.fp) == (r.tp, r.fp) and r.tp > r.fp
    assert {r.member for r in rules} == {0, 1}


# covers


def _cost(chosen, costs):
    return sum(costs[c] for c in chosen)


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_greedy_cover_within_its_bound(spark, seed, monkeypatch):
    rng = np.random.default_rng(seed)
    sets = [sorted({int(r) for r in rng.choice(9, rng.integers(1, 4))}) for _ in range(25)]
    costs = {f"r{k}": float(c) for k, c in enumerate(rng.uniform(0.5, 3, 9))}
    pairs = spark.createDataFrame([(k, f"r{r}") for k, s in enumerate(sets) for r in s], "id long, region string")
    price = spark.createDataFrame(list(costs.items()), "region string, volume double")
    best = min(
        (m for m in range(512) if all(any(m >> r & 1 for r in s) for s in sets)), key=lambda m: sum(costs[f"r{r}"] for r in range(9) if m >> r & 1)
    )
    least = sum(costs[f"r{r}"] for r in range(9) if best >> r & 1)
    assert np.isclose(_cost(describe.compact_regions(pairs, price), costs), least)
    monkeypatch.setattr(describe, "EXACT_SETS", 0)
    greedy = describe.compact_regions(pairs, price)
    assert all(any(f"r{r}" in greedy for r in s) for s in sets)
    most = max(sum(r in s for s in sets) for r in range(9))
    assert least - 1e-9 <= _cost(greedy, costs) <= least * sum(1 / k for k in range(1, most + 1)) + 1e-9


def test_subspace_query_spreads_over_regions(spark):
    table = spark.createDataFrame(
        [(0, "a", 1.0), (0, "x", 1.0), (1, "a", 0.9), (1, "x", 1.0), (2, "b", 0.8), (2, "x", 1.0), (3, "a", 0.7), (3, "x", 1.0), (4, "c", 0.1), (4, "x", 1.0)], "id long, member string, value double"
    )
    costs = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("c", 1.0), ("x", 50.0)], "region string, volume double")
    session = members.Session(table, 4, active.Config(budget=3, batch=3, explore=4, epochs=5), "subspace", costs=costs)
    assert session.step(lambda i: i % 2)[:3] and set(session.state.asked) >= {0, 2}


def test_each_tree_draws_its_own_rows(spark):
    rng = np.random.default_rng(8)
    few = spark.createDataFrame(pd.DataFrame({"id": np.arange(60), "a": rng.normal(size=60)}))
    nodes = forest.fit(few, ["a"], trees=20, samples=40, depth=4)
    roots = nodes.where("node = 0").collect()
    assert len(roots) == 20 and {r.n for r in roots} == {40}
    assert len({r.threshold for r in roots}) > 10
    many = spark.createDataFrame(pd.DataFrame({"id": np.arange(5000), "a": rng.normal(size=5000)}))
    assert {r.n for r in forest.fit(many, ["a"], trees=10, samples=32, depth=3).where("node = 0").collect()} == {32}


# rules, comparison, graphs


def _brute_patterns(rows, features, ranges, support, levels=(2, 4)):
    from itertools import product

    odd = [r for r in rows if r["y"] == 1]
    counts = {}
    for r in odd:
        options = []
        for f in features:
            lo, hi = ranges[f]
            options.append([None] + [f"{f}:{n}:{max(0, min(n - 1, int((r[f] - lo) // ((hi - lo) / n))))}" for n in levels])
        for pick in product(*options):
            items = tuple(sorted(i for i in pick if i))
            if items:
                counts[items] = counts.get(items, 0) + 1
    return {k: v for k, v in counts.items() if v >= support * len(odd)}


def test_mined_patterns_equal_brute_force_and_rules_hold(spark):
    rng = np.random.default_rng(6)
    x = rng.random((300, 2))
    x[0], x[1] = 0.0, 1.0  # so that parts of the ranges are quarters
    y = ((x[:, 0] > 0.75) & (x[:, 1] < 0.5)).astype(int)
    rows = spark.createDataFrame([(int(c), float(a), float(b)) for (a, b), c in zip(x, y, strict=True)], "y int, a double, b double").repartition(3)
    marked, ranges = describe.interval_items(rows, ["a", "b"])
    got = {tuple(r["items"]): r.freq for r in describe.mined_patterns(marked, 0.3).collect()}
    assert got == _brute_patterns([r.asDict() for r in rows.collect()], ["a", "b"], ranges, 0.3)
    rules = describe.mined_rules(rows, ["a", "b"], 0.3)
    assert 0 < len(rules) <= 60
    from outlyer.functions import rules as R

    cover = describe.coverage_patterns(rows, rules).collect()
    assert sum(r.n for r in cover) == 300
    for k, rule in enumerate(rules):
        c = R.confusion(rows.withColumn("id", F.monotonically_increasing_id()), [rule]).first()
        assert c.tp == sum(r.n for r in cover if r.covered >> k & 1 and r.y) and c.fp == sum(r.n for r in cover if r.covered >> k & 1 and not r.y)
    chosen = describe.bayesian_rules(rows, ["a", "b"], 0.3, steps=300)
    scores = R.ruleset_scores(rows.withColumn("id", F.monotonically_increasing_id()), chosen).first()
    assert chosen and scores.recall > 0.9
    assert describe.bayesian_rules(rows.where("y = 0"), ["a", "b"]) == []


def test_curves_of_detector_and_classifier(spark):
    from outlyer.operators import compare

    rng = np.random.default_rng(2)
    x = rng.normal(0, 1, (400, 2))
    x[:40] += 5
    rows = spark.createDataFrame([(k, int(k < 40), float(a), float(b)) for k, (a, b) in enumerate(x)], "id long, y int, a double, b double").repartition(3)
    curves = compare.detector_against_classifier(rows, ["a", "b"], 2, 80, 15, active.Config(epochs=30), trees=15, depth=5, samples=64).collect()
    assert len(curves) == 2 * 2 * 15
    for m in ("detector", "classifier"):
        for run in (0, 1):
            one = [r.found for r in sorted(curves, key=lambda r: r.k) if r.run == run and r.method == m]
            assert one == sorted(one) and one[-1] >= 10
    given = spark.createDataFrame([(0, k, k % 2, float(-k), float(k)) for k in range(10)], "run int, id long, y int, up double, down double")
    got = {(r.method, r.k): r.found for r in compare.paired_curves(given, ["up", "down"], 4).collect()}
    assert [got["up", k] for k in range(1, 5)] == [0, 1, 1, 2] and [got["down", k] for k in range(1, 5)] == [1, 1, 2, 2]


def test_members_of_a_graph_go_together(spark):
    from outlyer.operators import graph

    rng = np.random.default_rng(4)
    n = 40
    pairs = {(a, b) for a in range(n) for b in range(a + 1, n) if rng.random() < (0.3 if a % 2 == b % 2 else 0.02)} | {(k, k) for k in range(n)}
    edges = spark.createDataFrame([(a, b, 1.0) for a, b in pairs] + [(b, a, 1.0) for a, b in pairs if a != b], "src long, dst long, w double")
    x = rng.normal(size=(n, 2)) + np.array([[1.0, -1.0] if k % 2 else [-1.0, 1.0] for k in range(n)])
    nodes = spark.createDataFrame([(k, x[k].tolist(), k % 2 if k < 20 else None) for k in range(n)], "id long, x array<double>, y int")
    dealt = graph.member_edges(edges, 3, 0.6)
    got = {(r.member, r.id): r.x for r in graph.smoothed(dealt, nodes, 2).collect()}
    for m in range(3):
        a = np.zeros((n, n))
        for r in dealt.where(F.col("member") == m).collect():
            a[r.src, r.dst] = r.w
        assert (a == a.T).all() and 0.4 < (a.sum() - n) / (2 * (len(pairs) - n)) < 0.8
        d = a.sum(1)
        hat = a / np.sqrt(np.outer(d, d))
        assert np.allclose([got[m, k] for k in range(n)], hat @ hat @ x)
    logits = graph.ensemble(dealt, nodes, 3, epochs=30)
    assert logits.count() == 3 * n
    top = {r.id: r["first"] for r in graph.margins(graph.probabilities(graph.mean_logits(logits.select("id", "logits")))).collect()}
    assert sum(top[k] == k % 2 for k in range(20, n)) >= 18
