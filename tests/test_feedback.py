"""Feedback over member tables and in streams, waiting rows, and neighbours by buckets."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from outlyer.operators import active, forest, joins, members, neighbours
from outlyer.sources import readers
from outlyer.streaming import buffer
from outlyer.streaming.detector import StreamConfig
from outlyer.streaming.feedback import FeedbackConfig, FeedbackDetector, far_nominals, window_asked


def _points(spark, n=300, odd=12, seed=0, first=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(0, 1, (n, 2))
    x[:odd] += 6
    y = (np.arange(n) < odd).astype(int)
    p = rng.permutation(n)
    frame = pd.DataFrame({"id": np.arange(first, first + n), "a": x[p, 0], "b": x[p, 1], "y": y[p]})
    return spark.createDataFrame(frame)


def _labels(rows):
    known = {r.id: r.y for r in rows.collect()}
    return known.__getitem__


# member tables


@pytest.mark.parametrize("prior", [True, False])
def test_learning_few_weights_equals_learning_all(prior):
    rng = np.random.default_rng(1)
    m, names = 30, [f"m{k}" for k in range(30)]
    x = np.where(rng.random((6, m)) < 0.2, rng.random((6, m)), 0.0)
    y, cfg = np.array([1, 0, 1, 0, 0, 1]), active.Config(epochs=60, prior=prior)
    w0 = active.uniform_weights(m)
    dense = active.update(w0, x[:5], y[:5], 0.2, cfg, x[5], w0)
    dense = active.update(dense, x, y, 0.25, cfg, x[5], w0)
    seen = lambda z: np.flatnonzero((z != 0).any(0))
    w = start = members.Weights.uniform(m)
    for rows, lab, q in ((x, y[:5], 0.2), (x, y, 0.25)):
        cols = seen(rows)
        w = members.learn(w, start, [names[k] for k in cols], rows[: len(lab)][:, cols], lab, q, cfg, rows[5][cols])
    assert np.allclose(w.of(names), dense, atol=1e-9) and len(w.known) < m


def test_session_over_leaves_asks_what_the_forest_session_asks(spark):
    rows = _points(spark)
    model = forest.Model.of(forest.fit(rows, ["a", "b"], trees=8, samples=64, depth=5), ["a", "b"])
    values, cfg = model.region_scores("inverse_length", 64), active.Config(budget=4, batch=2, epochs=40)
    label_of = _labels(rows)
    old = active.Session(rows, model, values, cfg).run(label_of)
    table = members.forest_members(rows, model, values / np.linalg.norm(values))
    new = members.Session(table, len(values), cfg).run(label_of)
    assert new.asked == old.asked and new.labels == old.labels
    assert np.isclose(new.history[-1]["q_tau"], old.history[-1]["q_tau"])


@pytest.mark.parametrize("kind", ["loda", "scores", "rs"])
def test_every_ensemble_goes_through_one_session(spark, kind):
    rows = _points(spark)
    settings = {"trees": 10, "samples": 64, "depth": 5} if kind == "rs" else {}
    table, n = members.ensemble(kind, rows, ["a", "b"], **settings)
    assert sorted(table.columns) == ["id", "member", "value"]
    state = members.Session(table, n, active.Config(budget=6, batch=3, epochs=30)).run(_labels(rows))
    assert len(set(state.asked)) == 6 and sum(state.labels) >= 3


def test_pretraining_keeps_the_best_auc(spark):
    rows = _points(spark)
    table, n = members.ensemble("isolation", rows, ["a", "b"], trees=8, samples=64, depth=5)
    best, past = members.pretrain(table, rows.select("id", "y"), members.Weights.uniform(n), active.Config(epochs=30), 2)
    again = members.summary(table, best).join(rows.select("id", "y"), "id").select("id", (-F.col("score")).alias("score"), "y")
    from outlyer.operators.metrics import auc

    assert len(past) == 3 and np.isclose(auc(again, "score").first().auc, max(past))
    only = rows.where("y = 1").select("id", "y")
    assert members.pretrain(table, only, members.Weights.uniform(n), active.Config(), 2)[1] == []


# streams


def _stream_in(spark, folder, k):
    _points(spark, 120, 5, seed=k, first=k * 120).coalesce(1).write.mode("append").parquet(folder)


def _runner(spark, tmp, name, answers, sure=False):
    truth = {}
    for k in range(6):
        truth |= {r.id: r.y for r in _points(spark, 120, 5, seed=k, first=k * 120).select("id", "y").collect()}

    def answer(ids):
        answers.extend(ids)
        return {i: truth[i] for i in ids}

    initial = _points(spark, 30, 4, seed=99, first=10_000)
    fb = FeedbackConfig(least=1, most=2, budget=8, sure=sure, nominals=2, pretraining=1, learn=active.Config(epochs=15))
    det = FeedbackDetector(["a", "b"], str(tmp / name), answer, StreamConfig(trees=5, samples=40, depth=4, keep=60, least_rows=100), fb, initial)

    def run(src):
        stream = readers.stream(spark, src, "id long, a double, b double, y long", files=1)
        q = stream.writeStream.foreachBatch(det.handler).option("checkpointLocation", str(tmp / f"{name}-cp")).trigger(availableNow=True).start()
        q.awaitTermination()

    return det, run


def test_restarted_stream_asks_what_an_unbroken_one_asks(spark, tmp_path):
    src, early = str(tmp_path / "in"), str(tmp_path / "early")
    one, two = [], []
    det, run = _runner(spark, tmp_path, "whole", one)
    det2, run2 = _runner(spark, tmp_path, "broken", two)
    for k in range(6):
        _stream_in(spark, src, k)
        run(src)
    for k in range(3):
        _stream_in(spark, early, k)
        run2(early)
    # the fourth window is cut off before its end, with one answer given
    class Gone(Exception):
        pass

    calls = det2.answer

    def breaks(ids):
        if len(two) == 7:
            raise Gone
        return calls(ids)

    det2.answer = breaks
    _stream_in(spark, early, 3)
    with pytest.raises(Exception, match="Gone"):
        run2(early)
    det3, run3 = _runner(spark, tmp_path, "broken", two)
    run3(early)
    for k in (4, 5):
        _stream_in(spark, early, k)
        run3(early)
    assert one == two and len(one) == 8 == len(set(one))
    labels = spark.read.parquet(str(tmp_path / "broken/v5/labels"))
    assert labels.where("window >= 0").count() == 8 and labels.where("window < 0").count() == 6
    asked = {r.id for r in labels.where("window >= 0").collect()}
    assert asked == set(one) and not {r.id for r in spark.read.parquet(str(tmp_path / "broken/v5/rows")).select("id").collect()} & asked
    # a batch that comes again gives the same state and asks nothing
    before = sorted(map(tuple, spark.read.parquet(str(tmp_path / "broken/v5/weights")).collect()), key=str)
    det3.process(_points(spark, 120, 5, seed=5, first=600), 5)
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "broken/v5/weights")).collect()), key=str) == before and len(two) == 8


def test_confidence_and_last_window(spark, tmp_path):
    asked = []
    det, _ = _runner(spark, tmp_path, "sure", asked, sure=True)
    det.process(_points(spark, 120, 5, seed=0), 0)
    assert 1 <= len(asked) <= 2
    det.last_window = True
    det.feedback = FeedbackConfig(least=1, most=2, budget=6, learn=active.Config(epochs=10))
    det.process(_points(spark, 120, 5, seed=1, first=120), 1)
    assert len(asked) == 6


def test_window_asked_by_rank_and_confidence(spark):
    scored = spark.createDataFrame([(k, 10.0 - k, 0.0 if k % 2 else 4.0) for k in range(40)], "id long, score double, variance double")
    cfg = FeedbackConfig(least=1, most=6, sure=True, width=3.0)
    got = [(r.id, r.turn) for r in window_asked(scored, spark.createDataFrame([(0,)], "id long"), 0.03, cfg).orderBy("turn").collect()]
    # the tenth of what has no label scores -1 less one: rows of deviation 2 fall below it from the third on
    assert got == [(1, 1), (2, 2), (3, 3), (5, 5)] or got[0] == (1, 1) and {i for i, _ in got} >= {1, 3, 5}


def test_far_nominals(spark):
    rows = spark.createDataFrame([(1, 1, 0.0), (2, 0, 1.0), (3, 0, 5.0), (4, 0, 5.0), (5, 0, -4.0), (6, 1, 0.5)], "id long, y int, a double")
    assert sorted(r.id for r in far_nominals(rows, ["a"], 1).collect()) == [1, 3, 6]
    assert sorted(r.id for r in far_nominals(rows, ["a"], 2).collect()) == [1, 3, 5, 6]
    assert sorted(r.id for r in far_nominals(rows, ["a"], 0).collect()) == [1, 6]


def test_rows_wait_for_full_windows(spark, tmp_path):
    before = spark.conf.get(buffer.STORE[0])
    spark.conf.set(*buffer.STORE)
    try:
        rng = np.random.default_rng(4)
        t0 = pd.Timestamp("2024-01-01")
        n = 90
        ts = np.sort(rng.integers(0, 3_000, n))
        frame = pd.DataFrame({"id": np.arange(n), "k": rng.choice(["x", "y", "z"], n), "ts": [t0 + pd.Timedelta(seconds=int(s)) for s in ts], "v": rng.normal(size=n)})
        late = frame.iloc[[10, 40]]  # come a file later, within the watermark
        rest = frame.drop(late.index)
        cuts = np.array_split(np.arange(len(rest)), 5)
        src, out = str(tmp_path / "in"), str(tmp_path / "out")
        schema = "id long, k string, ts timestamp, v double"
        very_late = pd.DataFrame({"id": [999], "k": ["x"], "ts": [t0], "v": [0.0]})
        for c, at in enumerate(cuts):
            part = rest.iloc[at]
            lo, hi = part.index.min(), part.index.max()
            prior = late[(late.index < lo) & (late.index >= (rest.iloc[cuts[c - 1]].index.min() if c else 0))]
            parts = [part, prior] + ([very_late] if c == 4 else [])
            spark.createDataFrame(pd.concat(parts), schema).coalesce(1).write.mode("append").parquet(src)
            stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
            q = buffer.buffered(stream, "k", "ts", "id", 4, "20 minutes").writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
            q.awaitTermination()  # each file is read by a query of its own
        got = sorted((r.k, r.win, r.id) for r in spark.read.parquet(out).collect())
        table = spark.createDataFrame(frame, schema)
        want = sorted((r.k, r.win, r.id) for r in buffer.buffered_table(table, "k", "ts", "id", 4, "20 minutes").collect())
        assert got == want and len(want) > 20
    finally:
        spark.conf.set(buffer.STORE[0], before)


# neighbours


def test_neighbours_by_buckets_find_nine_in_ten(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    rows = e.select(F.col("event_id").alias("id"), F.array(F.col("value"), F.hour("ts").cast("double"), F.regexp_extract("props", r"(\d+)", 1).cast("double")).alias("x"))
    points = neighbours.points_of(rows)
    found = neighbours.knn(points, 10)
    assert found.groupBy("id").count().where("count <> 10").count() == 0
    asked = points.where("id % 20 = 0")
    exact = joins.nearest(points, asked, 11).where("id <> other").groupBy("id").agg(F.slice(F.sort_array(F.collect_list(F.struct("d2", "other"))), 1, 10).alias("n")).select("id", F.explode("n.other").alias("other"))
    assert neighbours.recall(found, exact) >= 0.9
    plan = found._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_vectors_find_nine_in_ten(spark, sf):
    v = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("x"))
    points = neighbours.points_of(v)
    exact = joins.nearest(points, points.where("id % 20 = 0"), 6).where("id <> other").where("pos <= 6").select("id", "other")
    assert neighbours.recall(neighbours.knn(points, 5, tables=24), exact) >= 0.9


def test_lof_against_brute_force_with_copies(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(0, 1, (150, 2)), [[9.0, 9.0], [-8.0, 7.0]]])
    rows = [(k, list(map(float, v))) for k, v in enumerate(x)] + [(1000 + k, [9.0, 9.0]) for k in range(5)] + [(2000, None)]
    got = {r.id: r.lof for r in neighbours.local_outlier_factor(spark.createDataFrame(rows, "id long, x array<double>"), 5).collect()}
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, 1)[:, :5]
    kd = np.take_along_axis(d, near, 1).max(1)
    lrd = 1 / np.maximum(np.take_along_axis(d, near, 1), kd[near]).mean(1)
    want = lrd[near].mean(1) / lrd
    assert len(got) == 157 and all(np.isclose(got[k], want[k]) for k in range(152)) and all(np.isclose(got[1000 + k], want[150]) for k in range(5))
    one = spark.createDataFrame([(1, [0.0]), (2, [0.0])], "id long, x array<double>")
    assert [r.lof for r in neighbours.local_outlier_factor(one).collect()] == [1.0, 1.0]
    assert neighbours.local_outlier_factor(one.limit(0)).count() == 0


def test_neighbours_are_merged_by_more_tasks_the_more_rows(spark, monkeypatch):
    """Shuffles of a search and of the outlier factor have parts in proportion to the rows, and give the same."""
    rows = spark.createDataFrame([(i, [float(i * i % 101), float(i % 37)]) for i in range(300)], "id long, x array<double>")
    wanted = {r.id: r.lof for r in neighbours.local_outlier_factor(rows, 5).collect()}
    key, parts, compare = "spark.sql.shuffle.partitions", [], neighbours.compare
    before = spark.conf.get(key)

    def seen(buckets, k):
        parts.append(int(spark.conf.get(key)))
        return compare(buckets, k)

    monkeypatch.setattr(neighbours, "compare", seen)
    monkeypatch.setattr(neighbours, "TASK_ROWS", 300, raising=False)
    got = {r.id: r.lof for r in neighbours.local_outlier_factor(rows, 5).collect()}
    points = neighbours.points_of(rows).count()
    assert parts == [max(int(before), -(-points * 6 * 5 // 300))] and parts[0] > int(before)
    assert spark.conf.get(key) == before and all(abs(got[i] - v) < 1e-9 for i, v in wanted.items()) and len(got) == 300
