"""Queries over series, streams in their batch form, and graphs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from outlyer.functions.tables import written
from outlyer.operators import graph, joins, series
from outlyer.plans.registry import query
from outlyer.plans.rows import _NEAR, NEAR_ALL
from outlyer.plans.views import table
from outlyer.plans.views import vectors as vecs
from outlyer.streaming import windows

_W = "(PARTITION BY user_id ORDER BY event_id)"


def events(spark, sf):
    return table(spark, sf, "events").select("user_id", "event_id", "value", "event_type", "ts")


@query("wn9_difference", f"SELECT event_id AS id, round(coalesce(value - lag(value) OVER {_W}, 0), 6) AS diff FROM events")
def wn9(spark, sf):
    return series.difference(events(spark, sf), ["user_id"], ["event_id"], "value").select(F.col("event_id").alias("id"), F.round("diff", 6).alias("diff"))


@query("wn10_undifference", f"SELECT event_id AS id, round(value - first_value(value) OVER {_W} + 5, 4) AS restored FROM events")
def wn10(spark, sf):
    d = series.difference(events(spark, sf), ["user_id"], ["event_id"], "value")
    return series.undifference(d, ["user_id"], ["event_id"], "diff", F.lit(5.0)).select(F.col("event_id").alias("id"), F.round("restored", 4).alias("restored"))


@query("wn11_lags", f"SELECT event_id AS id, round(coalesce(lag(value, 2) OVER {_W}, 0) + 10 * coalesce(lag(value, 1) OVER {_W}, 0) + 100 * value, 4) AS mixed FROM events")
def wn11(spark, sf):
    lagged = series.lags(events(spark, sf), ["user_id"], ["event_id"], "value", 3)
    return lagged.select(F.col("event_id").alias("id"), F.round(F.col("lags")[0] + 10 * F.col("lags")[1] + 100 * F.col("lags")[2], 4).alias("mixed"))


@query("wn12_shingles", f"SELECT user_id, k - 1 AS start, round(a + b + c, 4) AS total FROM (SELECT user_id, row_number() OVER {_W} AS k, value AS a, coalesce(lead(value, 1) OVER {_W}, 0) AS b, coalesce(lead(value, 2) OVER {_W}, 0) AS c FROM events) WHERE (k - 1) % 2 = 0")
def wn12(spark, sf):
    s = series.shingles(events(spark, sf), ["user_id"], ["event_id"], "value", 3, 2)
    return s.select("user_id", F.col("start").cast("long").alias("start"), F.round(F.aggregate("shingle", F.lit(0.0), lambda a, v: a + v), 4).alias("total"))


@query("wn13_next_step", f"SELECT event_id AS id, now, next FROM (SELECT event_id, value AS now, lead(value) OVER {_W} AS next FROM events) WHERE next IS NOT NULL")
def wn13(spark, sf):
    return series.next_step(events(spark, sf), ["user_id"], ["event_id"], "value").select(F.col("event_id").alias("id"), "now", "next")


@query("wn14_batches", f"SELECT event_id AS id, (row_number() OVER {_W} - 1) // 25 AS batch FROM events")
def wn14(spark, sf):
    from outlyer.operators.select import batches

    return batches(events(spark, sf), ["user_id"], ["event_id"], 25).select(F.col("event_id").alias("id"), "batch")


@query("ts2_autocorrelation", "WITH d AS (SELECT user_id, event_id, value - avg(value) OVER (PARTITION BY user_id) AS d FROM events), l AS (SELECT user_id, d, " + ", ".join(f"lag(d, {k}) OVER {_W} AS d{k}" for k in range(1, 6)) + " FROM d), a AS (SELECT user_id, sum(d * d) AS c0, " + ", ".join(f"sum(d * d{k}) AS c{k}" for k in range(1, 6)) + " FROM l GROUP BY user_id) SELECT user_id, unnest([1, 2, 3, 4, 5]) AS lag, round(unnest([" + ", ".join(f"coalesce(c{k}, 0) / c0" for k in range(1, 6)) + "]), 5) AS acf FROM a WHERE c0 > 0")
def ts2(spark, sf):
    return series.autocorrelation(events(spark, sf), ["user_id"], ["event_id"], "value", 5).select("user_id", "lag", F.round("acf", 5).alias("acf"))


@query("ts2_rolling_errors")
def ts2b(spark, sf):
    return series.rolling_errors(events(spark, sf), ["user_id"], "event_id", "value", p=3, d=1)


_PAST = f"d AS (SELECT user_id, event_id, value, value - lag(value) OVER {_W} AS y FROM events), l AS (SELECT *, lag(y, 1) OVER {_W} AS y1, lag(y, 2) OVER {_W} AS y2 FROM d)"


@query(
    "ts1_normal_equations",
    f"WITH {_PAST} SELECT user_id, count(*) AS rows, " + ", ".join(f"round(sum({e}), 4) AS {n}" for n, e in (("s1", "y1"), ("s11", "y1 * y1"), ("s2", "y2"), ("s21", "y2 * y1"), ("s22", "y2 * y2"), ("b0", "y"), ("b1", "y1 * y"), ("b2", "y2 * y")))
    + " FROM l WHERE y1 IS NOT NULL AND y2 IS NOT NULL AND y IS NOT NULL GROUP BY user_id",
)
def ts1_normal(spark, sf):
    """The normal equations of an AR(2) on each user's differenced values."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    rows = events(spark, sf).withColumn("y", F.col("value") - F.lag("value").over(w))
    rows = rows.withColumn("y1", F.lag("y", 1).over(w)).withColumn("y2", F.lag("y", 2).over(w))
    eq = series.normal_equations(rows, ["user_id"], ["y1", "y2"], "y")
    at = {"s1": ("a", 1), "s11": ("a", 2), "s2": ("a", 3), "s21": ("a", 4), "s22": ("a", 5), "b0": ("b", 0), "b1": ("b", 1), "b2": ("b", 2)}
    return eq.select("user_id", "rows", *((F.round(F.col(c)[k], 4) + 0.0).alias(n) for n, (c, k) in at.items()))


@query("ts1_arma")
def ts1(spark, sf):
    """ARMA(2, 1) of each user's differenced values."""
    weights, _ = series.arma(events(spark, sf), ["user_id"], "event_id", "value", p=2, q=1, d=1)
    return weights


@query(
    "ts2_rolling_ar1",
    "WITH s AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS pos, count(*) OVER (PARTITION BY user_id) AS n FROM events), "
    "d AS (SELECT *, value - lag(value) OVER w AS y, lag(value) OVER w AS before FROM s WINDOW w AS (PARTITION BY user_id ORDER BY event_id)), l AS (SELECT *, lag(y) OVER (PARTITION BY user_id ORDER BY event_id) AS y1 FROM d), "
    "f AS (SELECT user_id, regr_slope(y, y1) AS a, regr_intercept(y, y1) AS b FROM l WHERE pos < floor(n * CAST(0.66 AS DOUBLE)) AND y1 IS NOT NULL GROUP BY user_id) "
    "SELECT user_id, CAST(pos AS INTEGER) AS step, round(value, 4) AS actual, round(before + b + a * y1, 3) AS forecast FROM l JOIN f USING (user_id) WHERE pos >= floor(n * CAST(0.66 AS DOUBLE)) AND floor(n * CAST(0.66 AS DOUBLE)) > 4",
)
def ts2_ar1(spark, sf):
    out = series.rolling_errors(events(spark, sf), ["user_id"], "event_id", "value", p=1, d=1)
    return out.select("user_id", "step", F.round("actual", 4).alias("actual"), F.round("forecast", 3).alias("forecast"))


@query("ts3_regression_errors")
def ts3(spark, sf):
    return series.regression_errors(events(spark, sf), ["user_id"], ["event_id"], "value", 5)


@query("ts7_skip_grams", f"WITH a AS (SELECT event_type AS centre, unnest([lag(event_type, 1) OVER {_W}, lead(event_type, 1) OVER {_W}, lag(event_type, 2) OVER {_W}, lead(event_type, 2) OVER {_W}]) AS context FROM events) SELECT centre, context, count(*) AS n FROM a WHERE context IS NOT NULL GROUP BY ALL")
def ts7(spark, sf):
    return series.skip_grams(events(spark, sf), ["user_id"], ["event_id"], "event_type").groupBy("centre", "context").agg(F.count(F.lit(1)).alias("n"))


@query("ts8_simulated_activities")
def ts8(spark, sf):
    return series.simulate_activities(spark, 20, 300)


@query("ts9_last_value", "SELECT user_id, unnest([1, 2, 3]) AS step, v AS forecast FROM (SELECT user_id, arg_max(value, event_id) AS v FROM events GROUP BY user_id)")
def ts9(spark, sf):
    return series.last_value_forecast(events(spark, sf), ["user_id"], "event_id", "value", 3)


@query("sm1_count_windows", f"SELECT event_id AS id, (row_number() OVER {_W} - 1) // 16 AS win FROM events")
def sm1(spark, sf):
    return windows.count_windows(events(spark, sf), ["user_id"], ["event_id"], 16).select(F.col("event_id").alias("id"), "win")


@query("sm3_retention", "SELECT event_id AS id, value AS score FROM events ORDER BY value DESC, event_id LIMIT 100")
def sm3(spark, sf):
    e = events(spark, sf).select(F.col("event_id").alias("id"), F.col("value").alias("score"))
    kept = windows.keep_top(e.limit(0), e.where("id % 2 = 0"), "score", 100)
    return windows.keep_top(kept, e.where("id % 2 = 1"), "score", 100)


@query("sm15_tumbling", "SELECT event_type, strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def sm15(spark, sf):
    out = windows.tumbling(events(spark, sf), "ts", "1 hour", ["event_type"])
    return out.select("event_type", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n", F.round("total", 4).alias("total"))


@query("sm15_sliding", "SELECT event_type, strftime(time_bucket(INTERVAL 1 HOUR, ts) - k * INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n, round(sum(value), 4) AS total FROM events, (VALUES (0), (1)) AS t(k) GROUP BY ALL")
def sm15b(spark, sf):
    out = windows.sliding(events(spark, sf), "ts", "2 hours", "1 hour", ["event_type"])
    return out.select("event_type", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n", F.round("total", 4).alias("total"))


@query(
    "sm15_sessions",
    "WITH g AS (SELECT user_id, ts, CAST(coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 2 HOUR, true) AS INTEGER) AS new FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) "
    "SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS start, count(*) AS n FROM s GROUP BY user_id, k",
)
def sm15c(spark, sf):
    out = windows.sessions(events(spark, sf), "ts", "2 hours", ["user_id"])
    return out.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("start"), "n")


_BOTH = "e AS (SELECT DISTINCT src, dst, CAST(1 AS DOUBLE) AS w FROM (SELECT id AS src, other AS dst FROM near WHERE id <> other UNION ALL SELECT other, id FROM near WHERE id <> other))"
_EDGES = f"{_NEAR}, {_BOTH}"


def edges(spark, sf):
    """Edges from the vectors whose SQL asks for them."""
    v = vecs(spark, sf)
    # kept, as graphs are read several times and the search is the work
    return written(joins.adjacency(joins.nearest(v, v.where("id % 20 = 0"), 5)), "edges")


def all_edges(spark, sf):
    """Edges from all vectors."""
    v = vecs(spark, sf)
    return written(joins.adjacency(joins.nearest(v, v, 5)), "edges")


_WEIGHTS = "g AS (SELECT src, sum(w) AS d FROM e GROUP BY src), hat AS (SELECT e.src, e.dst, e.w / sqrt(a.d * b.d) AS w FROM e JOIN g a ON a.src = e.src JOIN g b ON b.src = e.dst)"
_HAT = f"{_EDGES}, {_WEIGHTS}"


@query("gr1_normalised", f"WITH {NEAR_ALL}, {_BOTH}, {_WEIGHTS} SELECT src, dst, round(w, 6) AS w FROM hat")
def gr1(spark, sf):
    return graph.normalised(all_edges(spark, sf)).select("src", "dst", F.round("w", 6).alias("w"))


@query("gr2_propagated", f"WITH {_HAT} SELECT src AS id, round(sum(w * v.x[1]), 6) AS first FROM hat JOIN vec v ON v.id = hat.dst GROUP BY src")
def gr2(spark, sf):
    out = graph.propagate(graph.normalised(edges(spark, sf)), vecs(spark, sf).select("id", "x"))
    return out.select("id", F.round(F.col("x")[0], 6).alias("first"))


@query("gr2_classified")
def gr2b(spark, sf):
    nodes = vecs(spark, sf).withColumn("y", F.when(F.col("id") % 3 == 0, F.col("label")))
    return graph.margins(graph.probabilities(graph.classify(all_edges(spark, sf), nodes, 10, epochs=100)))


#: Edges of three members, normalised.
_HAT3 = f"{_EDGES}, e3 AS (SELECT m AS member, src, dst, w FROM e, (SELECT unnest([0, 1, 2]) AS m) WHERE src < dst AND ((src * 1000003 + dst) * 2654435761 + 42 + m * 7919) % 2147483647 < CAST(0.7 AS DOUBLE) * 2147483647), u AS (SELECT * FROM e3 UNION ALL SELECT member, dst, src, w FROM e3), g3 AS (SELECT member, src, sum(w) AS d FROM u GROUP BY ALL), h3 AS (SELECT u.member, u.src, u.dst, u.w / sqrt(a.d * b.d) AS w FROM u JOIN g3 a ON a.member = u.member AND a.src = u.src JOIN g3 b ON b.member = u.member AND b.src = u.dst)"


@query(
    "gr4_mean_logits",
    f"WITH {_HAT3}, x1 AS (SELECT h.member, h.src AS id, sum(h.w * v.x[1]) AS a, sum(h.w * v.x[2]) AS b FROM h3 h JOIN vec v ON v.id = h.dst GROUP BY ALL), x2 AS (SELECT h.member, h.src AS id, sum(h.w * a) AS a, sum(h.w * b) AS b FROM h3 h JOIN x1 ON x1.member = h.member AND x1.id = h.dst GROUP BY ALL) "
    "SELECT id, round(avg(2 * a - b + 0.1::DOUBLE), 6) AS l0, round(avg(3 * b - a - 0.2::DOUBLE), 6) AS l1 FROM x2 GROUP BY id",
)
def gr4(spark, sf):
    """Mean logits of three members, each over its own edges, at weights given by their numbers."""
    nodes = vecs(spark, sf).select("id", F.slice("x", 1, 2).alias("x"))
    smooth = graph.smoothed(graph.member_edges(edges(spark, sf), 3, 0.7), nodes, 2)
    out = graph.mean_logits(graph.linear_logits(smooth, np.array([[2.0, -1.0], [-1.0, 3.0]]), np.array([0.1, -0.2])).select("id", "logits"))
    return out.select("id", *(F.round(F.col("logits")[k], 6).alias(f"l{k}") for k in (0, 1)))


@query("gr4_ensemble")
def gr4_ensemble(spark, sf):
    """Likeliest labels by the mean of three fitted members."""
    nodes = vecs(spark, sf).withColumn("y", F.when(F.col("id") % 3 == 0, F.col("label")))
    return graph.margins(graph.probabilities(graph.mean_logits(graph.ensemble(graph.member_edges(all_edges(spark, sf), 3, 0.7), nodes, 10, epochs=20).select("id", "logits"))))


@query("gr3_errors", "SELECT round(avg(CASE WHEN id % 3 = 0 THEN 1 - h END), 6) AS error, round(avg(CASE WHEN id % 3 <> 0 THEN h END), 6) AS micro_f1 FROM (SELECT vec_id AS id, CAST(label = vec_id % 10 AS DOUBLE) AS h FROM embeddings)")
def gr3(spark, sf):
    v = vecs(spark, sf)
    out = graph.errors(v.select("id", (F.col("id") % 10).alias("label")), v.select("id", F.col("label").alias("y"), (F.col("id") % 3 == 0).alias("labelled")))
    return out.select(F.round("error", 6).alias("error"), F.round("micro_f1", 6).alias("micro_f1"))


@query("gr5_attack_candidates", f"WITH {_HAT}, r1 AS (SELECT dst AS node, sum(w) AS i FROM hat WHERE src = 0 GROUP BY dst), r2 AS (SELECT dst AS node, sum(i * w) AS i FROM r1 JOIN hat ON node = src GROUP BY dst) SELECT CAST(node AS BIGINT) AS node, round(i, 6) AS influence FROM r2 WHERE node <> 0")
def gr5(spark, sf):
    return graph.suggest_attack(edges(spark, sf), vecs(spark, sf), 0, 2, 10_000).select("node", F.round("influence", 6).alias("influence"))


@query("dt21_label_diffusion")
def dt21(spark, sf):
    y = vecs(spark, sf).select("id", F.when(F.col("id") < 50, (F.col("label") == 3).cast("double")).alias("y"))
    return graph.diffusion(all_edges(spark, sf), y, rounds=3)


@query("jn11_sampled_edges", f"WITH {_EDGES}, k AS (SELECT src, dst, w FROM e WHERE src < dst AND ((src * 1000003 + dst) * 2654435761 + 42) % 2147483647 < 0.5 * 2147483647) SELECT src, dst, w FROM k UNION ALL SELECT dst, src, w FROM k")
def jn11(spark, sf):
    return graph.sample_edges(edges(spark, sf), 0.5)


@query("ts4_shingle_outliers")
def ts4(spark, sf):
    from outlyer.operators import forest

    rows = series.shingle_rows(events(spark, sf), ["user_id"], ["event_id"], "value", 4, 2)
    names = [f"x{k}" for k in range(4)]
    model = forest.Model.of(forest.fit(rows, names, trees=30), names)
    return forest.isolation_score(rows, model).select("user_id", "start", "score").orderBy(F.col("score").desc(), "user_id", "start").limit(10)


@query("ts6_label_centroids", "SELECT label, round(avg(embedding[1]), 5) AS first, round(avg(embedding[64]), 5) AS last FROM embeddings GROUP BY label")
def ts6(spark, sf):
    c = series.label_centroids(vecs(spark, sf), "label", "x")
    return c.select("label", F.round(F.col("centre")[0], 5).alias("first"), F.round(F.col("centre")[63], 5).alias("last"))


@query("gr7_margins", "WITH e AS (SELECT vec_id AS id, [embedding[1], embedding[2], embedding[3]] AS l FROM embeddings), x AS (SELECT id, unnest([0, 1, 2]) AS label, exp(CAST(unnest(l) AS DOUBLE)) AS p FROM e), r AS (SELECT id, label, p / sum(p) OVER (PARTITION BY id) AS p, row_number() OVER (PARTITION BY id ORDER BY p DESC, label) AS k FROM x) SELECT id, max(label) FILTER (k = 1) AS first, max(label) FILTER (k = 2) AS second, round(max(p) FILTER (k = 1) - max(p) FILTER (k = 2), 6) AS margin FROM r GROUP BY id")
def gr7(spark, sf):
    probs = graph.probabilities(vecs(spark, sf).select("id", F.slice("x", 1, 3).alias("logits")))
    return graph.margins(probs).select("id", "first", "second", F.round("margin", 6).alias("margin"))
