"""Queries over feedback: rounds of any ensemble, windows of a stream, neighbours."""

from __future__ import annotations

from pyspark.sql import functions as F

from outlyer.functions.ranking import arithmetic_order
from outlyer.operators import active, loda, members, neighbours
from outlyer.plans.models import _BEST, _MEMBERS, _P, _SUMS, _cover_sql, _picks_sql, _projected, _scores, root_volumes
from outlyer.plans.models import members as leaf_members
from outlyer.plans.models import weights as leaf_weights
from outlyer.plans.registry import query
from outlyer.plans.views import FEATURES, INST, instances, vectors
from outlyer.streaming import buffer
from outlyer.streaming.feedback import FeedbackConfig, far_nominals, window_asked

TAU, BATCH = 0.03, 5


def _round(given: str) -> str:
    """SQL of a round over ``given``: WITH parts that end in ``m(id, value, w)``."""
    return f"WITH {given}, s AS (SELECT id, round(sum(value * w), 8) AS score FROM m WHERE value <> 0 GROUP BY id) SELECT id, round(score, 6) AS score, (SELECT round(quantile_cont(score, {1 - TAU}), 6) FROM s) AS q_tau FROM s ORDER BY s.score DESC, id LIMIT {BATCH}"


def _shown(asked):
    return asked.select("id", F.round("score", 6).alias("score"), F.round("q_tau", 6).alias("q_tau"))


@query("al7_forest_round", _round(f"{_MEMBERS}, m AS (SELECT id, value, w FROM member)"))
def al7_forest(spark, sf):
    return _shown(members.one_round(leaf_members(spark, sf).select("id", "member", "value"), leaf_weights(spark), TAU, BATCH))


_LODA_W = [0.2, 0.5, 0.3]


@query("dt13_loda_round", _round(f"{_P}, m AS (SELECT id, -ln(greatest(1e-8, count(*) OVER (PARTITION BY proj, bin) / (n * width))) AS value, CAST([0.2, 0.5, 0.3][proj + 1] AS DOUBLE) AS w FROM b)"))
def dt13_round(spark, sf):
    z = _projected(spark, sf)
    table = loda.densities(z, loda.histograms(z, 20)).select("id", F.col("proj").cast("string").alias("member"), (-F.col("logp")).alias("value"))
    return _shown(members.one_round(table, spark.createDataFrame([(str(p), w) for p, w in enumerate(_LODA_W)], "member string, w double"), TAU, BATCH))


@query("al7_scores_round", _round(f"{INST}, m AS (SELECT id, unnest([x0, x1, x2]) AS value, CAST(unnest([0.2, 0.5, 0.3]) AS DOUBLE) AS w FROM inst)"))
def al7_scores(spark, sf):
    weights = spark.createDataFrame([(f, w) for f, w in zip(FEATURES, _LODA_W, strict=True)], "member string, w double")
    return _shown(members.one_round(members.score_members(instances(spark, sf), FEATURES), weights, TAU, BATCH))


@query("dt13_loda_session")
def dt13_session(spark, sf):
    """Three rounds of feedback over fitted projections: what was asked and found."""
    rows = instances(spark, sf)
    table, n = members.ensemble("loda", rows, FEATURES)
    session = members.Session(table, n, active.Config(budget=6, batch=2, epochs=50))
    known = rows.select("id", "y")
    state = session.run(lambda i: known.where(F.col("id") == i).first().y)
    return spark.createDataFrame([(k, i, y) for k, (i, y) in enumerate(zip(state.asked, state.labels, strict=True))], "pos int, id long, y int")


@query(
    "al16_subspace_query",
    f"WITH {_SUMS}, {_BEST.replace('best AS', 'top AS')}, near AS (SELECT r.id, r.region FROM routed r JOIN top USING (id)), {_cover_sql('near')}, "
    f"masks AS (SELECT t.id, t.pos, CAST(sum((1::BIGINT << k) & best.mask) AS BIGINT) AS m FROM top t JOIN near USING (id) JOIN bit USING (region), best GROUP BY t.id, t.pos), {_picks_sql('masks', 4)}",
)
def al16(spark, sf):
    """Of the twelve best rows four that lie in different regions of a compact cover."""
    best = _scores(spark, sf).orderBy(F.col("score").desc(), "id").limit(12)
    inside = leaf_members(spark, sf).select("id", F.col("member").alias("region"))
    return spark.createDataFrame(list(enumerate(members.subspace_diverse(best, inside, root_volumes(spark, sf), 4))), "pick int, id long")


_ASKS = FeedbackConfig(least=2, most=12, sure=True, width=1.0)


@query(
    "sm11_window_asked",
    f"WITH {INST}, m AS (SELECT id, unnest([x0, x1, x2]) * CAST(unnest([0.2, 0.5, 0.3]) AS DOUBLE) AS v FROM inst), s AS (SELECT id, round(sum(v), 8) AS score, round(var_pop(v), 8) AS variance FROM m WHERE v <> 0 GROUP BY id), f AS (SELECT * FROM s WHERE id % 7 <> 0), "
    f"r AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS turn, count(*) OVER () AS n FROM f), k AS (SELECT least(greatest(round_even(CAST({TAU} AS DOUBLE) * max(n), 0), 10), max(n)) AS k FROM r), "
    f"a AS (SELECT min(score) AS bar FROM r, k WHERE turn <= k + 1) SELECT id, round(score, 6) AS score, CAST(turn AS INTEGER) AS turn FROM r, a WHERE turn <= 12 AND (turn <= 2 OR score - sqrt(variance) >= bar)",
)
def sm11_window(spark, sf):
    """What a window asks of rows with three given scores, at given weights: the two best, and others that are surely high."""
    weights = spark.createDataFrame([(f, w) for f, w in zip(FEATURES, _LODA_W, strict=True)], "member string, w double")
    scored = active.weighted_summary(members.score_members(instances(spark, sf), FEATURES), weights)
    scored = scored.select("id", F.round("score", 8).alias("score"), F.round("variance", 8).alias("variance"))
    return window_asked(scored, scored.where("id % 7 = 0").select("id"), TAU, _ASKS).withColumn("score", F.round("score", 6))


def _labelled(spark, sf):
    """A hundred labelled rows."""
    return instances(spark, sf).select("id", "y", *FEATURES).orderBy(arithmetic_order("id"), "id").limit(100)


_DIST = "sqrt((a.x0 - b.x0) ** 2 + (a.x1 - b.x1) ** 2 + (a.x2 - b.x2) ** 2)"


@query(
    "sm10_initial_labels",
    f"WITH {INST}, l AS (SELECT id, y, x0, x1, x2 FROM inst ORDER BY (id * 2654435761 + 42) % 2147483647, id LIMIT 100), "
    f"p AS (SELECT a.id, sum({_DIST}) AS far FROM l a, l b WHERE a.y = 0 AND b.y = 1 GROUP BY a.id ORDER BY far DESC, a.id LIMIT 1), k AS (SELECT * FROM l WHERE y = 1 OR id IN (SELECT id FROM p)), "
    f"q AS (SELECT a.id, sum({_DIST}) AS far FROM l a, k b WHERE a.y = 0 AND a.id NOT IN (SELECT id FROM p) GROUP BY a.id ORDER BY far DESC, a.id LIMIT 1) SELECT id, y FROM l WHERE y = 1 OR id IN (SELECT id FROM p UNION ALL SELECT id FROM q)",
)
def sm10(spark, sf):
    """Initial labels: all anomalies and the two nominals that lie farthest from what is kept."""
    return far_nominals(_labelled(spark, sf), FEATURES, 2).select("id", "y")


@query("sm10_pretraining")
def sm10_pre(spark, sf):
    """AUC on given labels before and after each update; the best is kept."""
    rows = _labelled(spark, sf)
    table, n = members.ensemble("isolation", instances(spark, sf), FEATURES, trees=20, depth=6)
    _, past = members.pretrain(table, rows, members.Weights.uniform(n), active.Config(epochs=50), 3)
    return spark.createDataFrame(list(enumerate(past)), "updates int, auc double")


@query(
    "sm2_buffered_windows",
    "WITH e AS (SELECT *, max(ts) OVER () - INTERVAL 2 DAY AS last FROM events), s AS (SELECT event_id, event_type, ts, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS k, count(*) OVER (PARTITION BY event_type) AS n FROM e WHERE ts <= date_trunc('millisecond', last)) "
    "SELECT event_id, event_type, CAST(k // 50 AS BIGINT) AS win FROM s WHERE k // 50 < n // 50",
)
def sm2(spark, sf):
    """Windows of 50 events of a type, as a stream that waits two days for late ones has given them."""
    events = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "event_type", "ts")
    return buffer.buffered_table(events, "event_type", "ts", "event_id", 50, "2 days").select("event_id", "event_type", F.col("win").cast("long").alias("win"))


@query("jn7_nearest_vectors")
def jn7(spark, sf):
    """Each embedding's five nearest others, by buckets."""
    return neighbours.knn(neighbours.points_of(vectors(spark, sf)), 5, tables=24).select("id", "other", F.round("d2", 9).alias("d2"), "pos")


@query("dt15_local_outlier_factor")
def dt15(spark, sf):
    rows = instances(spark, sf).select("id", F.array(*FEATURES).alias("x"))
    return neighbours.local_outlier_factor(rows).select("id", F.round("lof", 6).alias("lof"))
