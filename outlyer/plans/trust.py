"""Queries over relevance: one gradient, trained networks, trees that say where members matter."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from outlyer.functions.ranking import arithmetic_order
from outlyer.functions.tables import written
from outlyer.operators import active, compare, describe, loda, members, relevance
from outlyer.operators.metrics import quantile_values
from outlyer.plans.models import _projections
from outlyer.plans.registry import query
from outlyer.plans.views import FEATURES, INST, instances

#: A network of two hidden nodes for two members.
_NET = relevance.Network(np.array([[0.5, -0.3], [-0.4, 0.6], [0.2, 0.1]]), np.array([0.05, -0.1]), np.array([[0.7, -0.2], [0.3, 0.4]]), np.array([0.1, -0.05]))
_SHARES, _Q, _PRIOR = (0.001, 0.02, 0.01), 0.45, 0.5
_SCALES = (100.0, 24.0, 100.0)


def _given(spark, sf):
    """Scaled vectors with two scores, and labels on every fiftieth row."""
    rows = instances(spark, sf)
    x = [F.col(f) / s for f, s in zip(FEATURES, _SCALES, strict=True)]
    return rows.select("id", F.array(*x).alias("x"), F.array(x[0], x[2]).alias("values"), F.when(F.col("id") % 50 == 0, F.col("y")).alias("y"))


def _gradient_sql() -> str:
    d = lambda v: f"CAST({float(v)} AS DOUBLE)"
    n = _NET
    a = ", ".join(f"u0 * {d(n.w1[0, j])} + u1 * {d(n.w1[1, j])} + u2 * {d(n.w1[2, j])} + {d(n.b1[j])} AS a{j}" for j in (0, 1))
    h = ", ".join(f"greatest(a{j}, {d(0.2)} * a{j}) AS h{j}" for j in (0, 1))
    p = ", ".join(f"1 / (1 + exp(-(h0 * {d(n.w2[0, m])} + h1 * {d(n.w2[1, m])} + {d(n.b2[m])}))) AS p{m}" for m in (0, 1))
    bg, ca, cn = map(d, _SHARES)
    push = f"CASE WHEN y = 1 AND s < {d(_Q)} THEN -{ca} WHEN y = 0 AND s >= {d(_Q)} THEN {cn} ELSE 0 END"
    dz = ", ".join(f"push * {v} * p{m} * (1 - p{m}) + CASE WHEN y IS NULL THEN {bg} * (p{m} - {d(_PRIOR)}) ELSE 0 END AS dz{m}" for m, v in ((0, "u0"), (1, "u2")))
    da = ", ".join(f"(dz0 * {d(n.w2[j, 0])} + dz1 * {d(n.w2[j, 1])}) * CASE WHEN a{j} > 0 THEN 1 ELSE {d(0.2)} END AS da{j}" for j in (0, 1))
    parts = [f"u{i} * da{j}" for i in range(3) for j in (0, 1)] + ["da0", "da1"] + [f"h{j} * dz{m}" for j in (0, 1) for m in (0, 1)] + ["dz0", "dz1"]
    sums = ", ".join(f"sum({e})" for e in parts)
    u = ", ".join(f"x{k} / {d(s)} AS u{k}" for k, s in enumerate(_SCALES))
    return (
        f"WITH {INST}, u AS (SELECT {u}, CASE WHEN id % 50 = 0 THEN y END AS y FROM inst), a AS (SELECT *, {a} FROM u), h AS (SELECT *, {h} FROM a), p AS (SELECT *, {p} FROM h), "
        f"s AS (SELECT *, p0 * u0 + p1 * u2 AS s FROM p), b AS (SELECT *, {push} AS push FROM s), z AS (SELECT *, {dz} FROM b), g AS (SELECT *, {da} FROM z), t AS (SELECT [{sums}] AS g FROM g) "
        f"SELECT CAST(unnest(range({len(parts)})) AS INTEGER) AS k, round(unnest(g), 6) AS g FROM t"
    )


@query("gl4_gradient", _gradient_sql())
def gl4_gradient(spark, sf):
    """The gradient of prior and labels over all rows, at a network given by its numbers."""
    return relevance.gradient(_given(spark, sf), _NET, _Q, _SHARES, _PRIOR).select("k", F.round("g", 6).alias("g"))


def _members(spark, sf):
    """``id, x, values`` of fitted projections, and how many there are."""
    rows, n = members.loda_values(instances(spark, sf), FEATURES)
    x = F.array(*(F.col(f) / s for f, s in zip(FEATURES, _SCALES, strict=True)))
    return rows.select("id", x.alias("x"), "values"), n


@query("gl4_relevance_session")
def gl4_session(spark, sf):
    """Three rounds of asking and training: what was asked and found."""
    rows, n = _members(spark, sf)
    known = instances(spark, sf).select("id", "y")
    session = relevance.Session(rows, n, 3, active.Config(budget=6, batch=2), epochs=5)
    session.run(lambda i: known.where(F.col("id") == i).first().y)
    return spark.createDataFrame([(k, i, y) for k, (i, y) in enumerate(zip(session.asked, session.labels, strict=True))], "pos int, id long, y int")


@query("gl1_relevance")
def gl1(spark, sf):
    """Relevance of each projection for each row, of a network trained on all rows and a hundred labels."""
    rows, n = _members(spark, sf)
    labels = instances(spark, sf).select("id", "y").orderBy(arithmetic_order("id"), "id").limit(100)
    rows = written(rows.join(F.broadcast(labels), "id", "left"), "relevance")  # read in each epoch
    net = relevance.train_on_rows(rows, relevance.Network.start(3, n, 8), 3.0, active.Config(), epochs=5)
    return relevance.scored(rows, net).select("id", "relevance")


_RELEVANCE = ["1 / (1 + exp(-(x0 - 30) / 10))", "1 / (1 + exp(-(x1 - x2 / 5) / 3))", "0.55 + 0 * x0"]
_RANGES = ", ".join(f"min(x{k}) AS l{k}, max(x{k}) AS h{k}" for k in range(3))
_PLACES = ", ".join(f"CAST(greatest(0, least({relevance._BINS - 1}, floor((x{k} - l{k}) / (h{k} - l{k}) * {relevance._BINS}))) AS INTEGER) AS b{k}" for k in range(3))


def _tree_sql(depth: int) -> str:
    g = lambda n, p: f"CASE WHEN {n} > 0 THEN CAST(2 AS DOUBLE) * {p} * ({n} - {p}) / {n} ELSE 0 END"
    out = []
    for k in range(depth):
        out += [
            f"c{k} AS (SELECT member, leaf, f, bin, count(*) AS n, sum(y) AS pos FROM (SELECT member, leaf, y, unnest([0, 1, 2]) AS f, unnest([b0, b1, b2]) AS bin FROM a{k}) GROUP BY ALL)",
            f"s{k} AS (SELECT member, leaf, f, bin, sum(n) OVER w AS ln, sum(pos) OVER w AS lp, sum(n) OVER g AS tn, sum(pos) OVER g AS tp FROM c{k} WINDOW w AS (PARTITION BY member, leaf, f ORDER BY bin), g AS (PARTITION BY member, leaf, f))",
            f"q{k} AS (SELECT *, round({g('tn', 'tp')} - {g('ln', 'lp')} - {g('(tn - ln)', '(tp - lp)')}, 9) AS gain FROM s{k})",
            f"k{k} AS (SELECT member, leaf, f, bin AS cut FROM q{k} WHERE gain > 0 AND tn > ln QUALIFY row_number() OVER (PARTITION BY member, leaf ORDER BY gain DESC, f, bin) = 1)",
            f"a{k + 1} AS (SELECT a.member, a.id, a.y, b0, b1, b2, CASE WHEN k.f IS NULL THEN a.leaf ELSE a.leaf * 2 + CAST([b0, b1, b2][k.f + 1] > k.cut AS INTEGER) END AS leaf FROM a{k} a LEFT JOIN k{k} k ON k.member = a.member AND k.leaf = a.leaf)",
        ]
    return ", ".join(out)


@query(
    "ds6_member_trees",
    f"WITH {INST}, lim AS (SELECT {_RANGES} FROM inst), r AS (SELECT id, x0, x1, x2, unnest([0, 1, 2]) AS member, unnest([{', '.join(_RELEVANCE)}]) AS r FROM inst), "
    f"a0 AS (SELECT member, id, CAST(r > 0.5 AND row_number() OVER (PARTITION BY id ORDER BY r DESC, member) <= 2 AS INTEGER) AS y, {_PLACES}, CAST(1 AS BIGINT) AS leaf FROM r, lim), {_tree_sql(2)} "
    "SELECT member, CAST(leaf AS BIGINT) AS leaf, count(*) AS n, CAST(sum(y) AS BIGINT) AS pos FROM a2 GROUP BY member, leaf",
)
def ds6(spark, sf):
    """Trees of two levels that part the rows for which each of three members is among the two most relevant."""
    leaves, _ = _leaves(spark, sf)
    return leaves.select("member", "leaf", "n", "pos")


def _leaves(spark, sf):
    rows = instances(spark, sf)
    pairs = F.explode(F.array(*(F.struct(F.lit(k).alias("member"), F.expr(e).cast("double").alias("r")) for k, e in enumerate(_RELEVANCE)))).alias("m")
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.col("r").desc(), "member"))
    targets = rows.select("id", pairs).select("id", "m.*").withColumn("y", ((F.col("r") > 0.5) & (rank <= 2)).cast("int")).select("member", "id", "y")
    places, ranges = relevance.binned(rows, FEATURES)
    return relevance.member_trees(places, FEATURES, targets, 2), ranges


@query("ds6_member_rules")
def ds6_rules(spark, sf):
    leaves, ranges = _leaves(spark, sf)
    return relevance.member_rules(leaves, FEATURES, ranges)


# rules


_ITEMS = ", ".join(
    f"['', 'x{k}:2:' || CAST(greatest(0, least(1, floor((x{k} - l{k}) / (h{k} - l{k}) * 2))) AS INTEGER), 'x{k}:4:' || CAST(greatest(0, least(3, floor((x{k} - l{k}) / (h{k} - l{k}) * 4))) AS INTEGER)] AS i{k}" for k in range(3)
)


@query(
    "ds4_rule_candidates",
    f"WITH {INST}, lim AS (SELECT {_RANGES} FROM inst), i AS (SELECT {_ITEMS} FROM inst, lim WHERE y = 1), a AS (SELECT unnest(i0) AS a, i1, i2 FROM i), b AS (SELECT a, unnest(i1) AS b, i2 FROM a), c AS (SELECT a, b, unnest(i2) AS c FROM b) "
    "SELECT trim(regexp_replace(a || ' ' || b || ' ' || c, ' +', ' ', 'g')) AS pattern, count(*) AS freq FROM c WHERE a || b || c <> '' GROUP BY a, b, c HAVING count(*) >= ceil(CAST(0.2 AS DOUBLE) * (SELECT count(*) FROM inst WHERE y = 1))",
)
def ds4(spark, sf):
    """Parts of the features' ranges that a fifth of the anomalies share, alone and together."""
    marked, _ = describe.interval_items(instances(spark, sf).select("y", *FEATURES), FEATURES)
    return describe.mined_patterns(marked, 0.2).select(F.concat_ws(" ", "items").alias("pattern"), "freq")


@query("ds3_bayesian_ruleset")
def ds3(spark, sf):
    """Rules of high posterior for the tenth of the rows that projections score highest, from mined candidates."""
    proj = _projections(spark)
    rows = instances(spark, sf).select(*FEATURES, F.array(*FEATURES).alias("x"))
    scored = written(loda.row_scores(rows, proj, loda.histograms_of(rows, proj, 20)).select("score", *FEATURES), "scored")
    q = quantile_values(scored, "score", [0.9])[0]
    found = describe.bayesian_rules(scored.select((F.col("score") >= q).cast("int").alias("y"), *FEATURES), FEATURES, 0.1, levels=(2, 4, 8, 16))
    return spark.createDataFrame(list(enumerate(found)), "rule_id int, rule string")


# comparison


@query(
    "al10_paired_curves",
    f"WITH {INST}, s AS (SELECT unnest([0, 1]) AS run, id, y, unnest([x0, x0 + x2]) AS a, unnest([x2, -x1]) AS b FROM inst), m AS (SELECT run, id, y, unnest(['detector', 'classifier']) AS method, unnest([a, b]) AS score FROM s), "
    "k AS (SELECT run, method, y, row_number() OVER (PARTITION BY run, method ORDER BY round(score, 6) DESC, id) AS k FROM m) SELECT run, method, CAST(k AS INTEGER) AS k, CAST(sum(y) OVER (PARTITION BY run, method ORDER BY k) AS BIGINT) AS found FROM k QUALIFY k <= 40",
)
def al10(spark, sf):
    """Anomalies found by budget, of two given scores in two runs."""
    rows = instances(spark, sf)
    runs = [rows.select(F.lit(r).alias("run"), "id", "y", F.round(a, 6).alias("detector"), F.round(b, 6).alias("classifier")) for r, (a, b) in enumerate(((F.col("x0"), F.col("x2")), (F.col("x0") + F.col("x2"), -F.col("x1"))))]
    return compare.paired_curves(runs[0].unionByName(runs[1]), ["detector", "classifier"], 40)


@query("al10_detector_against_classifier")
def al10_runs(spark, sf):
    """The mean curves of a forest that learns from a hundred labels and of a classifier that does, over two runs."""
    rows = instances(spark, sf).select("id", "y", *FEATURES)
    curves = compare.detector_against_classifier(rows, FEATURES, 2, 100, 20, active.Config(epochs=50), trees=20, depth=6)
    return compare.mean_curves(curves)
