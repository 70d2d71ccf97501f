"""Queries over models: forests, LODA, density, weights, descriptions, relevance, classifiers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from outlyer.functions import vectors
from outlyer.functions.ranking import arithmetic_order
from outlyer.operators import active, density, describe, drift, forest, joins, learn, loda, metrics, relevance
from outlyer.plans.registry import query
from outlyer.plans.views import BOXES, FEATURES, INST, ROUTED, instances, small_forest

MODEL = f"{INST}, {BOXES}, {ROUTED}"
SAMPLES = 256


def routed(spark, sf):
    """``id, y, tree, node`` of the small forest."""
    model = forest.Model.of(small_forest(spark), FEATURES)
    trees = F.array(*(F.lit(int(t)) for t in model.trees))
    return forest.leaf_features(forest.route(instances(spark, sf), model), trees).join(instances(spark, sf).select("id", "y"), "id")


def regions(spark):
    return forest.regions(small_forest(spark), FEATURES)


def members(spark, sf):
    """``id, y, member, value``: each leaf's inverse path length over the number of trees."""
    r = F.broadcast(regions(spark).withColumn("value", forest.region_score("inverse_length", SAMPLES) / 3))
    return routed(spark, sf).join(r.select("tree", "node", F.col("region").alias("member"), "value"), ["tree", "node"]).select("id", "y", "member", "value")


#: Weights by rule: tree and node number.
_WEIGHT = "(0.1 + 0.05 * tree + 0.02 * node)"


def weights(spark):
    return regions(spark).select(F.col("region").alias("member"), (F.lit(0.1) + 0.05 * F.col("tree") + 0.02 * F.col("node")).alias("w"))


_MEMBERS = f"{MODEL}, member AS (SELECT id, y, region AS member, 1 / CAST(path_length AS DOUBLE) / 3 AS value, CAST({_WEIGHT} AS DOUBLE) AS w FROM routed)"


#: How many rows lie in each leaf.
_HELD = f"{MODEL}, held AS (SELECT b.region, count(r.id) AS rows FROM box b LEFT JOIN routed r ON r.region = b.region GROUP BY b.region)"


def held(spark, sf):
    """The leaves with ``rows``, how many lie in each."""
    counts = routed(spark, sf).groupBy("tree", "node").agg(F.count(F.lit(1)).alias("rows"))
    return regions(spark).join(counts, ["tree", "node"], "left").na.fill(0, ["rows"])


@query("jn4_routed", f"WITH {MODEL} SELECT id, tree, node FROM routed")
def jn4(spark, sf):
    return routed(spark, sf).select("id", "tree", "node")


@query("jn5_region_ids", f"WITH {MODEL} SELECT DISTINCT region FROM routed WHERE y = 1")
def jn5(spark, sf):
    return routed(spark, sf).where("y = 1").join(F.broadcast(regions(spark)), ["tree", "node"]).select("region").distinct()


_CLOSED = " AND ".join(f"(b.lo_x{k} IS NULL OR i.x{k} >= b.lo_x{k}) AND (b.hi_x{k} IS NULL OR i.x{k} <= b.hi_x{k})" for k in range(3))


@query("jn3_region_membership", f"WITH {INST}, {BOXES} SELECT i.id, b.region FROM inst i JOIN box b ON {_CLOSED}")
def jn3(spark, sf):
    return joins.in_regions(instances(spark, sf), regions(spark), FEATURES)


@query("dt7_regions", f"WITH {_HELD} SELECT tree, node, b.region, path_length, CAST(n AS BIGINT) AS n, rows, coalesce(lo_x0, -1) AS lo_x0, coalesce(hi_x0, -1) AS hi_x0, coalesce(lo_x1, -1) AS lo_x1, coalesce(hi_x1, -1) AS hi_x1 FROM box b JOIN held h ON h.region = b.region")
def dt7(spark, sf):
    return held(spark, sf).select("tree", "node", "region", "path_length", "n", "rows", *(F.coalesce(c, F.lit(-1.0)).alias(c) for c in ("lo_x0", "hi_x0", "lo_x1", "hi_x1")))


_KINDS = {
    "inverse_length": "1 / l", "power_length": "pow(2, -l)", "negative_length": "-l",
    "half_space_log": "-ln((n + 1) / CAST(257 AS DOUBLE) * pow(2, l - 1))", "rs_log": "-(ln(greatest(n, 1) / CAST(256 AS DOUBLE)) - log_vol)",
}


@query("dt8_region_scores", f"WITH {_HELD} SELECT region, " + ", ".join(f"round({e}, 6) AS {k}" for k, e in _KINDS.items()) + " FROM (SELECT b.region, h.rows AS n, log_vol, CAST(path_length AS DOUBLE) AS l FROM box b JOIN held h ON h.region = b.region)")
def dt8(spark, sf):
    """Scores of the leaves from the rows that lie in them."""
    return held(spark, sf).withColumn("n", F.col("rows")).select("region", *(F.round(forest.region_score(k, SAMPLES), 6).alias(k) for k in _KINDS))


@query("dt9_region_features", f"WITH {_MEMBERS} SELECT id, member, round(value, 6) AS value FROM member")
def dt9(spark, sf):
    return members(spark, sf).select("id", "member", F.round("value", 6).alias("value"))


@query("dt2_half_space_score", f"WITH {MODEL} SELECT id, round(avg(n * pow(2, path_length + 1)), 4) AS score FROM routed GROUP BY id")
def dt2(spark, sf):
    return forest.half_space_score(instances(spark, sf), forest.Model.of(small_forest(spark), FEATURES)).select("id", F.round("score", 4).alias("score"))


@query("dt3_rs_score", f"WITH {MODEL} SELECT id, round(avg(n * exp(-log_vol)), 4) AS score FROM routed GROUP BY id")
def dt3(spark, sf):
    return forest.rs_score(instances(spark, sf), forest.Model.of(small_forest(spark), FEATURES)).select("id", F.round("score", 4).alias("score"))


@query("dt1_isolation_score", f"WITH {MODEL}, h AS (SELECT id, avg(path_length + 2 * (ln(n) + 0.5772156649) - 2 * (n - 1) / CAST(n AS DOUBLE)) AS h FROM routed GROUP BY id) SELECT id, round(pow(2, -h / (2 * (ln(256) + 0.5772156649) - 2 * 255 / CAST(256 AS DOUBLE))), 6) AS score FROM h")
def dt1(spark, sf):
    return forest.isolation_score(instances(spark, sf), forest.Model.of(small_forest(spark), FEATURES), SAMPLES).select("id", F.round("score", 6).alias("score"))


@query("dt1_isolation_top")
def dt1b(spark, sf):
    """The 20 most anomalous events by a forest grown on them."""
    rows = instances(spark, sf)
    model = forest.Model.of(forest.fit(rows, FEATURES, trees=50), FEATURES)
    return forest.isolation_score(rows, model).select("id", "score", "event_type").orderBy(F.col("score").desc(), "id").limit(20)


@query("dt4_multiview_forest")
def dt4(spark, sf):
    rows = instances(spark, sf)
    model = forest.Model.of(forest.fit(rows, FEATURES, trees=12, views=[1, 2]), FEATURES)
    return forest.isolation_score(rows, model).select("id", "score")


@query("dt5_half_space_forest")
def dt5(spark, sf):
    rows = instances(spark, sf)
    model = forest.Model.of(forest.fit(rows, FEATURES, "half_space", trees=10, depth=6), FEATURES)
    return forest.half_space_score(rows, model).select("id", "score")


@query("dt6_rs_forest_scores")
def dt6(spark, sf):
    rows = instances(spark, sf)
    model = forest.Model.of(forest.fit(rows, FEATURES, "rs", trees=20, depth=8), FEATURES)
    return forest.rs_score(rows, model).select("id", "score")


@query("pf14_in_region", f"WITH {INST}, {BOXES} SELECT i.id FROM inst i JOIN box b ON b.region = '2:4' AND {_CLOSED}")
def pf14(spark, sf):
    return joins.in_regions(instances(spark, sf), regions(spark).where("region = '2:4'"), FEATURES).select("id")


@query("ag10_leaf_distribution", f"WITH {MODEL} SELECT b.tree, b.node, round(count(r.id) / CAST((SELECT count(*) FROM inst) AS DOUBLE), 6) AS p FROM box b LEFT JOIN routed r ON r.region = b.region GROUP BY b.tree, b.node")
def ag10(spark, sf):
    return drift.leaf_distribution(routed(spark, sf), regions(spark)).select("tree", "node", F.round("p", 6).alias("p"))


_HALVES = f"{MODEL}, c AS (SELECT b.tree, b.node, count(r.id) FILTER (r.id % 2 = 0) + CAST(0.01 AS DOUBLE) AS a, count(r.id) FILTER (r.id % 2 = 1 AND r.x0 > 30) + CAST(0.01 AS DOUBLE) AS b FROM box b LEFT JOIN (SELECT r.*, i.x0 FROM routed r JOIN inst i USING (id)) r ON r.region = b.region GROUP BY b.tree, b.node), pq AS (SELECT tree, node, a / sum(a) OVER (PARTITION BY tree) AS p, b / sum(b) OVER (PARTITION BY tree) AS q FROM c)"


def _halves(spark, sf):
    leaves = routed(spark, sf).join(instances(spark, sf).select("id", "x0"), "id")
    w = Window.partitionBy("tree")

    def part(rows):
        n = regions(spark).select("tree", "node").join(rows.groupBy("tree", "node").agg(F.count(F.lit(1)).alias("c")), ["tree", "node"], "left")
        n = n.withColumn("c", F.coalesce("c", F.lit(0)) + 0.01)
        return n.select("tree", "node", (F.col("c") / F.sum("c").over(w)).alias("p"))

    return part(leaves.where("id % 2 = 0")), part(leaves.where("id % 2 = 1 and x0 > 30"))


@query("ag18_divergence", f"WITH {_HALVES} SELECT tree, round(sum(p * (ln(p) - ln(q))), 6) AS kl FROM pq GROUP BY tree")
def ag18(spark, sf):
    return drift.divergence(*_halves(spark, sf)).select("tree", F.round("kl", 6).alias("kl"))


@query("ag19_normalised_divergence", f"WITH {_HALVES}, k AS (SELECT tree, sum(p * (ln(p) - ln(q))) AS kl FROM pq GROUP BY tree), u AS (SELECT tree, p, row_number() OVER (PARTITION BY tree ORDER BY p, node) AS k FROM pq), d AS (SELECT tree, p AS q, row_number() OVER (PARTITION BY tree ORDER BY p DESC, node) AS k FROM pq), w AS (SELECT u.tree, sum(p * (ln(p) - ln(q))) AS worst FROM u JOIN d ON u.tree = d.tree AND u.k = d.k GROUP BY u.tree) SELECT k.tree, round(kl / worst, 5) AS ratio FROM k JOIN w ON k.tree = w.tree")
def ag19(spark, sf):
    return drift.normalised_divergence(*_halves(spark, sf)).select("tree", F.round("ratio", 5).alias("ratio"))


@query("sm6_drift_threshold", f"WITH {_HALVES}, k AS (SELECT tree, sum(p * (ln(p) - ln(q))) AS kl FROM pq GROUP BY tree) SELECT round(quantile_cont(kl, 0.95), 6) AS threshold FROM k")
def sm6(spark, sf):
    return drift.threshold(drift.divergence(*_halves(spark, sf))).select(F.round("threshold", 6).alias("threshold"))


@query("sm7_trees_to_replace", f"WITH {_HALVES}, k AS (SELECT tree, sum(p * (ln(p) - ln(q))) AS kl FROM pq GROUP BY tree) SELECT tree FROM k WHERE kl > (SELECT quantile_cont(kl, 0.5) FROM k)")
def sm7(spark, sf):
    kls = drift.divergence(*_halves(spark, sf))
    return drift.trees_to_replace(kls, drift.threshold(kls, 0.5)).select("tree")


@query("sm4_blended_counts", f"WITH {MODEL}, b AS (SELECT tree, node, count(*) AS c FROM routed WHERE id % 5 = 0 GROUP BY ALL) SELECT x.tree, x.node, round(CAST(0.7 AS DOUBLE) * n + CAST(0.3 AS DOUBLE) * coalesce(c, 0), 4) AS n FROM box x LEFT JOIN b ON b.tree = x.tree AND b.node = x.node")
def sm4(spark, sf):
    buffer = routed(spark, sf).where("id % 5 = 0").groupBy("tree", "node").agg(F.count(F.lit(1)).alias("n"))
    return drift.blended_counts(regions(spark), buffer, 0.3).select("tree", "node", F.round("n", 4).alias("n"))


@query("sm5_tree_replacement")
def sm5(spark, sf):
    """Scores by the small forest after its first tree has given way to two grown ones."""
    rows = instances(spark, sf)
    nodes = drift.replace_trees(small_forest(spark), spark.createDataFrame([(0,)], "tree int"), forest.fit(rows, FEATURES, trees=2, first=3))
    return forest.isolation_score(rows, forest.Model.of(nodes, FEATURES)).select("id", "score")


@query("ag15_member_variance", f"WITH {_MEMBERS} SELECT id, round(sum(value * w), 6) AS score, round(var_pop(value * w), 8) AS variance FROM member GROUP BY id")
def ag15(spark, sf):
    out = active.weighted_summary(members(spark, sf), weights(spark))
    return out.select("id", F.round("score", 6).alias("score"), F.round("variance", 8).alias("variance"))


@query("wn5_top_regions", f"WITH {MODEL} SELECT region, round(sum({_WEIGHT} / path_length), 3) AS worth FROM routed GROUP BY region ORDER BY round(sum({_WEIGHT} / path_length), 3) DESC, region LIMIT 5")
def wn5(spark, sf):
    """The leaves whose rows are worth most."""
    r = held(spark, sf).join(F.broadcast(weights(spark).withColumnRenamed("member", "region")), "region")
    worth = r.select("region", F.round(F.col("rows") * F.col("w") / F.col("path_length"), 3).alias("worth"))
    return worth.orderBy(F.col("worth").desc(), "region").limit(5)


@query("wn6_regions_per_row", f"WITH {MODEL}, k AS (SELECT region, row_number() OVER (PARTITION BY id ORDER BY {_WEIGHT} / path_length DESC, region) AS k FROM routed) SELECT DISTINCT region FROM k WHERE k <= 1")
def wn6(spark, sf):
    worth = regions(spark).join(weights(spark).withColumnRenamed("member", "region"), "region").select("region", (F.col("w") / F.col("path_length")).alias("worth"))
    inside = members(spark, sf).select("id", F.col("member").alias("region"))
    return describe.top_regions(inside, worth, 1)


_LIM = "l AS (SELECT " + ", ".join(f"min(x{k}) l{k}, max(x{k}) h{k}" for k in range(3)) + " FROM inst)"
_VOL = " * ".join(f"CASE WHEN coalesce(hi_x{k}, h{k}) = coalesce(lo_x{k}, l{k}) THEN 1 ELSE coalesce(hi_x{k}, h{k}) - coalesce(lo_x{k}, l{k}) END" for k in range(3))


@query("ag21_region_volumes", f"WITH {INST}, {BOXES}, {_LIM} SELECT region, round({_VOL}, 3) AS volume FROM box, l")
def ag21(spark, sf):
    v = describe.volumes(regions(spark), vectors.feature_ranges(instances(spark, sf), FEATURES), FEATURES)
    return v.select("region", F.round("volume", 3).alias("volume"))


_BOUNDS = " + ".join(f"CAST({e}_x{k} IS NOT NULL AS INTEGER)" for k in range(3) for e in ("lo", "hi"))


@query("ag22_rule_complexity", f"WITH {_HELD} SELECT b.region, pow(2, greatest(0, least({_BOUNDS} - 1, 9))) AS complexity, rows FROM box b JOIN held h ON h.region = b.region")
def ag22(spark, sf):
    return describe.complexity(regions(spark), FEATURES).join(held(spark, sf).select("region", "rows"), "region")


#: A number with a bit for each leaf, and the sets of leaves in which rows of some condition lie.
_BITS = "bit AS (SELECT region, row_number() OVER (ORDER BY region) - 1 AS k FROM box)"


def _cover_sql(rows: str) -> str:
    """Parts of SQL that end in ``best(mask)``: the cheapest set of leaves, by the roots of volumes, that meets the sets of ``rows(id, region)``."""
    return (
        f"{_LIM}, vol AS (SELECT region, {_VOL} AS v FROM box, l), {_BITS}, sets AS (SELECT DISTINCT m FROM (SELECT id, sum(1::BIGINT << k) AS m FROM {rows} JOIN bit USING (region) GROUP BY id)), "
        "price AS (SELECT mask, sum(sqrt(v)) AS v FROM (SELECT unnest(range(1, 1024)) AS mask), bit JOIN vol USING (region) WHERE (mask >> k) & 1 = 1 GROUP BY mask), "
        "best AS (SELECT mask FROM price p WHERE NOT EXISTS (SELECT 1 FROM sets WHERE m::BIGINT & p.mask = 0) ORDER BY v, mask LIMIT 1)"
    )


def root_volumes(spark, sf):
    """Roots of the leaves' volumes: volumes of a tree's leaves add up to the same for all trees."""
    v = describe.volumes(regions(spark), vectors.feature_ranges(instances(spark, sf), FEATURES), FEATURES)
    return v.select("region", F.sqrt("volume").alias("volume"))


@query("ds1_compact_cover", f"WITH {INST}, {BOXES}, near AS (SELECT i.id, b.region FROM inst i JOIN box b ON i.y = 1 AND {_CLOSED}), {_cover_sql('near')} SELECT region FROM bit, best WHERE (mask >> k) & 1 = 1")
def ds1(spark, sf):
    rows = instances(spark, sf)
    inside = joins.in_regions(rows.where("y = 1"), regions(spark), FEATURES)
    return spark.createDataFrame([(r,) for r in describe.compact_regions(inside, root_volumes(spark, sf))], "region string")


@query("ds2_descriptions")
def ds2(spark, sf):
    rows = instances(spark, sf)
    found = describe.describe(rows, rows.where("x0 > 200").select("id"), regions(spark), FEATURES, rows.where("x0 <= 200"))
    return spark.createDataFrame([(d["region"], d["rule"], float(d["precision"])) for d in found], "region string, rule string, precision double")


@query("al2_loss", f"WITH {_MEMBERS}, s AS (SELECT id, y, sum(value * w) AS s FROM member GROUP BY id, y) SELECT round(sum(l), 6) AS loss FROM (SELECT y, avg(CASE WHEN y = 1 THEN greatest(0, 0.12 - s) ELSE greatest(0, s - 0.12) END) AS l FROM s GROUP BY y)")
def al2(spark, sf):
    return active.linear_loss(members(spark, sf), weights(spark), 0.12).select(F.round("loss", 6).alias("loss"))


@query("al3_gradient", f"WITH {_MEMBERS}, m AS (SELECT * FROM member), s AS (SELECT id, y, sum(value * w) AS s FROM m GROUP BY id, y), n AS (SELECT y, count(*) AS n FROM s GROUP BY y), b AS (SELECT s.id, s.y, n FROM s JOIN n ON s.y = n.y WHERE (s.y = 1 AND s < 0.12) OR (s.y = 0 AND s >= 0.12)) SELECT member, round(sum(CASE WHEN b.y = 1 THEN -value ELSE value END / n), 6) AS g FROM m JOIN b ON m.id = b.id GROUP BY member")
def al3(spark, sf):
    return active.linear_gradient(members(spark, sf), weights(spark), 0.12).select("member", F.round("g", 6).alias("g"))


@query("al5_feedback_loop")
def al5(spark, sf):
    """Six rounds of feedback over a grown forest: what was asked and found."""
    rows = instances(spark, sf)
    model = forest.Model.of(forest.fit(rows, FEATURES, trees=20, depth=6), FEATURES)
    session = active.Session(rows, model, model.region_scores("inverse_length", SAMPLES), active.Config(budget=6, batch=2, epochs=50))
    known = rows.select("id", "y")
    state = session.run(lambda i: known.where(F.col("id") == i).first().y)
    return spark.createDataFrame([(k, i, y) for k, (i, y) in enumerate(zip(state.asked, state.labels, strict=True))], "pos int, id long, y int")


_D2 = "(a.x0 - b.x0) ** 2 + (a.x1 - b.x1) ** 2 + (a.x2 - b.x2) ** 2"


@query(
    "wn17_diverse_picks",
    f"WITH {INST}, t AS (SELECT * FROM inst ORDER BY x0 DESC, id LIMIT 12), p0 AS (SELECT id, 0 AS pick FROM t ORDER BY x0 DESC, id LIMIT 1), "
    + ", ".join(
        f"p{k} AS (SELECT * FROM p{k - 1} UNION ALL (SELECT a.id, {k} FROM t a, t b WHERE b.id IN (SELECT id FROM p{k - 1}) AND a.id NOT IN (SELECT id FROM p{k - 1}) GROUP BY a.id, a.x0 ORDER BY min({_D2}) DESC, a.x0 DESC, a.id LIMIT 1))" for k in (1, 2)
    )
    + " SELECT id, pick FROM p2",
)
def wn17(spark, sf):
    rows = instances(spark, sf).withColumn("score", F.col("x0")).withColumn("x", F.array(*FEATURES))
    best = rows.orderBy(F.col("score").desc(), "id").limit(12)
    return active.greedy_diverse(best, "x", 3).select("id", "pick")


_PROJ = [(0, (0.6, 0.8, 0.0)), (1, (0.0, 0.6, -0.8)), (2, (0.8, 0.0, 0.6))]


def _projections(spark):
    return spark.createDataFrame([(p, list(w)) for p, w in _PROJ], "proj int, w array<double>")


_P = f"{INST}, z AS (" + " UNION ALL ".join("SELECT id, {} AS proj, CAST({} * x0 + {} * x1 + {} * x2 AS DOUBLE) AS z FROM inst".format(p, *(f"CAST({v} AS DOUBLE)" for v in w)) for p, w in _PROJ) + "), lim AS (SELECT proj, min(z) lo, (max(z) - min(z)) / 20 AS width, count(*) n FROM z GROUP BY proj), b AS (SELECT z.*, lo, width, n, greatest(0, least(19, CAST(floor((z - lo) / width) AS INTEGER))) AS bin FROM z JOIN lim USING (proj))"


def _projected(spark, sf):
    return loda.project(instances(spark, sf).withColumn("x", F.array(*FEATURES)), _projections(spark))


@query("dt10_projected", f"WITH {_P} SELECT id, proj, round(z, 5) + 0.0 AS z FROM z")
def dt10(spark, sf):
    return _projected(spark, sf).select("id", "proj", (F.round("z", 5) + 0.0).alias("z"))


@query("dt12_loda_score", f"WITH {_P}, d AS (SELECT id, ln(greatest(1e-8, count(*) OVER (PARTITION BY proj, bin) / (n * width))) AS logp FROM b) SELECT id, round(-sum(logp), 4) AS score FROM d GROUP BY id")
def dt12(spark, sf):
    z = _projected(spark, sf)
    return loda.score(loda.densities(z, loda.histograms(z, 20))).select("id", F.round("score", 4).alias("score"))


@query("dt11_loda_top")
def dt11(spark, sf):
    rows = instances(spark, sf).withColumn("x", F.array(*FEATURES))
    proj, hist = loda.fit(rows, 3)
    return loda.row_scores(rows.select("id", "x"), proj, hist).select("id", "score").orderBy(F.col("score").desc(), "id").limit(20)


@query("dt17_kernel_density", f"WITH {INST}, s AS (SELECT x0 AS a, x2 AS b FROM inst ORDER BY (id * 2654435761 + 42) % 2147483647, id LIMIT 2000) SELECT id, round(sum(exp(-((x0 - a) * (x0 - a) + (x2 - b) * (x2 - b)) / (2 * 100))) / (SELECT count(*) FROM s), 6) AS density FROM inst, s GROUP BY id")
def dt17(spark, sf):
    rows = instances(spark, sf).select("id", F.array("x0", "x2").alias("x"))
    return density.kernel_density(rows, rows.orderBy(arithmetic_order("id"), "id").limit(2000), 10.0).select("id", F.round("density", 6).alias("density"))


@query("dt16_mixture")
def dt16(spark, sf):
    rows = instances(spark, sf)
    k, model = density.mixture_by_bic(rows, ["x0", "x2"], 3)
    return spark.createDataFrame([(i, float(w)) for i, w in enumerate(model.weights)], "component int, weight double").withColumn("k", F.lit(k))


@query("dt16_gaussian_density")
def dt16b(spark, sf):
    return density.gaussian_log_density(instances(spark, sf), FEATURES).select("id", "log_density")


@query("dt18_pca_error")
def dt18(spark, sf):
    return density.pca_error(instances(spark, sf), FEATURES).select("id", "error")


@query("dt19_pseudo_anomalies")
def dt19(spark, sf):
    return density.pseudo_anomalies(instances(spark, sf), ["x0", "x2"], 2000).select("id", "p_background")


@query("dt20_regression_influence", f"WITH {INST} SELECT round(regr_slope(x0, x2), 6) AS slope_all, round(regr_intercept(x0, x2), 5) AS intercept_all, round(regr_slope(x0, x2) FILTER (y = 0), 6) AS slope_clean, round(regr_intercept(x0, x2) FILTER (y = 0), 5) AS intercept_clean FROM inst")
def dt20(spark, sf):
    out = density.regression_influence(instances(spark, sf).withColumn("flag", F.col("y") == 1), "x2", "x0", "flag")
    return out.select(*(F.round(c, 6 if "slope" in c else 5).alias(c) for c in out.columns))


@query("gl3_weighted_scores", f"WITH {_MEMBERS} SELECT id, round(sum(value / (1 + length(member))), 6) AS score FROM member GROUP BY id")
def gl3(spark, sf):
    return relevance.weighted_scores(members(spark, sf).withColumn("relevance", 1 / (1 + F.length("member")))).select("id", F.round("score", 6).alias("score"))


@query("wn16_best_members", f"WITH {_MEMBERS} SELECT id, member, row_number() OVER (PARTITION BY id ORDER BY w DESC, member) AS rank FROM member")
def wn16(spark, sf):
    m = members(spark, sf).join(F.broadcast(weights(spark)), "member").withColumnRenamed("w", "relevance")
    return relevance.best_members(m).select("id", "member", F.col("rank").cast("long").alias("rank"))


@query("cl1_classifiers")
def cl1(spark, sf):
    rows = instances(spark, sf).withColumn("y", (F.col("x0") > 60).cast("int"))
    return learn.predict(rows, FEATURES, learn.fit(rows, FEATURES, "tree")).groupBy("y", "prediction").agg(F.count(F.lit(1)).alias("n"))


@query("cl6_normal_samples")
def cl6(spark, sf):
    return learn.normal_samples(spark, [(200, [0.0, 0.0], [[1.0, 0.5], [0.5, 1.0]]), (20, [4.0, 4.0], [[0.2, 0.0], [0.0, 0.2]])])


@query("ag11_path_counts", f"WITH {MODEL}, up(tree, leaf, node) AS (VALUES (0,2,2),(0,2,0),(0,3,3),(0,3,1),(0,3,0),(0,4,4),(0,4,1),(0,4,0),(1,1,1),(1,1,0),(1,3,3),(1,3,2),(1,3,0),(1,4,4),(1,4,2),(1,4,0),(2,3,3),(2,3,1),(2,3,0),(2,4,4),(2,4,1),(2,4,0),(2,5,5),(2,5,2),(2,5,0),(2,6,6),(2,6,2),(2,6,0)) SELECT r.tree, u.node, count(*) AS n FROM routed r JOIN up u ON u.tree = r.tree AND u.leaf = r.node GROUP BY ALL")
def ag11(spark, sf):
    model = forest.Model.of(small_forest(spark), FEATURES)
    trees = F.array(*(F.lit(int(t)) for t in model.trees))
    on_way = forest.path_nodes(forest.route(instances(spark, sf), model), small_forest(spark), trees)
    return on_way.groupBy("tree", "node").agg(F.count(F.lit(1)).alias("n"))


@query("ag14_estimated_quantile")
def ag14(spark, sf):
    names = [r.region for r in regions(spark).select("region").orderBy("region").collect()]
    return active.estimated_quantile(members(spark, sf), names, 0.03, 10)


@query("ag5_found_in_budget", f"WITH {_MEMBERS}, s AS (SELECT id, y, round(sum(value * w), 6) AS s FROM member GROUP BY id, y) SELECT id, CAST(sum(y) OVER (ORDER BY s DESC, id) AS BIGINT) AS found FROM s ORDER BY s DESC, id LIMIT 60")
def ag5(spark, sf):
    s = members(spark, sf).join(F.broadcast(weights(spark)), "member").groupBy("id", "y").agg(F.round(F.sum(F.col("value") * F.col("w")), 6).alias("s"))
    best = s.orderBy(F.col("s").desc(), "id").limit(60)
    return best.select("id", F.sum("y").over(Window.partitionBy().orderBy(F.col("s").desc(), "id")).alias("found"))  # 60 rows


_SUMS = f"{_MEMBERS}, s AS (SELECT id, round(sum(value * w), 6) AS s FROM member GROUP BY id)"


def _scores(spark, sf):
    return members(spark, sf).join(F.broadcast(weights(spark)), "member").groupBy("id").agg(F.round(F.sum(F.col("value") * F.col("w")), 6).alias("score"))


@query("al11_query_top", f"WITH {_SUMS} SELECT id FROM s WHERE id % 7 <> 0 ORDER BY s DESC, id LIMIT 5")
def al11(spark, sf):
    s = _scores(spark, sf)
    return s.join(s.where("id % 7 = 0").select("id"), "id", "left_anti").orderBy(F.col("score").desc(), "id").limit(5).select("id")


@query("al12_query_top_random", f"WITH {_SUMS}, t AS (SELECT id FROM s ORDER BY s DESC, id LIMIT 40) SELECT id FROM t ORDER BY (id * 2654435761 + 42) % 2147483647, id LIMIT 5")
def al12(spark, sf):
    from outlyer.operators.select import sample

    return sample(_scores(spark, sf).orderBy(F.col("score").desc(), "id").limit(40), 5).select("id")


@query("al14_query_quantile", f"WITH {_SUMS}, q AS (SELECT quantile_cont(s, 0.97) AS q FROM s) SELECT id FROM s, q ORDER BY round(abs(s - q), 7), id LIMIT 5")
def al14(spark, sf):
    s = _scores(spark, sf)
    q = metrics.quantile_values(s, "score", [0.97])[0]
    return s.orderBy(F.round(F.abs(F.col("score") - F.lit(q)), 7), "id").limit(5).select("id")


def _picks_sql(masks: str, n: int) -> str:
    """SQL of ``n`` picks over ``masks(id, pos, m)``: the first, then always the one that shares fewest bits with those picked."""
    first = f"k0 AS (SELECT id, pos, m, 0 AS pick FROM {masks} ORDER BY pos LIMIT 1)"
    more = [
        f"k{j} AS (SELECT * FROM k{j - 1} UNION ALL (SELECT id, pos, m, {j} FROM {masks} WHERE id NOT IN (SELECT id FROM k{j - 1}) ORDER BY bit_count(m & (SELECT bit_or(m) FROM k{j - 1})), pos LIMIT 1))"
        for j in range(1, n)
    ]
    return ", ".join([first, *more]) + f" SELECT pick, id FROM k{n - 1}"


_BEST = f"best AS (SELECT id, row_number() OVER (ORDER BY s DESC, id) AS pos FROM (SELECT * FROM s ORDER BY s DESC, id LIMIT 12))"


@query("wn18_least_overlap", f"WITH {_SUMS}, {_BEST}, {_BITS}, masks AS (SELECT b.id, b.pos, CAST(sum(1::BIGINT << k) AS BIGINT) AS m FROM best b JOIN routed r ON r.id = b.id JOIN bit USING (region) GROUP BY b.id, b.pos), {_picks_sql('masks', 4)}")
def wn18(spark, sf):
    order = _scores(spark, sf).orderBy(F.col("score").desc(), "id").limit(12)
    own = members(spark, sf).join(F.broadcast(order.select("id")), "id", "left_semi").select("id", F.col("member").alias("region"))
    return spark.createDataFrame([(k, i) for k, i in enumerate(active.least_overlap(own, order, 4))], "pick int, id long")


@query("sm11_confident", f"WITH {_MEMBERS}, s AS (SELECT id, round(sum(value * w), 8) AS s, round(var_pop(value * w), 10) AS v FROM member GROUP BY id), q AS (SELECT quantile_cont(s, 0.97) AS q FROM s) SELECT count(*) FILTER (s - 0.01 * sqrt(v) >= q) AS n FROM s, q")
def sm11(spark, sf):
    summary = active.weighted_summary(members(spark, sf), weights(spark)).select("id", F.round("score", 8).alias("score"), F.round("variance", 10).alias("variance"))
    return active.confident(summary, 0.03, 0.01).agg(F.count_if("sure").alias("n"))


@query("al8_existing_scores", f"WITH {INST} SELECT id, unnest([0, 1, 2]) AS member, unnest([x0, x1, x2]) AS value FROM inst")
def al8(spark, sf):
    return active.from_scores(instances(spark, sf).withColumn("s", F.array(*FEATURES)), "s")


@query("al9_decision_tree_regions")
def al9(spark, sf):
    rows = instances(spark, sf).withColumn("y", (F.col("x0") > 60).cast("int"))
    nodes = forest.from_decision_tree(learn.fit(rows, FEATURES, "tree"), FEATURES)
    return forest.regions(spark.createDataFrame(nodes, forest.NODES), FEATURES).select("region", "n", F.col("log_vol").alias("share"))


@query("sm13_drift_windows")
def sm13(spark, sf):
    """Divergence of each day's leaf shares from the first day's, tree by tree."""
    day = instances(spark, sf).select("id", F.date_format("ts", "yyyy-MM-dd").alias("day"))
    leaves = routed(spark, sf).join(day, "id")
    n = leaves.groupBy("day", "tree", "node").agg(F.count(F.lit(1)).alias("c"))
    p = n.withColumn("p", F.col("c") / F.sum("c").over(Window.partitionBy("day", "tree")))
    first = p.join(F.broadcast(p.agg(F.min("day").alias("day"))), "day").select("tree", "node", F.col("p").alias("q"))
    return p.join(F.broadcast(first), ["tree", "node"]).groupBy("day", "tree").agg(F.sum(F.col("p") * (F.log("p") - F.log("q"))).alias("kl"))


@query("sc10_bin_lookup", f"WITH {INST} SELECT id, CAST(greatest(0, least(9, floor((x0 - 5) / 20))) AS INTEGER) AS bin FROM inst")
def sc10(spark, sf):
    place = F.greatest(F.lit(0), F.least(F.lit(9), F.floor((F.col("x0") - 5) / 20))).cast("int")
    return instances(spark, sf).select("id", place.alias("bin"))


@query("pr14_region_rules", f"WITH {_HELD}, p AS (SELECT region, count(*) AS parts FROM (SELECT region, unnest([lo_x0, lo_x1, lo_x2, hi_x0, hi_x1, hi_x2]) AS b FROM box) WHERE b IS NOT NULL GROUP BY region) SELECT p.region, parts, rows FROM p JOIN held h ON h.region = p.region")
def pr14(spark, sf):
    from outlyer.functions import rules

    inf = float("inf")
    out = []
    for r in regions(spark).collect():  # a model's regions
        box = {f: (-inf if r[f"lo_{f}"] is None else r[f"lo_{f}"], inf if r[f"hi_{f}"] is None else r[f"hi_{f}"]) for f in FEATURES}
        out.append((r.region, len(rules.ConjunctiveRule.parse(rules.rule_of_ranges(box)))))
    return spark.createDataFrame(out, "region string, parts long").join(held(spark, sf).select("region", "rows"), "region")
