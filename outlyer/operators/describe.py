"""Descriptions of anomalies: region volumes, compact covers, Bayesian rule sets."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outlyer.functions import rules as R
from outlyer.functions.tables import written


def volumes(regions: DataFrame, ranges: DataFrame, features: list[str]) -> DataFrame:
    """``region, volume``: product of widths inside the features' ranges; a width of 0 counts as 1."""
    lim = ranges.agg(*(F.max(F.when(F.col("feature") == f, F.col(e))).alias(f"__{e}_{f}") for f in features for e in ("lo", "hi")))
    wide = regions.crossJoin(F.broadcast(lim))  # one row
    width = [F.coalesce(f"hi_{f}", f"__hi_{f}") - F.coalesce(f"lo_{f}", f"__lo_{f}") for f in features]
    return wide.select("region", reduce(lambda a, b: a * b, (F.when(w == 0, F.lit(1.0)).otherwise(w) for w in width)).alias("volume"))


def complexity(regions: DataFrame, features: list[str]) -> DataFrame:
    """``region, complexity``: 2 to the number of bounds less 1, that at most 9."""
    bounds = reduce(lambda a, b: a + b, (F.col(f"{e}_{f}").isNotNull().cast("int") for f in features for e in ("lo", "hi")))
    return regions.select("region", F.pow(F.lit(2.0), F.greatest(F.lit(0), F.least(bounds - 1, F.lit(9)))).alias("complexity"))


def top_regions(memberships: DataFrame, weights: DataFrame, n: int) -> DataFrame:
    """``region``: the union of each row's n best regions by ``worth``."""
    from pyspark.sql import Window

    best = F.row_number().over(Window.partitionBy("id").orderBy(F.col("worth").desc(), "region"))
    return memberships.join(F.broadcast(weights), "region").withColumn("__k", best).where(F.col("__k") <= n).select("region").distinct()


def cover(covers: list[set[int]], costs: list[float], limit: int = 200_000) -> tuple[list[int], bool]:
    """Cheapest sets that cover everything any set covers, and whether that is proven.

    Branch and bound over a few dozen elements: always the element in fewest sets; the bound adds for
    each uncovered element the least share of a set's cost. The greedy cover is the first incumbent.
    """
    whole = set().union(*covers) if covers else set()
    left, best = set(whole), []
    while left:
        k = min((k for k in range(len(covers)) if covers[k] & left), key=lambda k: (costs[k] / len(covers[k] & left), k))
        best.append(k)
        left -= covers[k]
    price, steps = sum(costs[k] for k in best), 0
    todo = [(0.0, [], whole)]
    while todo and steps < limit:
        steps += 1
        paid, chosen, left = todo.pop()
        if not left:
            if paid < price - 1e-12:
                price, best = paid, chosen
            continue
        least = sum(min(costs[k] / len(covers[k] & left) for k in range(len(covers)) if e in covers[k]) for e in left)
        if paid + least >= price - 1e-12:
            continue
        e = min(left, key=lambda e: (sum(e in c for c in covers), e))
        for k in sorted((k for k in range(len(covers)) if e in covers[k]), key=lambda k: -costs[k]):
            todo.append((paid + costs[k], [*chosen, k], left - covers[k]))
    return sorted(best), not todo


#: Up to so many different sets of regions the cheapest cover is sought on the driver; more are covered greedily on Spark.
EXACT_SETS = 256


def membership_sets(memberships: DataFrame, costs: DataFrame) -> DataFrame:
    """``s``: the different sets of priced regions that rows (``id, region``) lie in; a set is no longer than the model has members."""
    priced = memberships.join(costs.select("region").distinct(), "region", "left_semi")
    return priced.groupBy("id").agg(F.sort_array(F.collect_set("region")).alias("s")).select("s").distinct()


def greedy_cover(sets: DataFrame, costs: DataFrame) -> list[str]:
    """Regions that meet all ``sets``, always the one that costs least for each set it newly meets; ties by name.

    A step is one count of the open sets by region, of which the best region reaches the driver. At the end
    regions that the others make needless are dropped, the costliest first. The price is at most the
    harmonic number of the largest region's sets times the least.
    """
    chosen: list[str] = []
    open_ = sets
    while True:
        new = open_.select(F.explode("s").alias("region")).groupBy("region").agg(F.count(F.lit(1)).alias("n"))
        best = new.join(costs, "region").orderBy(F.col("volume") / F.col("n"), "region").limit(1).collect()
        if not best:
            break
        chosen.append(best[0].region)
        open_ = sets.where(~F.arrays_overlap("s", F.array(*map(F.lit, chosen))))
    price = {r.region: r.volume for r in costs.where(F.col("region").isin(chosen)).collect()}
    while chosen:
        own = F.array_intersect("s", F.array(*map(F.lit, chosen)))
        needed = {r.r for r in sets.where(F.size(own) == 1).select(own[0].alias("r")).distinct().collect()}  # regions of the cover
        spare = [r for r in chosen if r not in needed]
        if not spare:
            break
        chosen.remove(max(spare, key=lambda r: (price[r], r)))
    return sorted(chosen)


def compact_regions(memberships: DataFrame, costs: DataFrame) -> list[str]:
    """Regions that cover the described rows (``id, region``) at least cost (``region, volume``).

    Rows in the same regions are covered alike, so only different sets of regions count. While they are
    few the cover is the cheapest one; else it is greedy, and only regions of the model reach the driver.
    """
    costs = costs.select("region", F.greatest("volume", F.lit(1e-12)).alias("volume"))
    sets = written(membership_sets(memberships, costs), "sets")
    if sets.count() > EXACT_SETS:
        return greedy_cover(sets, costs)
    few = [set(r.s) for r in sets.collect()]  # EXACT_SETS at most
    names = sorted(set().union(*few)) if few else []
    price = {r.region: r.volume for r in costs.where(F.col("region").isin(names)).collect()}
    chosen, _ = cover([{k for k, s in enumerate(few) if n in s} for n in names], [price[n] for n in names])
    return [names[k] for k in chosen]


def describe(rows: DataFrame, wanted: DataFrame, regions: DataFrame, features: list[str], negatives: DataFrame | None = None, least_precision: float = 0.4, p: float = 1.0) -> list[dict]:
    """Rules for ``wanted`` rows (id), cheapest by volume ** p, negatives inside and complexity.

    Rules under the least precision are dropped, unless none would be left.
    """
    from outlyer.operators.joins import in_regions

    from outlyer.operators.joins import model

    wanted = model(wanted)
    inside = in_regions(rows.join(wanted, "id", "left_semi"), regions, features)
    from outlyer.functions.vectors import feature_ranges

    cost = volumes(regions, feature_ranges(rows, features), features).join(complexity(regions, features), "region")
    hits = in_regions(negatives, regions, features).groupBy("region").agg(F.count(F.lit(1)).alias("neg")) if negatives is not None else None
    cost = cost.join(hits, "region", "left") if hits is not None else cost.withColumn("neg", F.lit(0))
    v = F.pow("volume", F.lit(p))
    cost = cost.select("region", (v + F.coalesce("neg", F.lit(0)) * v + F.col("complexity")).alias("volume"))
    chosen = compact_regions(inside, cost)
    boxes = {r.region: r for r in regions.where(F.col("region").isin(chosen)).collect()}
    out = []
    for name in chosen:
        r = boxes[name]
        box = {f: (-math.inf if r[f"lo_{f}"] is None else r[f"lo_{f}"], math.inf if r[f"hi_{f}"] is None else r[f"hi_{f}"]) for f in features}
        rule = R.rule_of_ranges({f: b for f, b in box.items() if b != (-math.inf, math.inf)})
        if rule:
            out.append({"region": name, "rule": rule})
    if out and negatives is not None:
        labelled = rows.join(wanted, "id", "left_semi").select(*features).withColumn("y", F.lit(1)).unionByName(negatives.select(*features).withColumn("y", F.lit(0)))
        for o, r in zip(out, R.confusion(labelled, [o["rule"] for o in out]).orderBy("rule_id").collect(), strict=True):
            o["precision"] = r.support or 0.0
        good = [o for o in out if o["precision"] >= least_precision]
        out = good or [max(out, key=lambda o: o["precision"])]
    return out


def log_beta_binomial(k: int, n: int, a: float, b: float) -> float:
    lg = math.lgamma
    return lg(n + 1) - lg(k + 1) - lg(n - k + 1) + lg(k + a) + lg(n - k + b) - lg(n + a + b) + lg(a + b) - lg(a) - lg(b)


def bayesian_ruleset(covered: np.ndarray, y: np.ndarray, lengths: list[int], steps: int = 500, support: float = 0.05, seed: int = 42, counts: np.ndarray | None = None) -> list[int]:
    """Rules (columns of a 0/1 matrix, a row for each distinct pattern with its ``counts``) of high posterior, by seeded annealing.

    Moves add a rule that covers a missed anomaly, drop one, or swap; the temperature falls from 1000
    to 1. The prior is beta-binomial in the number of rules, the likelihood in both sides' errors.
    """
    rng = np.random.default_rng(seed)
    y, covered = y.astype(bool), covered.astype(bool)
    n = np.ones(len(y), int) if counts is None else np.asarray(counts)
    free = [k for k in range(covered.shape[1]) if n[y & covered[:, k]].sum() >= max(1, support * n[y].sum())]
    if not free:
        return []

    def worth(chosen: frozenset) -> float:
        hit = covered[:, sorted(chosen)].any(1) if chosen else np.zeros(len(y), bool)
        tp, fp, fn, tn = (int(n[m].sum()) for m in (hit & y, hit & ~y, ~hit & y, ~hit & ~y))
        prior = log_beta_binomial(len(chosen), max(len(free), len(chosen)), 1, 10) - 0.1 * sum(lengths[k] for k in chosen)
        return prior + log_beta_binomial(tp, tp + fp, 100, 1) + log_beta_binomial(tn, tn + fn, 100, 1)

    now = best = frozenset()
    now_worth = best_worth = worth(now)
    for i in range(steps):
        hit = covered[:, sorted(now)].any(1) if now else np.zeros(len(y), bool)
        missed = np.flatnonzero(y & ~hit)
        move = set(now)
        if len(missed) and (not now or rng.random() < 0.6):
            options = [k for k in free if covered[missed[rng.integers(len(missed))], k] and k not in now]
            if options:
                move.add(options[rng.integers(len(options))])
        elif now:
            move.discard(sorted(now)[rng.integers(len(now))])
        new = frozenset(move)
        value = worth(new)
        if value >= now_worth or rng.random() < math.exp((value - now_worth) / 1000 ** (1 - (i + 1) / steps)):
            now, now_worth = new, value
        if now_worth > best_worth:
            best, best_worth = now, now_worth
    return sorted(best)


def interval_items(rows: DataFrame, features: list[str], levels: tuple[int, ...] = (2, 4)) -> tuple[DataFrame, dict[str, tuple[float, float]]]:
    """``rows`` with ``items``: for each feature and level the part of the feature's range, of that many equal ones, that holds it.

    An item is ``feature:level:part``. Also the ranges.
    """
    lim = rows.agg(*(e(f).cast("double").alias(f"{n}_{f}") for f in features for n, e in (("lo", F.min), ("hi", F.max)))).first()
    ranges = {f: (lim[f"lo_{f}"] or 0.0, lim[f"hi_{f}"] or 0.0) for f in features}
    items = []
    for f in features:
        lo, hi = ranges[f]
        for n in levels:
            part = F.lit(0) if hi <= lo else F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor((F.col(f) - lo) / (hi - lo) * n)))
            items.append(F.concat(F.lit(f"{f}:{n}:"), part.cast("string")))
    return rows.withColumn("items", F.array(*items)), ranges


def mined_patterns(rows: DataFrame, support: float, longest: int = 3) -> DataFrame:
    """``items, freq``: sets of items that a share ``support`` of the rows with ``y`` 1 has, one item a feature, sorted.

    Found by MLlib's frequent-pattern growth, which deals conditional trees over the cluster.
    """
    from pyspark.ml.fpm import FPGrowth

    found = FPGrowth(itemsCol="items", minSupport=support).fit(rows.where("y = 1").select("items")).freqItemsets
    names = F.transform("items", lambda i: F.substring_index(i, ":", 1))
    return found.where((F.size("items") <= longest) & (F.size(F.array_distinct(names)) == F.size("items"))).select(F.sort_array("items").alias("items"), "freq")


def mined_rules(rows: DataFrame, features: list[str], support: float = 0.1, most: int = 60, levels: tuple[int, ...] = (2, 4), longest: int = 3) -> list[str]:
    """Candidate rules on the features: frequent among rows with ``y`` 1, the ``most`` of highest precision (ties: support, name)."""
    marked, ranges = interval_items(rows.select("y", *features), features, levels)
    patterns = mined_patterns(marked, support, longest)
    # how often each pattern holds at all: rows with the same items are counted once, and these are as many as the levels give, whatever the table
    cells = written(marked.groupBy("items").agg(F.count(F.lit(1)).alias("c")), "cells")
    every = cells.withColumn("__id", F.monotonically_increasing_id()).select("__id", "c", F.explode("items").alias("item"))
    parts = written(patterns.withColumn("pattern", F.concat_ws(" ", "items")), "patterns")
    wanted = parts.select("pattern", F.size("items").alias("size"), F.explode("items").alias("item"))
    held = every.join(wanted, "item").groupBy("__id", "c", "pattern", "size").agg(F.count(F.lit(1)).alias("n")).where("n = size").groupBy("pattern").agg(F.sum("c").alias("rows"))
    best = parts.join(held, "pattern").orderBy((F.col("freq") / F.col("rows")).desc(), F.col("freq").desc(), "pattern").limit(most).collect()  # ``most`` rules
    out = []
    for r in best:
        box = {}
        for item in r["items"]:
            f, n, k = item.split(":")
            lo, hi = ranges[f]
            width, k, n = (hi - lo) / int(n), int(k), int(n)
            box[f] = (-math.inf if k == 0 else lo + k * width, math.inf if k == n - 1 else lo + (k + 1) * width)
        rule = R.rule_of_ranges({f: b for f, b in box.items() if b != (-math.inf, math.inf)})
        if rule and rule not in out:
            out.append(rule)
    return out


def coverage_patterns(rows: DataFrame, rules: list[str]) -> DataFrame:
    """``covered, y, n``: how many rows of each label each set of rules holds for; a row is a bit a rule."""
    bits = reduce(lambda a, b: a.bitwiseOR(b), (F.when(R.condition(r, rows), F.lit(1 << k)).otherwise(F.lit(0)).cast("long") for k, r in enumerate(rules)), F.lit(0).cast("long"))
    return rows.select(bits.alias("covered"), F.col("y").cast("int").alias("y")).groupBy("covered", "y").agg(F.count(F.lit(1)).alias("n"))


def bayesian_rules(rows: DataFrame, features: list[str], support: float = 0.1, most: int = 60, steps: int = 500, seed: int = 42, levels: tuple[int, ...] = (2, 4)) -> list[str]:
    """Mined rules of high posterior for ``y`` (at most 62 candidates). Rows are counted by the rules that hold for
    them, which depends on the cell that a row lies in; only those counts reach the driver."""
    candidates = mined_rules(rows, features, support, min(62, most), levels)
    if not candidates:
        return []
    got = coverage_patterns(rows, candidates).orderBy("covered", "y").collect()
    covered = np.array([[r.covered >> k & 1 for k in range(len(candidates))] for r in got])
    chosen = bayesian_ruleset(covered, np.array([r.y for r in got]), [len(R.ConjunctiveRule.parse(c)) for c in candidates], steps, seed=seed, counts=np.array([r.n for r in got]))
    return [candidates[k] for k in chosen]
