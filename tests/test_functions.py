"""Rules, vectors and ranking against hand-worked cases."""

import math
import random

import pytest
from pyspark.sql import functions as F

from outlyer.functions import ranking, rules, vectors


@pytest.fixture(scope="module")
def kites(spark):
    return spark.createDataFrame([(0, "box", 7, 12.5, -4), (1, "delta", 3, 40.0, 0), (2, "delta", 9, 8.25, 6), (3, "sled", 5, 12.5, -9)], "id long, shape string, ribs int, reach double, drift int")


@pytest.mark.parametrize(
    ("rule", "ids"),
    [
        ("shape=delta", {1, 2}), ("reach >= 12.5", {0, 1, 3}), ("ribs<8 & drift<0", {0, 3}), ("~(shape='box' | shape='sled') & ribs > 4", {2}), ("drift>-5", {0, 1, 2}),
        ("~drift<0", {1, 2}), ("(ribs <= 5)[0.25]", {1, 3}), ("reach = 12.5 & ~shape = sled", {0}),
    ],
)
def test_rules(kites, rule, ids):
    assert {r.id for r in rules.satisfying(kites, rule).collect()} == ids


@pytest.mark.parametrize("bad", ["", "span > 3", "ribs < reach", "ribs == 3", "ribs <", "ribs < 3 [x]", "ribs $ 3"])
def test_bad_rules(kites, bad):
    with pytest.raises(Exception):  # noqa: B017
        rules.satisfying(kites, bad).collect()


def test_null_is_false(spark):
    rows = spark.createDataFrame([(0, None), (1, 2.0)], "id long, v double")
    assert [r.id for r in rules.satisfying(rows, "~(v > 1)").collect()] == [0]


def test_conjunctions():
    r = rules.ConjunctiveRule.parse("x > 1 & x <= 5 & y < 2")
    assert len(r) == 3 and r.ranges() == {"x": (1.0, 5.0), "y": (-math.inf, 2.0)}
    assert rules.rule_of_ranges(r.ranges()) == "x > 1.000000 & x <= 5.000000 & y <= 2.000000"
    assert rules.rule_of_ranges({}) is None
    assert rules.weight_of("x > 1 [0.5]") == 0.5 and r.ground({"x": 3, "y": 1}) == "x(3) > 1 & x(3) <= 5 & y(1) < 2"
    for bad in ("x > 1 | y < 2", "~x > 1"):
        with pytest.raises(ValueError):
            rules.ConjunctiveRule.parse(bad)


def test_path_lengths(spark):
    got = [r[0] for r in spark.createDataFrame([(1,), (2,), (256,)], "n int").select(vectors.average_path_length(F.col("n"))).collect()]
    assert got == pytest.approx([1.0, 1.54072569, 10.25259872], rel=1e-5)


@pytest.mark.parametrize("block", [7, 50, 10_000])
def test_row_numbers_and_sums_in_blocks(spark, block):
    rng = random.Random(1)
    data = [(k, rng.randint(0, 40), rng.random()) for k in range(500)]
    rows = spark.createDataFrame(data, "id long, s int, v double")
    for by, key in ((["s", "id"], lambda r: (r[1], r[0])), (["-s", "id"], lambda r: (-r[1], r[0]))):
        order = sorted(data, key=key)
        want = {r[0]: k for k, r in enumerate(order)}
        assert {r.id: r.pos for r in ranking.row_numbers(rows, by, "pos", block).collect()} == want
        total, sums = 0.0, {}
        for r in order:
            total += r[2]
            sums[r[0]] = total
        got = {r.id: r.t for r in ranking.running_sums(rows, by, {"t": F.col("v")}, block).collect()}
        assert all(abs(got[k] - sums[k]) < 1e-9 for k in sums)


def test_ties_and_string_keys_are_cut_into_ranges(spark):
    rows = spark.range(400).select("id", F.lit(1.0).alias("same"), F.concat(F.lit("k"), (F.col("id") * 7 % 100).cast("string")).alias("name")).repartition(3)
    for by in (["same"], ["name", "-id"]):
        cut = ranking._dealt(rows, by, 50).groupBy("__part").count().collect()
        assert len(cut) > 4 and max(r["count"] for r in cut) < 150
        assert sorted(r.pos for r in ranking.row_numbers(rows, by, "pos", 50).collect()) == list(range(400))
    order = sorted(range(400), key=lambda k: (f"k{k * 7 % 100}", -k))
    assert {r.id: r.pos for r in ranking.row_numbers(rows, ["name", "-id"], "pos", 50).collect()} == {k: p for p, k in enumerate(order)}
    sums = {r.id: r.t for r in ranking.running_sums(rows, ["name", "-id"], {"t": F.col("id")}, 50).collect()}
    assert sums[order[-1]] == sum(range(400)) and sums[order[0]] == order[0]
