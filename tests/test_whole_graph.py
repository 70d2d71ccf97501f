"""Graph queries over all vectors of their table, also where no id is divisible by 20."""

import numpy as np
import pandas as pd
import pytest

from outlyer.operators import graph
from outlyer.plans import registry


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    """A folder with vectors of ids 1 to 59 but 20 and 40, and their graph: all pairs of which one is among the other's four nearest."""
    rng = np.random.default_rng(5)
    ids = np.array([i for i in range(1, 60) if i % 20])
    x = rng.normal(size=(len(ids), 6)).astype(np.float32)
    rows = pd.DataFrame({"vec_id": ids, "embedding": x.tolist(), "label": ids % 3 + (ids % 2)})
    folder = tmp_path_factory.mktemp("whole")
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(folder / "embeddings.parquet"))
    d2 = ((x[:, None].astype(float) - x[None].astype(float)) ** 2).sum(2)
    near = np.argsort(d2, 1, kind="stable")[:, 1:5]
    a = np.zeros((len(ids), len(ids)))
    a[np.repeat(np.arange(len(ids)), 4), near.ravel()] = 1
    return str(folder), ids, np.maximum(a, a.T)


def test_gr1_normalises_the_graph_of_all_vectors(spark, world):
    sf, ids, a = world
    hat = a / np.sqrt(a.sum(1)[:, None] * a.sum(0))
    got = {(r.src, r.dst): r.w for r in registry.QUERIES["gr1_normalised"](spark, sf).collect()}
    assert got == {(ids[i], ids[j]): pytest.approx(hat[i, j], abs=1e-6) for i, j in zip(*np.nonzero(a), strict=True)}


def edge_table(spark, ids, a):
    return spark.createDataFrame([(int(ids[i]), int(ids[j]), 1.0) for i, j in zip(*np.nonzero(a), strict=True)], "src long, dst long, w double")


def test_gr2_classifies_all_nodes(spark, world):
    sf, ids, a = world
    got = {r.id for r in registry.QUERIES["gr2_classified"](spark, sf).collect()}
    assert got == set(ids.tolist())


def test_gr4_ensemble_has_the_nodes_of_all_members(spark, world):
    sf, ids, a = world
    want = {r.src for r in graph.member_edges(edge_table(spark, ids, a), 3, 0.7).select("src").distinct().collect()}
    assert {r.id for r in registry.QUERIES["gr4_ensemble"](spark, sf).collect()} == want and len(want) > 50


def test_dt21_spreads_labels_over_all_edges(spark, world):
    sf, ids, a = world
    hat = a / np.sqrt(a.sum(1)[:, None] * a.sum(0))
    y = ((ids % 3 + ids % 2 == 3) & (ids < 50)).astype(float)
    value = y
    for _ in range(3):
        value = 0.9 * hat @ value + 0.1 * y
    got = {r.id: r.value for r in registry.QUERIES["dt21_label_diffusion"](spark, sf).collect()}
    assert got == {i: pytest.approx(v, abs=1e-12) for i, v in zip(ids.tolist(), value, strict=True)} and value.any()


def test_features_of_unequal_length_are_propagated_by_place(spark):
    edges = spark.createDataFrame([(0, a, b, 1.0) for a, b in ((1, 2), (2, 1), (2, 3), (3, 2), (3, 4), (4, 3))], "member int, src long, dst long, w double")
    nodes = spark.createDataFrame([(1, [1.0, 2.0, 4.0]), (2, [3.0]), (3, None), (4, [5.0, None])], "id long, x array<double>")
    got = {r.id: r.x for r in graph.smoothed(edges, nodes, 1).collect()}
    root = 2**-0.5
    assert got == {1: [pytest.approx(3 * root)], 2: [pytest.approx(v * root) for v in (1, 2, 4)], 3: [pytest.approx(5 * root + 1.5), None]}
