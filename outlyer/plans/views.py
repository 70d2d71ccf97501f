"""Tables and the instance views that queries start from, in both dialects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FEATURES = ["x0", "x1", "x2"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as instances: id, value, hour and k as features; errors are the anomalies."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("id"), F.col("value").alias("x0"), F.hour("ts").cast("double").alias("x1"),
        F.regexp_extract("props", r"(\d+)", 1).cast("double").alias("x2"), (F.col("event_type") == "error").cast("int").alias("y"), "event_type", "user_id", "ts",
    )


#: The same view in SQL.
INST = (
    "inst AS (SELECT event_id AS id, value AS x0, CAST(hour(ts) AS DOUBLE) AS x1, CAST(regexp_extract(props, '(\\d+)', 1) AS DOUBLE) AS x2, "
    "CAST(event_type = 'error' AS INTEGER) AS y, event_type, user_id, ts FROM events)"
)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.transform("embedding", lambda v: v.cast("double")).alias("x"), "label")


VEC = "vec AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS x, label FROM embeddings)"

#: A small forest as rows: tree, node, left, right, feature, threshold, n, depth, log_vol.
FOREST = [
    (0, 0, 1, 2, 0, 40.0, 256, 0, 0.0), (0, 1, 3, 4, 1, 11.0, 140, 1, -0.6931), (0, 2, -1, -1, -1, 0.0, 116, 1, -0.6931),
    (0, 3, -1, -1, -1, 0.0, 60, 2, -1.3863), (0, 4, -1, -1, -1, 0.0, 80, 2, -1.3863),
    (1, 0, 1, 2, 2, 50.0, 256, 0, 0.0), (1, 1, -1, -1, -1, 0.0, 120, 1, -0.6931), (1, 2, 3, 4, 0, 100.0, 136, 1, -0.6931),
    (1, 3, -1, -1, -1, 0.0, 110, 2, -1.3863), (1, 4, -1, -1, -1, 0.0, 26, 2, -1.3863),
    (2, 0, 1, 2, 1, 17.0, 256, 0, 0.0), (2, 1, 3, 4, 2, 20.0, 180, 1, -0.6931), (2, 2, 5, 6, 0, 20.0, 76, 1, -0.6931),
    (2, 3, -1, -1, -1, 0.0, 40, 2, -1.3863), (2, 4, -1, -1, -1, 0.0, 140, 2, -1.3863), (2, 5, -1, -1, -1, 0.0, 30, 2, -1.3863), (2, 6, -1, -1, -1, 0.0, 46, 2, -1.3863),
]


def small_forest(spark: SparkSession) -> DataFrame:
    from outlyer.operators.forest import NODES

    return spark.createDataFrame(FOREST, NODES)


def _values(rows, names: str) -> str:
    # casts: decimal literals would change the arithmetic
    cell = lambda v: "NULL" if v is None else f"CAST({v} AS DOUBLE)" if isinstance(v, float) else f"'{v}'" if isinstance(v, str) else str(v)
    return f"(VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) AS t({names})"


#: The leaves as half-open boxes, as routing sees them: left holds the threshold.
def leaf_boxes() -> list[tuple]:
    nodes = {(r[0], r[1]): r for r in FOREST}
    out, todo = [], [((t, 0), {}) for t in range(3)]
    while todo:
        key, box = todo.pop(0)
        tree, node, left, right, f, cut, n, depth, log_vol = nodes[key]
        if left < 0:
            out.append((tree, node, f"{tree}:{node}", depth, n, log_vol, *(box.get(k, (None, None))[0] for k in range(3)), *(box.get(k, (None, None))[1] for k in range(3))))
        else:
            lo, hi = box.get(f, (None, None))
            todo += [((tree, left), {**box, f: (lo, cut)}), ((tree, right), {**box, f: (cut, hi)})]
    return out


BOXES = "box AS (SELECT * FROM " + _values(leaf_boxes(), "tree, node, region, path_length, n, log_vol, lo_x0, lo_x1, lo_x2, hi_x0, hi_x1, hi_x2") + ")"
#: Each instance's leaf of each tree.
ROUTED = (
    "routed AS (SELECT i.id, i.y, b.* FROM inst i JOIN box b ON "
    + " AND ".join(f"(b.lo_x{k} IS NULL OR i.x{k} > b.lo_x{k}) AND (b.hi_x{k} IS NULL OR i.x{k} <= b.hi_x{k})" for k in range(3))
    + ")"
)
