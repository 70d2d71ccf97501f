"""Joins that a plain equality does not express: as-of, boxes, neighbours, hops."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Model tables of up to so many rows are broadcast.
MODEL_ROWS = 1_000_000
#: Rows and queries of a block, and queries that a task compares with a block at a time.
BLOCK_ROWS, BLOCK_QUERIES, STRIP = 16_384, 4_096, 256
#: Smaller tables are cut into so many blocks, of so many rows at least.
LEAST_BLOCKS, LEAST_ROWS = 32, 512
#: Rows of a block that are compared with a query by the least distance of them.
GROUP = 32


def model(table: DataFrame, rows: int = MODEL_ROWS) -> DataFrame:
    """A model table with a broadcast hint if it is small; else as it is."""
    return F.broadcast(table) if table.limit(rows + 1).count() <= rows else table


def as_of(rows: DataFrame, starts: DataFrame, by: list[str], t: str = "t", label: str = "label") -> DataFrame:
    """Each row with the label of the last start at or before it, inside its group.

    ``starts`` has ``by``, ``t`` and ``label``. One window over the union, no range join.
    """
    both = rows.withColumn("__l", F.lit(None).cast(dict(starts.dtypes)[label])).withColumn("__k", F.lit(1)).unionByName(
        starts.select(*by, t, F.col(label).alias("__l"), F.lit(0).alias("__k")), allowMissingColumns=True
    )
    w = Window.partitionBy(*by).orderBy(t, "__k").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(label, F.last("__l", ignorenulls=True).over(w)).where("__k = 1").select(*rows.columns, label)


def in_regions(rows: DataFrame, regions: DataFrame, features: list[str], id_col: str = "id") -> DataFrame:
    """``id, region``: closed boxes that hold a row.

    ``regions`` has ``region`` and ``lo_f, hi_f`` for each feature, null for no bound. Regions are a
    model's, so the side that is broadcast has a checked size.
    """
    inside = [
        (F.col(f"lo_{f}").isNull() | (F.col(f) >= F.col(f"lo_{f}"))) & (F.col(f"hi_{f}").isNull() | (F.col(f) <= F.col(f"hi_{f}"))) for f in features
    ]
    return rows.join(model(regions), reduce(lambda a, b: a & b, inside)).select(id_col, "region")


def nearest(rows: DataFrame, to: DataFrame, k: int, x: str = "x", id_col: str = "id") -> DataFrame:
    """``id, other, d2, pos``: each query's k nearest rows by squared distance, ties by id.

    ``to`` are the queries. Both sides are packed into blocks; each block of queries meets each block of rows
    in a task, which keeps its own k best of a query, and those few meet in the final choice. So all pairs
    are compared, and a task holds two blocks whatever the tables' sizes. A missing distance (no vector) is last.
    """
    n = rows.count()
    blocks = max(1, -(-n // BLOCK_ROWS), min(LEAST_BLOCKS, n // LEAST_ROWS))
    packed = lambda df, block: df.groupBy(block).agg(F.collect_list(F.struct(F.col(id_col).alias("id"), F.col(x).cast("array<double>").alias("x"))).alias("r"))
    spread = lambda n: F.pmod(F.xxhash64(id_col, x), F.lit(n)).cast("int")
    held = packed(rows.withColumn("block", spread(blocks)).repartition(blocks, "block"), "block")
    asked = packed(to.withColumn("__part", spread(max(1, -(-to.count() // BLOCK_QUERIES)))), "__part")
    asked = asked.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.col("r").alias("q"))
    types = dict(to.dtypes)[id_col], dict(rows.dtypes)[id_col]
    met = asked.repartition(blocks, "block").join(held.withColumnRenamed("r", "x"), "block").select("q", "x")
    best = met.mapInArrow(lambda batches: _nearest_in_blocks(batches, k), f"id {types[0]}, other {types[1]}, d2 double")
    order = [F.col("d2").asc_nulls_last(), "other"]
    return best.withColumn("pos", F.row_number().over(Window.partitionBy("id").orderBy(*order))).where(F.col("pos") <= k)


def _nearest_in_blocks(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """``id, other, d2`` of the k nearest rows of each query, a pair of blocks at a time."""
    for b in batches:
        for at in range(b.num_rows):
            (qi, q), (xi, x) = (_unpacked(b.column(c)[at].values) for c in (0, 1))
            place = np.empty(len(xi), np.int64)
            place[pc.sort_indices(xi, null_placement="at_start").to_numpy()] = np.arange(len(xi))
            for first in range(0, len(q), STRIP):
                i, j, d2 = _k_nearest(q[first : first + STRIP], x, place, k)
                found = pa.array(d2, pa.float64(), mask=np.isnan(d2))
                yield pa.RecordBatch.from_arrays([qi.take(pa.array(i + first)), xi.take(pa.array(j)), found], ["id", "other", "d2"])


def _unpacked(block: pa.StructArray) -> tuple[pa.Array, np.ndarray]:
    """Ids and vectors of a block, a row each; missing values and vectors are NaN."""
    ids, x = block.field("id"), block.field("x")
    width = pc.list_value_length(x).to_numpy(zero_copy_only=False)
    d = int(np.nanmax(width)) if len(width) and not np.isnan(width.astype(float)).all() else 0
    flat = x.flatten().to_numpy(zero_copy_only=False).astype(float)
    if not x.null_count and (width == d).all():
        return ids, flat.reshape(len(ids), d)
    width = np.nan_to_num(width.astype(float)).astype(int)
    out = np.full((len(ids), max(1, d)), np.nan)
    out[np.repeat(np.arange(len(ids)), width), np.arange(len(flat)) - np.repeat(np.cumsum(width) - width, width)] = flat
    return ids, out


def _k_nearest(q: np.ndarray, x: np.ndarray, place: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of queries and of their k nearest rows, and squared distances, ties by ``place``.

    A product of matrices gives distances, less the query's square, up to an error with a known bound. All rows that may be among the
    k nearest within it are compared exactly, summed in the order of the features.
    """
    d = max(q.shape[1], x.shape[1])
    q, x = (np.pad(m, ((0, 0), (0, d - m.shape[1])), constant_values=np.nan) for m in (q, x))
    with np.errstate(all="ignore"):
        qq, xx = (q * q).sum(1), (x * x).sum(1)
        slack = 8 * (d + 8) * np.finfo(float).eps * (qq + xx.max(initial=0.0))
        if len(x) > k and np.isfinite(slack).all():
            near = q @ (-2 * x.T)
            near += xx
            # k groups have a row as near as the k-th of their least ones, so no farther row is among the k nearest
            group = max(1, min(GROUP, len(x) // k))
            whole = len(x) // group * group
            least = np.hstack([near[:, :whole].reshape(len(q), group, -1).min(1), near[:, whole:]])
            i, j = np.nonzero(near <= np.partition(least, k - 1, 1)[:, k - 1 : k] + slack[:, None])
        else:
            i, j = (m.ravel() for m in np.indices((len(q), len(x))))
        d2 = np.zeros(len(i))
        for a, b in zip(q.T.copy(), x.T.copy(), strict=True):
            d2 += (a[i] - b[j]) ** 2
    order = np.lexsort((place[j], d2, i))  # NaN last
    i, j, d2 = i[order], j[order], d2[order]
    best = np.arange(len(i)) - np.searchsorted(i, i) < k
    return i[best], j[best], d2[best]


def adjacency(neighbours: DataFrame, euclidean: bool = False, sigma2: float = 1.0, self_loops: bool = False) -> DataFrame:
    """``src, dst, w``: the symmetric graph of ``id, other, d2``; weight 1 or exp(-d2 / sigma2)."""
    w = F.exp(-F.col("d2") / sigma2) if euclidean else F.lit(1.0)
    one = neighbours.where("id <> other").select(F.col("id").alias("src"), F.col("other").alias("dst"), w.alias("w"))
    both = one.unionAll(one.select("dst", "src", "w")).groupBy("src", "dst").agg(F.max("w").alias("w"))
    if self_loops:
        both = both.unionAll(both.select("src").distinct().select("src", F.col("src"), F.lit(1.0)))
    return both


def within_hops(edges: DataFrame, start: DataFrame, hops: int) -> DataFrame:
    """``root, node, hop``: nodes reached from each start by at most ``hops`` edges, with the fewest."""
    seen = start.select(F.col("node").alias("root"), "node", F.lit(0).alias("hop"))
    for h in range(1, hops + 1):
        step = seen.where(F.col("hop") == h - 1).join(edges.select(F.col("src").alias("node"), "dst"), "node").select("root", F.col("dst").alias("node"), F.lit(h).alias("hop"))
        seen = seen.unionAll(step).groupBy("root", "node").agg(F.min("hop").alias("hop"))
    return seen
