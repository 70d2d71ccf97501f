"""A forest detector over a stream: score each micro-batch, watch for drift, replace trees.

A micro-batch is a window. State between windows (forest, reference distribution, retained rows)
is kept as Parquet under the detector's folder, one version a window, so that a restarted query
goes on from the last finished one; a batch that is replayed overwrites its own version.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from outlyer.operators import drift, forest
from outlyer.streaming.windows import keep_top


@dataclass(frozen=True)
class StreamConfig:
    trees: int = 50
    samples: int = 256
    depth: int = 15
    alpha: float = 0.05
    least_rows: int = 256
    keep: int = 512
    seed: int = 42


class StreamingDetector:
    """``handler`` goes to ``writeStream.foreachBatch``; ``process`` is the same for one batch."""

    def __init__(self, features: list[str], folder: str, cfg: StreamConfig | None = None, id_col: str = "id"):
        self.features, self.folder, self.cfg, self.id_col = features, folder.rstrip("/"), cfg or StreamConfig(), id_col

    def _path(self, version: int, name: str) -> str:
        return f"{self.folder}/v{version}/{name}"

    def _last(self, spark: SparkSession, before: int) -> int | None:
        fs_path = spark._jvm.org.apache.hadoop.fs.Path
        fs = fs_path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())
        for v in range(before - 1, -1, -1):
            if fs.exists(fs_path(self._path(v, "rows/_SUCCESS"))):
                return v
        return None

    def _leaves(self, rows: DataFrame, model: forest.Model) -> DataFrame:
        trees = F.array(*(F.lit(int(t)) for t in model.trees))
        return forest.leaf_features(forest.route(rows, model), trees, self.id_col)

    def _fit(self, rows: DataFrame, trees: int, first: int) -> DataFrame:
        c = self.cfg
        return forest.fit(rows, self.features, trees=trees, samples=c.samples, depth=c.depth, seed=c.seed + first, first=first, id_col=self.id_col)

    def process(self, batch: DataFrame, version: int) -> DataFrame:
        """The batch's scores (id, score, window); the window's state is written."""
        spark, c = batch.sparkSession, self.cfg
        batch = batch.persist()
        try:
            last = self._last(spark, version)
            if last is None:
                nodes = self._fit(batch, c.trees, 0)
                replaced = 0
            else:
                nodes, replaced = self._refresh(spark, batch, last)
            nodes.coalesce(1).write.mode("overwrite").parquet(self._path(version, "forest"))
            nodes = spark.read.schema(forest.NODES).parquet(self._path(version, "forest"))
            model = forest.Model.of(nodes, self.features)
            scored = forest.isolation_score(batch, model, c.samples)
            reference = drift.leaf_distribution(self._leaves(batch, model), forest.regions(nodes, self.features))
            reference.write.mode("overwrite").parquet(self._path(version, "reference"))
            scores = scored.select(self.id_col, "score", F.lit(version).alias("window"), F.lit(replaced).alias("replaced"))
            scores.write.mode("overwrite").parquet(self._path(version, "scores"))
            rows = scored.select(self.id_col, *self.features, "score")
            old = spark.read.parquet(self._path(last, "rows")) if last is not None else rows.limit(0)
            old, rows = self._judged(old, rows, model, version, last)
            # the rows' marker says that the version is whole, so they come last
            keep_top(old, rows, "score", c.keep, self.id_col).write.mode("overwrite").parquet(self._path(version, "rows"))
            return spark.read.parquet(self._path(version, "scores"))
        finally:
            batch.unpersist()

    def _judged(self, old: DataFrame, rows: DataFrame, model: forest.Model, version: int, last: int | None) -> tuple[DataFrame, DataFrame]:
        """Retained and new rows with the score by which they stay; a detector that learns changes both."""
        return old, rows

    def _refresh(self, spark: SparkSession, batch: DataFrame, last: int) -> tuple[DataFrame, int]:
        """The last forest, with trees that the batch has drifted from grown anew, if they are many."""
        c = self.cfg
        nodes = spark.read.schema(forest.NODES).parquet(self._path(last, "forest"))
        if batch.count() < c.least_rows:
            return nodes, 0
        model = forest.Model.of(nodes, self.features)
        halves = batch.withColumn("__h", F.pmod(F.xxhash64(self.id_col), F.lit(2)))
        regions = forest.regions(nodes, self.features)
        spread = [drift.leaf_distribution(self._leaves(halves.where(F.col("__h") == h), model), regions, 1.0) for h in (0, 1)]
        limit = drift.threshold(drift.divergence(*spread), c.alpha)
        now = drift.leaf_distribution(self._leaves(batch, model), regions, 1.0)
        moved = drift.trees_to_replace(drift.divergence(spark.read.parquet(self._path(last, "reference")), now), limit)
        drifted = [r.tree for r in moved.select("tree").collect()]  # trees of a model
        if len(drifted) < int(2 * c.alpha * c.trees):
            return nodes, 0
        dropped = spark.createDataFrame([(int(t),) for t in drifted], "tree int")
        first = int(model.trees.max()) + 1
        return drift.replace_trees(nodes, dropped, self._fit(batch, len(drifted), first)), len(drifted)

    def handler(self, batch: DataFrame, batch_id: int) -> None:
        if not batch.isEmpty():
            self.process(batch, batch_id)

    def start(self, stream: DataFrame, checkpoint: str):
        """The running query; one micro-batch a window."""
        return stream.writeStream.foreachBatch(self.handler).option("checkpointLocation", checkpoint).start()
