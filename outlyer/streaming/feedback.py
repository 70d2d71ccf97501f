"""A forest detector over a stream that asks an analyst in each window and learns from the answers.

What a window leaves to the next is written with its version: forest, retained rows, all labelled rows
with their features, and weights. Members of trees that have been replaced lose their weights; labelled rows
are read through the new forest. Answers are written as they are given, so that a batch that is
replayed, wherever it was cut off, takes them from there and comes to the same state.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from outlyer.functions.vectors import squared_distance
from outlyer.operators import drift, forest, members
from outlyer.operators.active import Config
from outlyer.operators.metrics import budget_size
from outlyer.streaming.detector import StreamConfig, StreamingDetector


@dataclass(frozen=True)
class FeedbackConfig:
    """Questions of a window: ``least`` whatever the confidence, ``most`` at most, ``budget`` over the stream.

    With ``sure`` a row beyond the least is asked only if its score less ``width`` deviations reaches the
    score at the tau rank (the tau share of rows, ``least_rank`` at least); one that does not uses up a question.
    ``nominals`` initial ones are kept: all (-1), none (0), or so many that lie far from what is kept.
    """

    least: int = 2
    most: int = 10
    budget: int = 100
    sure: bool = False
    width: float = 3.0
    least_rank: int = 10
    nominals: int = -1
    pretraining: int = 10
    learn: Config = Config()


def tau_rank(rows: int, tau: float, least_rank: int = 10) -> int:
    return min(max(budget_size(rows, tau, rows), least_rank), rows)


def window_asked(scored: DataFrame, labelled: DataFrame, tau: float, cfg: FeedbackConfig) -> DataFrame:
    """``id, score, turn``: what a window asks while its weights stay as they are.

    ``scored`` is ``id, score, variance`` of the window's rows, ``labelled`` the ids that have labels.
    """
    fresh = scored.join(F.broadcast(labelled.select("id")), "id", "left_anti")  # as many as were answered
    rank = tau_rank(fresh.count(), tau, cfg.least_rank)
    best = fresh.orderBy(F.col("score").desc(), "id").limit(max(cfg.most, rank + 1))
    turn = F.row_number().over(Window.partitionBy().orderBy(F.col("score").desc(), "id"))  # the tau share of a window
    best = best.withColumn("turn", turn)
    at = best.where(F.col("turn") <= rank + 1).agg(F.min("score").alias("__at"))
    goes = (F.col("turn") <= cfg.least) | (F.col("score") - cfg.width * F.sqrt("variance") >= F.col("__at")) if cfg.sure else F.lit(True)
    return best.crossJoin(F.broadcast(at)).where((F.col("turn") <= cfg.most) & goes).select("id", "score", "turn")  # one row


def far_nominals(labels: DataFrame, features: list[str], n: int, id_col: str = "id") -> DataFrame:
    """``labels`` (id, y, features) with all anomalies and ``n`` nominals: always the one with the greatest mean distance
    from what is kept; ties by id. Each pick is one aggregation, only anomalies and picks reach the driver."""
    x = F.array(*(F.col(f).cast("double") for f in features))
    kept = [list(map(float, r.x)) for r in labels.where("y = 1").select(x.alias("x")).collect()]  # given anomalies
    rest, ids = labels.where("y = 0").select(F.col(id_col).alias("id"), x.alias("x")), []
    for _ in range(min(n, len(kept))):
        far = F.lit(0.0)
        for v in kept:
            far = far + F.sqrt(squared_distance(F.col("x"), F.lit(v)))
        pick = rest.where(~F.col("id").isin(ids)).agg(F.max(F.struct(far.alias("far"), (-F.col("id")).alias("id"), "x")).alias("p")).first().p
        if pick is None:
            break
        ids.append(-pick.id)
        kept.append(list(pick.x))
    return labels.where((F.col("y") == 1) | F.col(id_col).isin(ids))


class FeedbackDetector(StreamingDetector):
    """``answer`` takes a list of ids and gives a dict of labels, 1 for anomalies. ``initial`` are labelled rows (id, features, y)."""

    def __init__(self, features: list[str], folder: str, answer: Callable[[list[int]], dict[int, int]], cfg: StreamConfig | None = None, feedback: FeedbackConfig | None = None, initial: DataFrame | None = None, query: str = "top", id_col: str = "id"):
        super().__init__(features, folder, cfg, id_col)
        self.answer, self.feedback, self.initial, self.query = answer, feedback or FeedbackConfig(), initial, query
        #: With the last window all that is left of the budget is asked.
        self.last_window = False

    # state

    def _labels(self, spark: SparkSession, last: int | None) -> DataFrame:
        """``id, y, window, turn`` and features of all rows with labels; window -1 for initial ones."""
        if last is not None:
            return spark.read.parquet(self._path(last, "labels"))
        schema = f"{self.id_col} long, y int, window int, turn int, " + ", ".join(f"{f} double" for f in self.features)
        if self.initial is None:
            return spark.createDataFrame([], schema)
        kept, n = self.initial, self.feedback.nominals
        if n >= 0:
            kept = far_nominals(kept, self.features, n, self.id_col)
        return kept.select(F.col(self.id_col).cast("long"), F.col("y").cast("int"), F.lit(-1).alias("window"), F.lit(0).alias("turn"), *(F.col(f).cast("double") for f in self.features))

    def _weights(self, spark: SparkSession, last: int | None, model: forest.Model) -> members.Weights:
        n = int((model.left < 0).sum())
        if last is None:
            return members.Weights.uniform(n)
        rows = spark.read.parquet(self._path(last, "weights")).collect()  # as many as labels reach
        there = {f"{t}:{k}" for t, k, left in zip(model.tree, model.node, model.left, strict=True) if left < 0}
        other = next(r.w for r in rows if r.member is None)
        known = {r.member: r.w for r in rows if r.member in there}
        size = np.sqrt(sum(v * v for v in known.values()) + (n - len(known)) * other**2) or 1.0
        return members.Weights(n, other / size, {m: v / size for m, v in known.items()})

    def _answers(self, spark: SparkSession, version: int, turn: int, ids: list[int]) -> dict[int, int]:
        """Labels of a turn: those already given to this version for the same ids, else asked for and written."""
        path = self._path(version, f"answers/t{turn}")
        place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        if place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
            given = {r.id: r.y for r in spark.read.parquet(path).collect()}  # a batch
            if set(given) == set(ids):
                return given
        given = {int(i): int(y) for i, y in self.answer(ids).items()}
        spark.createDataFrame([(i, given[i]) for i in ids], "id long, y int").coalesce(1).write.mode("overwrite").parquet(path)
        return given

    # a window

    def _judged(self, old, rows, model, version, last):
        spark, c, own = rows.sparkSession, self.feedback, self.id_col
        labels = self._labels(spark, last).persist()
        weights = self._weights(spark, last, model)
        pool = old.unionByName(rows).dropDuplicates([own]).join(F.broadcast(labels.select(own)), own, "left_anti")
        everyone = pool.select(own, *self.features).unionByName(labels.select(own, *self.features))
        values = model.region_scores("inverse_length", self.cfg.samples)
        table = members.forest_members(everyone, model, values / (np.linalg.norm(values) or 1.0), own).persist()
        try:
            if last is None and self.initial is not None:
                given = self.initial.select(F.col(own).alias("id"), "y")
                known = members.forest_members(self.initial, model, values / (np.linalg.norm(values) or 1.0), own)
                weights, _ = members.pretrain(known, given, weights, c.learn, c.pretraining)
            weights, asked = self._asked(table, labels.select(F.col(own).alias("id"), "y", "window").collect(), weights, version)
            answered = spark.createDataFrame([(i, y, version, t) for t, (i, y) in enumerate(asked)], f"{own} long, y int, window int, turn int")
            new = pool.join(F.broadcast(answered), own).select(labels.columns)
            labels.unionByName(new).coalesce(1).write.mode("overwrite").parquet(self._path(version, "labels"))
            kept = [(None, float(weights.other)), *((m, float(w)) for m, w in weights.known.items())]
            spark.createDataFrame(kept, "member string, w double").coalesce(1).write.mode("overwrite").parquet(self._path(version, "weights"))
            scored = members.summary(table, weights).select(F.col("id").alias(own), "score")
            fresh = pool.drop("score").join(scored, own).join(F.broadcast(answered.select(own)), own, "left_anti").select(rows.columns)
            # kept from here on, as the member table goes
            fresh.write.mode("overwrite").parquet(self._path(version, "judged"))
        finally:
            table.unpersist()
            labels.unpersist()
        fresh = spark.read.schema(rows.schema).parquet(self._path(version, "judged"))
        return fresh.limit(0), fresh

    def _asked(self, table: DataFrame, known: list, weights: members.Weights, version: int) -> tuple[members.Weights, list[tuple[int, int]]]:
        """Weights after the window, and ids with labels in the order in which they were asked."""
        spark, c = table.sparkSession, self.feedback
        labels = [(int(r.id), int(r.y)) for r in known]
        rows = table.select("id").distinct().count()
        fresh_rows = rows - len(labels)
        left = max(0, c.budget - sum(r.window >= 0 for r in known))
        most = min(left if self.last_window else min(c.most, left), fresh_rows)
        tau = drift.tau_again(sum(y for _, y in labels), rows, c.learn.tau)
        cfg = replace(c.learn, tau=tau)
        start, asked, skipped, spent, turn = members.Weights.uniform(weights.n), [], [], 0, 0
        view = _View(cfg, table)
        while spent < most:
            scored = members.summary(table, weights).persist()
            try:
                free = scored.join(F.broadcast(spark.createDataFrame([(i,) for i, _ in labels], "id long")), "id", "left_anti")
                open_ = free.join(F.broadcast(spark.createDataFrame([(i,) for i in skipped], "id long")), "id", "left_anti")
                view.asked(len(labels))
                found = members.STRATEGIES[self.query](open_, view).collect()[: most - spent]  # a batch
                if not found:
                    break
                spent += len(found)
                if c.sure and spent > c.least:
                    rank = tau_rank(fresh_rows - len(asked), tau, c.least_rank)
                    at = free.orderBy(F.col("score").desc(), "id").limit(rank + 1).agg(F.min("score").alias("s")).first().s
                    if found[0].score - c.width * np.sqrt(found[0].variance) < at:
                        skipped += [int(r.id) for r in found]
                        continue
                ids = [int(r.id) for r in found]
                given = self._answers(spark, version, turn, ids)
                turn += 1
                labels += [(i, given[i]) for i in ids]
                asked += [(i, given[i]) for i in ids]
                skipped = []
                q, tau_id = members.at_quantile(scored, tau)
            finally:
                scored.unpersist()
            names, x = members.vectors(table, [*(i for i, _ in labels), tau_id])
            weights = members.learn(weights, start, names, x[:-1], np.array([y for _, y in labels]), q, cfg, x[-1])
        return weights, asked


class _View:
    """What a query strategy looks at."""

    id_col, costs = "id", None

    def __init__(self, cfg: Config, table: DataFrame):
        self.cfg, self.members, self.state = cfg, table, members.State(members.Weights.uniform(1))

    def asked(self, n: int) -> None:
        self.state.asked = [0] * n
