"""Rows of a stream that wait until a window of them is full.

Each key's rows wait in list state, across micro-batches and restarts. A row takes its place when the
watermark has passed it, so that rows that come late, but within the watermark, still go before later
ones; windows are then the same whatever order rows came in. Rows behind the watermark are dropped by Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from outlyer.streaming.windows import count_windows

#: List state and timers need this store; set it on the session before the stream starts.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
_STATE = "at long, id long, row string"


class FullWindows(StatefulProcessor):
    """Gives ``size`` rows of a key at a time, in the order of time and id, with the number of their window."""

    def __init__(self, size: int):
        self.size = size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _STATE)
        self.given = handle.getValueState("given", "windows long")

    def _settle(self, rows: list[tuple], watermark: int) -> Iterator[pd.DataFrame]:
        rows.sort()
        settled = sum(at <= watermark * 1000 for at, _, _ in rows)
        full = settled // self.size
        number = self.given.get()[0] if self.given.exists() else 0
        out = rows[: full * self.size]
        if full:
            self.given.update((number + full,))
        left = rows[full * self.size :]
        if left:
            self.waiting.put(left)
        else:
            self.waiting.clear()
        unsettled = [at for at, _, _ in left if at > watermark * 1000]
        if len(left) >= self.size and unsettled:
            # looked at again when the row has settled that fills the next window
            self.handle.registerTimer(-(-left[self.size - 1][0] // 1000))
        if out:
            yield pd.DataFrame({"row": [r for _, _, r in out], "win": [number + k // self.size for k in range(len(out))]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        for g in rows:
            held += [(int(a), int(i), r) for a, i, r in zip(g["at"], g["id"], g["row"], strict=True)]
        yield from self._settle(held, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        yield from self._settle(held, timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def buffered(events: DataFrame, by: str, time: str, id_col: str, size: int, late: str) -> DataFrame:
    """The stream ``events`` with ``win``: a key's rows by ``size`` as each window fills; rows wait ``late`` for others."""
    row = F.to_json(F.struct(*(F.col(c) for c in events.columns)))
    waiting = events.withWatermark(time, late).select(F.col(by).alias("key"), F.col(time), F.unix_micros(F.col(time).cast("timestamp")).alias("at"), F.col(id_col).cast("long").alias("id"), row.alias("row"))
    full = waiting.groupBy("key").transformWithStateInPandas(FullWindows(size), "row string, win long", "Append", "EventTime")
    return full.select(F.from_json("row", events.schema).alias("r"), "win").select("r.*", "win")


def buffered_table(events: DataFrame, by: str, time: str, id_col: str, size: int, late: str) -> DataFrame:
    """What :func:`buffered` has given once it has read all of a table: full windows of settled rows."""
    last = events.agg((F.max(F.col(time).cast("timestamp")) - F.expr(f"INTERVAL {late}")).alias("__last"))
    settled = events.crossJoin(F.broadcast(last)).where(F.date_trunc("MILLISECOND", F.col("__last")) >= F.col(time).cast("timestamp")).drop("__last")  # one row
    numbered = count_windows(settled, [by], [time, id_col], size)
    counts = settled.groupBy(by).agg(F.floor(F.count(F.lit(1)) / size).alias("__full"))
    return numbered.join(counts, by).where(F.col("win") < F.col("__full")).drop("__full")
