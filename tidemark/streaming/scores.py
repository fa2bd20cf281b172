"""Scores and flags of a stream whose rows may be late: the live counterpart of predict, score_norm and flag.

Two keyed steps. The first holds a series' rows until the watermark has passed them, then gives them out in time
order, each with the values before it; models are joined to what it gives out. The second closes a
timestamp over its channels, as a plain aggregate by event time; thresholds are joined to its rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import models as M
from ..operators import scoring
from ..operators.panel import K, small

LAGGED = "panel_id string, channel string, ts timestamp, value double, __past array<double>"


class InOrder(StatefulProcessor):
    """A series' rows in time order, each with up to ``reach`` values before it, the last one first.

    State: those values, and the rows that the watermark has not passed; of rows of one time the first to come
    counts. One timer, at the earliest row held.
    """

    def __init__(self, reach: int):
        self.reach = reach

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.past = handle.getValueState("past", "v array<double>")
        self.held = handle.getValueState("held", "at array<bigint>, v array<double>")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        at, v = self.held.get() if self.held.exists() else ([], [])
        held = dict(zip(at, v))
        for frame in rows:
            for t, x in zip(frame["ts"], frame["value"]):
                held.setdefault(pd.Timestamp(t).value // 1000, None if pd.isna(x) else float(x))
        yield self._out(key, held, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at, v = self.held.get() if self.held.exists() else ([], [])
        yield self._out(key, dict(zip(at, v)), timerValues.getCurrentWatermarkInMs())

    def _out(self, key: tuple, held: dict[int, float | None], watermark: int) -> pd.DataFrame:
        past = list(self.past.get()[0]) if self.past.exists() else []
        out = []
        for t in sorted(held):
            if t > watermark * 1000:
                break
            v = held.pop(t)
            out.append((*key, pd.Timestamp(t, unit="us"), v, past[::-1]))
            past = [*past, v][-self.reach :]
        self.past.update((past,))
        order = sorted(held)
        self.held.update((order, [held[t] for t in order]))
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        if order:
            self.handle.registerTimer(max(-(-order[0] // 1000), watermark + 1))
        return pd.DataFrame(out, columns=["panel_id", "channel", "ts", "value", "__past"]).astype({"value": np.float64})

    def close(self) -> None:
        pass


def state_in_rocksdb(spark: SparkSession) -> None:
    """Sets the state store that steps with timers need; a running query keeps its own."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def stream_predictions(stream: DataFrame, models: DataFrame, reach: int, delay: str = "2 hours") -> DataFrame:
    """(panel_id, channel, ts, value, pred) of each row that lies ``delay`` behind the newest, as ``predict`` tells it.

    ``models``: any kind that ``predict`` takes, as a static table; ``reach``: their longest lag. Rows that come
    later than that are dropped; rows within it may come in any order over the batches.
    """
    rows = stream.select(*K, "ts", "value").withWatermark("ts", delay)
    lagged = rows.groupBy(*K).transformWithStateInPandas(InOrder(reach), LAGGED, "Append", "EventTime", eventTimeColumnName="ts")
    return M.predict_from_past(lagged, models)


def stream_flags(stream: DataFrame, models: DataFrame, thresholds: DataFrame, reach: int, groups: DataFrame | None = None, order: float = 4.0, delay: str = "2 hours") -> DataFrame:
    """(panel_id, group, ts, score, threshold, flag, normalized) of each timestamp that lies ``delay`` behind the
    newest row: the norm of its channels' residuals, null if one is missing, against static ``thresholds`` (panel_id, group,
    threshold, q_low). ``groups``: (panel_id, group, channel), static; by default all channels with a model as ``system``.
    """
    told = stream_predictions(stream, models, reach, delay)
    if groups is None:
        groups = models.select(*K).distinct().withColumn("group", F.lit("system"))
    told = told.join(small(groups.select(*K, "group")), K)
    return scoring.flag(scoring.score_norm(told, order), thresholds)
