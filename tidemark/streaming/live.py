"""The live panel: incremental reads, resampling, upserts, one-step scores, status.

Streams run under any trigger; with ``availableNow`` each gives what its batch counterpart gives.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import aggregates, joins, ranking, windows
from ..operators.panel import K, clean, small
from .store import LiveTable  # noqa: F401 (the table that streams are merged into)


def stream_panels(spark: SparkSession, path: str, schema: str, fmt: str = "parquet") -> DataFrame:
    """Newly landed files as a stream of (panel_id, channel, ts, value)."""
    rows = spark.readStream.schema(schema).format(fmt).load(path)
    return clean(rows.withColumn("ts", F.col("ts").cast("timestamp")))


def stream_resample(stream: DataFrame, every: int = 3600, delay: str = "2 hours") -> DataFrame:
    """Means of bins closed and labelled on the right, each once its bin is past the watermark; rows later than that are dropped."""
    moved = stream.withColumn("at", F.col("ts") - F.expr("interval 1 microsecond")).withWatermark("at", delay)
    means = moved.groupBy("panel_id", "channel", F.window("at", f"{every} seconds").alias("w")).agg(F.avg("value").alias("value"))
    return means.select("panel_id", "channel", F.col("w.end").alias("ts"), "value")


def stream_regions(flags: DataFrame, gap: str = "60 minutes", delay: str = "2 hours") -> DataFrame:
    """(panel_id, start_ts, end_ts, points): sessions of flagged timestamps, not widened."""
    hits = flags.where("anomaly_flag = 1").withWatermark("ts", delay)
    runs = hits.groupBy("panel_id", F.session_window("ts", gap).alias("w")).agg(F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.count("*").alias("points"))
    return runs.select("panel_id", "start_ts", "end_ts", "points")


def upsert_live(batch: DataFrame, live: DataFrame | None, prefer_observed: bool = False) -> DataFrame:
    """The live table with a batch: what is there wins, the batch fills missing cells and adds rows.

    Of rows with equal keys in the batch the first counts. ``prefer_observed``: an observed value
    replaces a filled one. A replayed batch changes nothing.
    """
    keys = [*K, "ts"]
    once = ranking.union_first(batch, keys=keys)
    if live is None:
        return once
    merged = joins.combine_first(live, once, keys)
    if not prefer_observed:
        return merged
    real = once.where("observed = 1").select(*keys, F.col("value").alias("__v"))
    better = F.col("__v").isNotNull() & (F.coalesce("observed", F.lit(0)) == 0)
    out = merged.join(real, keys, "left")
    return out.withColumns({"value": F.when(better, F.col("__v")).otherwise(F.col("value")), "observed": F.when(better, 1).otherwise(F.col("observed"))}).drop("__v")


def renewed(live: DataFrame, baseline: DataFrame, behind: int = 3600) -> DataFrame:
    """(panel_id, __renew): whether the panel's live rows give way to the baseline's."""
    ends = lambda df, n: df.groupBy("panel_id").agg(F.max("ts").alias(n))
    differ = ranking.schema_diff(live, baseline).select("panel_id").distinct().withColumn("differ", F.lit(True))
    told = ends(baseline, "b").join(ends(live, "l"), "panel_id", "full").join(differ, "panel_id", "left")
    late = F.col("l").isNull() | F.coalesce(F.col("differ"), F.lit(False)) | (S.micros(F.col("b")) - S.micros(F.col("l")) > behind * S.MICROS)
    return told.select("panel_id", (F.coalesce(late, F.lit(False)) & F.col("b").isNotNull()).alias("__renew"))


def choose_live_base(live: DataFrame | None, baseline: DataFrame | None, behind: int = 3600) -> DataFrame:
    """For each panel, the live rows, or the baseline's where there are no live rows, the channels
    differ, or the live ones trail by over ``behind`` seconds. Neither is an error."""
    if baseline is None:
        if live is None:
            raise ValueError("neither a live table nor a baseline")
        return live
    if live is None:
        return baseline
    told = small(renewed(live, baseline, behind))
    columns = [c for c in live.columns if c in baseline.columns]
    side = lambda df, renew: df.select(*columns).join(told.where(F.col("__renew") if renew else ~F.col("__renew")).select("panel_id"), "panel_id", "left_semi")
    return side(live, False).unionByName(side(baseline, True))


def repair_gaps(live: DataFrame, full: DataFrame | None, seconds: int = 3600) -> DataFrame:
    """Panels with a gap that the full history does not have take that history; others stay. Gaps without a history are an error."""
    gaps = windows.time_gaps(live, seconds)
    if full is None:
        if not gaps.isEmpty():
            raise ValueError("gaps in the live table, and no history to check them against")
        return live
    fixable = joins.classify_gaps(gaps, windows.time_gaps(full, seconds)).where("kind = 'fixable'").select("panel_id").distinct()
    fixable = fixable.join(full.select("panel_id").distinct(), "panel_id", "left_semi")
    columns = [c for c in live.columns if c in full.columns]
    return live.select(*columns).join(fixable, "panel_id", "left_anti").unionByName(full.select(*columns).join(fixable, "panel_id", "left_semi"))


def ensure_min_history(live: DataFrame, full: DataFrame, least: int = 200) -> DataFrame:
    """Panels with fewer than ``least`` live timestamps take the full table's rows."""
    few = full.select("panel_id").distinct().join(live.groupBy("panel_id").agg(F.count_distinct("ts").alias("n")), "panel_id", "left").where(F.coalesce("n", F.lit(0)) < least).select("panel_id")
    return live.join(few, "panel_id", "left_anti").unionByName(full.join(few, "panel_id", "left_semi").select(live.columns))


STATE = "past array<double>"
SCORE = "panel_id string, ts timestamp, channel string, value double, pred double"


def stream_score(stream: DataFrame, models: DataFrame) -> DataFrame:
    """(panel_id, ts, channel, value, pred): one-step predictions of a stream with existing models.

    ``models`` (panel_id, channel, lags, coef, intercept) is joined as a static table; the state of a
    series is its last max(lags) values, nothing more. For sources whose rows come in time order over all
    batches: nothing is held back. Where rows may be late, see ``scores.stream_predictions``.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    rows = stream.join(small(models.select(*K, "lags", "coef", "intercept")), K)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        past = list(state.get[0]) if state.exists else []
        frame = pd.concat(list(batches)).sort_values("ts", kind="stable")
        out = []
        for r in frame.itertuples(index=False):
            pred = None
            if len(past) >= max(r.lags):
                x = [past[-k] for k in r.lags]
                pred = None if any(v is None or v != v for v in x) else float(r.intercept + sum(c * v for c, v in zip(r.coef, x, strict=True)))
            out.append((key[0], r.ts, key[1], r.value, pred))
            past = [*past, None if pd.isna(r.value) else float(r.value)][-max(r.lags) :]
        state.update((past,))
        yield pd.DataFrame(out, columns=["panel_id", "ts", "channel", "value", "pred"])

    return rows.groupBy(*K).applyInPandasWithState(step, SCORE, STATE, "append", GroupStateTimeout.NoTimeout)


def stream_freshness(live: DataFrame, now: Column) -> DataFrame:
    """Freshness and status of the live table after a batch."""
    return aggregates.freshness(live, now)


def stream_alerts(scores: DataFrame, values: DataFrame) -> DataFrame:
    """The latest timestamp of each panel, where it is flagged."""
    return ranking.current_status(scores, values).where("anomaly_flag = 1")


def source_status(batch: DataFrame | None, name: str, error: str | None = None) -> DataFrame | None:
    """(source, status, error): disabled without a batch, error with a message, degraded if nothing was observed, else ok."""
    if batch is None:
        return None
    seen = batch.agg(F.count("value").alias("n"))
    status = F.lit("error") if error else F.when(F.col("n") == 0, "degraded").otherwise("ok")
    return seen.select(F.lit(name).alias("source"), status.alias("status"), F.lit(error).cast("string").alias("error"))
