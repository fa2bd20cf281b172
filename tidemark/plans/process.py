"""Raw readings to processed panel: one lazy plan over all panels."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import filters, imputation, joins, windows
from ..operators.panel import settled, small


def pipeline(df: DataFrame, steps: list[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """The steps one after the other."""
    for step in steps:
        df = df.transform(step)
    return df


def process(raw: DataFrame, exog: DataFrame | None = None, every: int = 3600, flag_channel: str | None = None, bounds: DataFrame | None = None, config: dict | None = None, method: str = "linear_interpolation", kernel: int = 3, median: str = "flow", average: str = "temperature", baseline: str | None = None) -> DataFrame:
    """External series, resampling, maintenance, bounds, imputation, median filter, sensor mean,
    baseline: the order is fixed. ``exog``: (ts, measures) joined as channels exogenous_<measure>."""
    if exog is not None:
        measures = [c for c in exog.columns if c != "ts"]
        names = [f"exogenous_{m}" for m in measures]
        side = joins.asof_join(raw.select("panel_id", "ts").distinct(), exog.select("ts", *[F.col(m).alias(n) for m, n in zip(measures, names, strict=True)]), names)
        raw = raw.unionByName(side.unpivot(["panel_id", "ts"], names, "channel", "value").select("panel_id", "channel", "ts", "value"))
    steps = [lambda d: windows.resample_mean(d, every)]
    if flag_channel:
        steps.append(lambda d: filters.mask_maintenance(d, flag_channel))
    if bounds is not None:
        steps.append(lambda d: filters.mask_bounds(d, bounds))
    steps += [
        lambda d: imputation.impute_channels(d, config, method),
        lambda d: windows.median_filter(d, kernel, median, every),
        lambda d: filters.average_channels(d, average, "temperature"),
    ]
    if baseline:
        steps.append(lambda d: filters.adjust_by_baseline(d, "temperature", baseline))
    return pipeline(raw, steps)


def prepare_panel(df: DataFrame, intervals: DataFrame, buffer: int = 0) -> DataFrame:
    """The processed panel with known windows blanked and filled again, as targets with roles."""
    again = settled(imputation.reimpute_known(df, intervals, buffer), "panel")
    roles = filters.classify_channels(again)
    return again.join(small(roles.select("panel_id", "channel", "role")), ["panel_id", "channel"])
