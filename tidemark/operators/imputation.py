"""Imputation methods by name; every one returns the panel with observed (1: real, 0: filled).

Fills that feed later fills are sequential by definition. Their reach is bounded, so a stretch of
observed rows as long as the reach on both sides makes what lies left and right independent: there
a series is cut into islands, and each island is one group. No task holds a long series.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S
from . import filters, matching, splines, windows
from .panel import K, bounded, carried, row_numbers, settled, small

METHODS: dict[str, Callable[..., DataFrame]] = {}


def method(name: str) -> Callable:
    """Registers a method: DataFrame -> DataFrame with value filled."""

    def keep(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        METHODS[name] = f
        return f

    return keep


def impute(df: DataFrame, name: str = "linear_interpolation", **params) -> DataFrame:
    """``df`` with value filled by the named method and observed; an unknown name is an error."""
    if name not in METHODS:
        raise ValueError(f"unknown method {name}; known: {', '.join(sorted(METHODS))}")
    marked = df.select(*K, "ts", "value").withColumn("observed", F.col("value").isNotNull().cast("int"))
    return METHODS[name](marked, **params).select(*K, "ts", "value", "observed")


def _with_mean(df: DataFrame) -> DataFrame:
    return df.join(df.groupBy(*K).agg(F.avg("value").alias("__mean")), K)


@method("mean")
def mean(df: DataFrame, every: int = 3600) -> DataFrame:
    """Gaps of one: the neighbours' mean; the rest: the mean of the series after that."""
    near = single_gaps(df, every)
    return _with_mean(near).withColumn("value", F.coalesce("value", "__mean")).drop("__mean")


def single_gaps(df: DataFrame, every: int = 3600) -> DataFrame:
    """Fills gaps of one row whose neighbours are both there."""
    out = bounded(df, {"__a": lambda w: F.lag("value").over(w), "__b": lambda w: F.lead("value").over(w)}, every, every)
    return out.withColumn("value", F.coalesce("value", (F.col("__a") + F.col("__b")) / 2)).drop("__a", "__b")


@method("forward_fill")
def forward_fill(df: DataFrame) -> DataFrame:
    return carried(df).withColumn("value", F.coalesce("prev_value", "next_value"))


@method("backward_fill")
def backward_fill(df: DataFrame) -> DataFrame:
    return carried(df).withColumn("value", F.coalesce("next_value", "prev_value"))


@method("linear_interpolation")
def linear_interpolation(df: DataFrame) -> DataFrame:
    """Linear in row position, which on the regular grid is time; the ends constant."""
    return windows.interpolate_time(df)


@method("iterative")
def iterative(df: DataFrame, max_iter: int = 10) -> DataFrame:
    """For a single column the initial fill: the mean. ``max_iter`` has no effect."""
    return _with_mean(df).withColumn("value", F.coalesce("value", "__mean")).drop("__mean")


@method("knn_sklearn")
def knn_sklearn(df: DataFrame, n_neighbors: int = 5) -> DataFrame:
    """For a single column a missing row has no distance: the mean. ``n_neighbors`` has no effect."""
    return iterative(df)


def islands(df: DataFrame, reach: int, every: int = 3600) -> DataFrame:
    """``df`` with island: series cut where ``reach`` rows to the left and to the right are all observed."""
    whole = lambda w: (F.count("value").over(w.rowsBetween(-reach, reach - 1)) == 2 * reach) & (F.count("value").over(w.rowsBetween(-reach - 1, reach - 2)) < 2 * reach)
    marked = bounded(df, {"__cut": whole}, (reach + 1) * every, reach * every)
    cuts = marked.withColumn("__at", F.when(F.col("__cut"), S.micros(F.col("ts")))).withColumn("__value", F.col("value"))
    placed = carried(cuts.withColumn("value", F.col("__at").cast("double")))
    return placed.withColumns({"island": F.coalesce("prev_value", F.lit(0.0)).cast("long"), "value": F.col("__value")}).drop("__cut", "__at", "__value", "prev_ts", "prev_value", "next_ts", "next_value")


def _by_island(df: DataFrame, reach: int, fill: Callable[[np.ndarray], np.ndarray], every: int) -> DataFrame:
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("ts", kind="stable")
        v = rows["value"].to_numpy(dtype=float)
        return rows.assign(value=fill(v) if np.isnan(v).any() else v)[[*K, "ts", "value", "observed"]]

    cut = islands(df, reach, every)
    filled = cut.groupBy(*K, "island").applyInPandas(run, "panel_id string, channel string, ts timestamp, value double, observed int")
    return filled.withColumn("value", F.nanvl("value", F.lit(None).cast("double")))


@method("knn_temporal")
def knn_temporal(df: DataFrame, n_neighbors: int = 5, every: int = 3600) -> DataFrame:
    """The nearest ``n_neighbors`` rows, weighted by 1 / (distance + 1); earlier fills count, ties go left."""

    def fill(v: np.ndarray) -> np.ndarray:
        v = v.copy()
        for i in np.flatnonzero(np.isnan(v)):
            there = np.flatnonzero(~np.isnan(v))
            if not len(there):
                break
            near = there[np.lexsort((there, np.abs(there - i)))[:n_neighbors]]
            weight = 1.0 / (np.abs(near - i) + 1)
            v[i] = (v[near] * weight).sum() / weight.sum()
        return v

    return _by_island(df, n_neighbors, fill, every)


@method("rolling_mean")
def rolling_mean(df: DataFrame, window: int = 10, every: int = 3600) -> DataFrame:
    """The mean of what is within ``window`` rows, earlier fills included; else the series' own mean."""

    def fill(v: np.ndarray) -> np.ndarray:
        v = v.copy()
        for i in np.flatnonzero(np.isnan(v)):
            around = v[max(0, i - window) : i + window + 1]
            if (there := ~np.isnan(around)).any():
                v[i] = around[there].mean()
        return v

    means = df.groupBy(*K).agg(F.avg("value").alias("__mean"))
    return _by_island(df, window, fill, every).join(means, K).withColumn("value", F.coalesce("value", "__mean")).drop("__mean")


@method("seasonal")
def seasonal(df: DataFrame, period: int = 288, every: int = 3600) -> DataFrame:
    """The mean of the values one ``period`` away; else of the neighbours; else the series' own mean."""

    def fill(v: np.ndarray) -> np.ndarray:
        v = v.copy()
        n = len(v)
        for i in np.flatnonzero(np.isnan(v)):
            for step in (period, 1):
                there = [v[j] for j in (i - step, i + step) if 0 <= j < n and not np.isnan(v[j])]
                if there:
                    v[i] = sum(there) / len(there)
                    break
        return v

    means = df.groupBy(*K).agg(F.avg("value").alias("__mean"))
    return _by_island(df, period, fill, every).join(means, K).withColumn("value", F.coalesce("value", "__mean")).drop("__mean")


def _by_series(df: DataFrame, fill: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("ts", kind="stable")
        return rows.assign(value=fill(rows["value"].to_numpy(dtype=float)))[[*K, "ts", "value", "observed"]]

    filled = df.groupBy(*K).applyInPandas(run, "panel_id string, channel string, ts timestamp, value double, observed int")
    return filled.withColumn("value", F.nanvl("value", F.lit(None).cast("double")))


#: Rows of a series up to which one task fills it where a search covers all of it.
IN_TASK = 200_000


def _by_size(df: DataFrame, in_task: int, short: Callable[[DataFrame], DataFrame], long: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Series of up to ``in_task`` rows by ``short``, the others by ``long``; the results are the same."""
    df = settled(df, "filling")
    sizes = df.groupBy(*K).agg(F.count("*").alias("__n"))
    large = settled(sizes.where(F.col("__n") > in_task).select(*K), "large")
    if large.isEmpty():
        return short(df)
    return short(df.join(small(large), K, "left_anti")).unionByName(long(df.join(small(large), K, "left_semi")))


@method("spline_interpolation")
def spline_interpolation(df: DataFrame, order: int = 3, in_task: int = IN_TASK, width: int = splines.ROWS) -> DataFrame:
    """A natural cubic spline through a series' observations; linear where there are fewer than four
    or for order 1; constant outside them. A series of up to ``in_task`` rows is one group; a longer one is
    solved in buckets of ``width`` rows (see ``splines``)."""

    def fill(v: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(~np.isnan(v))
        gone = np.flatnonzero(np.isnan(v))
        if not len(at) or not len(gone):
            return v
        out = v.copy()
        if len(at) < 4 or order < 2:
            out[gone] = np.interp(gone, at, v[at])
            return out
        h, y = np.diff(at).astype(float), v[at]
        # second derivatives from the tridiagonal system, by elimination
        right = 6 * np.diff(np.diff(y) / h)
        main, upper = 2 * (h[:-1] + h[1:]), h[1:-1]
        c, d = np.empty(len(upper)), np.empty(len(main))
        beta = main[0]
        d[0] = right[0] / beta
        for i in range(1, len(main)):
            c[i - 1] = upper[i - 1] / beta
            beta = main[i] - upper[i - 1] * c[i - 1]
            d[i] = (right[i] - upper[i - 1] * d[i - 1]) / beta
        for i in range(len(main) - 2, -1, -1):
            d[i] -= c[i] * d[i + 1]
        m = np.concatenate(([0.0], d, [0.0]))
        k = np.clip(np.searchsorted(at, gone) - 1, 0, len(h) - 1)
        a, b = at[k + 1] - gone, gone - at[k]
        curve = (m[k] * a**3 + m[k + 1] * b**3) / (6 * h[k]) + (y[k] / h[k] - m[k] * h[k] / 6) * a + (y[k + 1] / h[k] - m[k + 1] * h[k] / 6) * b
        out[gone] = np.where(gone < at[0], y[0], np.where(gone > at[-1], y[-1], curve))
        return out

    columns = [*K, "ts", "value", "observed"]
    return _by_size(df, in_task, lambda d: _by_series(d, fill).select(*columns), lambda d: splines.spline(d, order, width).select(*columns))


@method("psm")
def psm(df: DataFrame, every: int = 3600, in_task: int = IN_TASK, width: int = matching.ROWS) -> DataFrame:
    """Partial subsequence matching after gaps of one: for each gap, shortest first, the values after
    the window most like its left context and those before the one most like its right context,
    averaged. Each search covers the whole series: one of up to ``in_task`` rows is one group, a longer
    one is searched in buckets of ``width`` rows (see ``matching``)."""

    def nearest(v: np.ndarray, query: np.ndarray, n: int, offset: int) -> np.ndarray | None:
        """The ``n`` values ``offset`` from the start of the closest whole window whose values are all there."""
        if np.isnan(query).any() or len(v) < n:
            return None
        every_window = np.lib.stride_tricks.sliding_window_view(v, n)
        distance = np.sqrt(((every_window - query) ** 2).sum(axis=1))
        start = np.arange(len(every_window))
        to = start + offset
        fits = ~np.isnan(distance) & (to >= 0) & (to + n <= len(v))
        whole = np.zeros(len(start), dtype=bool)
        whole[fits] = ~np.isnan(every_window[to[fits]]).any(axis=1)
        if not whole.any():
            return None
        best = start[whole][np.argmin(distance[whole])]
        return v[best + offset : best + offset + n]

    def fill(v: np.ndarray) -> np.ndarray:
        v = v.copy()
        gone = np.isnan(v)
        edges = np.flatnonzero(np.diff(np.concatenate(([0], gone.view(np.int8), [0]))))
        for n, a in sorted((b - a, a) for a, b in zip(edges[::2], edges[1::2], strict=True)):
            left = nearest(v, v[a - n : a], n, n) if a >= n else None
            right = nearest(v, v[a + n : a + 2 * n], n, -n) if a + 2 * n <= len(v) else None
            sides = [s for s in (left, right) if s is not None]
            if sides:
                v[a : a + n] = sum(sides) / len(sides)
        return v

    columns = [*K, "ts", "value", "observed"]
    return _by_size(single_gaps(df, every), in_task, lambda d: _by_series(d, fill).select(*columns), lambda d: matching.match_rounds(d, width).select(*columns))


def impute_frame(df: DataFrame, name: str = "linear_interpolation", channels: list[str] | None = None, **params) -> DataFrame:
    """Fills the chosen channels; the others keep their values, with observed."""
    if not channels:
        return impute(df, name, **params)
    rest = df.where(~F.col("channel").isin(*channels)).select(*K, "ts", "value").withColumn("observed", F.col("value").isNotNull().cast("int"))
    return impute(df.where(F.col("channel").isin(*channels)), name, **params).unionByName(rest)


def impute_channels(df: DataFrame, config: dict[str, dict] | None = None, default: str = "linear_interpolation") -> DataFrame:
    """Each channel by its own method: ``config`` maps a channel to {"method": name, **params}; weights are left out."""
    df = df.where(~F.col("channel").endswith("__weight"))
    config = config or {}
    out = impute(df.where(~F.col("channel").isin(*config)) if config else df, default)
    for channel, how in config.items():
        params = {k: v for k, v in how.items() if k != "method"}
        out = out.unionByName(impute(df.where(F.col("channel") == channel), how.get("method", default), **params))
    return out


def reimpute_known(df: DataFrame, intervals: DataFrame, buffer: int = 0, name: str = "linear_interpolation") -> DataFrame:
    """Blanks known intervals and fills them again; observed stays 1 only where it was and nothing was blanked."""
    blank = filters.mask_intervals(df, intervals, buffer)
    old = df.select(*K, "ts", F.coalesce("observed", F.lit(0)).alias("__old"))
    again = impute(blank, "linear_interpolation" if name == "psm" else name)
    return again.join(old, [*K, "ts"]).withColumn("observed", F.least("observed", "__old")).drop("__old")


def inject_gaps(df: DataFrame, size: int = 5, n: int = 10, seed: int = 42) -> DataFrame:
    """``df`` with original and injected: ``n`` runs of ``size`` observed rows at most, none touching another, blanked in each series.

    Rows are dealt into slots of size + 1 rows; of the slots that are whole, those with the smallest
    hashes are taken: the same for any partitioning.
    """
    placed = row_numbers(df.select(*K, "ts", "value"), K)
    slot = F.floor((F.col("rn") - 1) / (size + 1)).alias("slot")
    placed = placed.withColumn("slot", slot).withColumn("inside", (F.col("rn") - 1) % (size + 1) < size)
    from pyspark.sql import Window

    slots = placed.where("inside").groupBy(*K, "slot").agg(F.count("value").alias("c")).where(F.col("c") == size)
    order = F.row_number().over(Window.partitionBy(*K).orderBy(F.xxhash64(*K, "slot", F.lit(seed)), "slot"))
    chosen = slots.withColumn("__r", order).where(F.col("__r") <= n).select(*K, "slot", F.lit(True).alias("__hit"))
    out = placed.join(chosen, [*K, "slot"], "left").withColumn("injected", F.coalesce(F.col("__hit") & F.col("inside"), F.lit(False)))
    return out.select(*K, "ts", F.when(~F.col("injected"), F.col("value")).alias("value"), F.col("value").alias("original"), "injected")


def benchmark_imputation(df: DataFrame, names: list[str], size: int = 5, n: int = 10, seed: int = 42) -> DataFrame:
    """(method, panel_id, channel, mae, rmse, mape, n): every method over one frame with injected
    gaps; series with over 30 % missing are left out."""
    from .aggregates import imputation_metrics

    good = df.groupBy(*K).agg(F.avg(F.col("value").isNull().cast("int")).alias("gone")).where("gone <= 0.3").select(*K)
    holes = inject_gaps(df.join(good, K, "left_semi"), size, n, seed)
    truth = holes.where("injected").select(*K, "ts", "original", "injected")
    out = None
    for name in names:
        one = impute(holes, name).join(truth, [*K, "ts"]).withColumn("method", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return imputation_metrics(out)
