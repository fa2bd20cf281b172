"""Resampling and operators along series."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from .panel import BUCKET, K, bounded, carried, row_numbers, settled, small


def grid(df: DataFrame, every: int) -> DataFrame:
    """(panel_id, channel, ts): a regular grid of ``every`` seconds from a panel's first to its last ts, for each channel."""
    spans = df.groupBy("panel_id").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    steps = spans.select("panel_id", F.explode(F.sequence(S.micros(F.col("a")), S.micros(F.col("b")), F.lit(every * S.MICROS))).alias("t")).select("panel_id", S.from_micros(F.col("t")).alias("ts"))
    return steps.join(small(df.select("panel_id", "channel").distinct()), "panel_id").select("panel_id", "channel", "ts")


def resample_mean(df: DataFrame, every: int = 3600) -> DataFrame:
    """Means of bins closed and labelled on the right; empty bins are missing."""
    means = df.withColumn("ts", S.ceil_to(F.col("ts"), every)).groupBy(*K, "ts").agg(F.avg("value").alias("value"))
    return grid(means, every).join(means, [*K, "ts"], "left")


def resample_ffill(df: DataFrame, every: int) -> DataFrame:
    """A finer grid, filled with the last value."""
    return carried(grid(df, every).join(df.select(*K, "ts", "value"), [*K, "ts"], "left")).select(*K, "ts", F.col("prev_value").alias("value"))


def difference(df: DataFrame, order: int = 1, every: int = 3600, bucket: int | None = BUCKET) -> DataFrame:
    """The n-th difference; the rows that have none are dropped."""
    names = [F.lit(1.0)]
    sign = 1.0
    for k in range(1, order + 1):  # binomial coefficients with changing signs
        sign *= -(order - k + 1) / k
        names.append(F.lit(sign))

    def delta(w):
        return sum((names[k] * F.lag("value", k).over(w) for k in range(1, order + 1)), F.col("value"))

    return bounded(df, {"delta": delta, "place": lambda w: F.lag("ts", order).over(w)}, order * every, 0, bucket).where("place is not null").drop("place")


def integrate(df: DataFrame, every: int = 3600, bucket: int | None = BUCKET) -> DataFrame:
    """pred, a predicted first difference, plus the value before."""
    return bounded(df, {"before": lambda w: F.lag("value").over(w)}, every, 0, bucket).withColumn("pred", F.col("pred") + F.col("before")).drop("before")


def lag_features(df: DataFrame, lags: int | list[int], every: int = 3600, bucket: int | None = BUCKET) -> DataFrame:
    """``df`` with lags, an array of earlier values; rows that lack one are dropped."""
    steps = list(range(1, lags + 1)) if isinstance(lags, int) else sorted(lags)
    out = bounded(df, {f"__l{k}": (lambda w, k=k: F.lag("value", k).over(w)) for k in steps}, max(steps) * every, 0, bucket)
    return out.dropna(subset=[f"__l{k}" for k in steps]).withColumn("lags", F.array(*[F.col(f"__l{k}") for k in steps])).drop(*[f"__l{k}" for k in steps])


def strict_mask(df: DataFrame, n: int, every: int = 3600, bucket: int | None = BUCKET) -> DataFrame:
    """``df`` with usable: this row and the ``n`` before are all observed."""
    out = bounded(df, {"__m": lambda w: F.min("observed").over(w.rowsBetween(-n, 0)), "__c": lambda w: F.count("*").over(w.rowsBetween(-n, 0))}, n * every, 0, bucket)
    return out.withColumn("usable", (F.col("__m") >= 0.5) & (F.col("__c") == n + 1)).drop("__m", "__c")


def rolling_baseline(df: DataFrame, days: int = 14, bucket: int = BUCKET) -> DataFrame:
    """``df`` with baseline: the mean of (ts - days, ts]; where there is none, that of the series."""
    reach = days * 86_400
    near = bounded(df.withColumn("__us", S.micros(F.col("ts"))), {"baseline": lambda w: F.avg("value").over(Window.partitionBy(*K, "bucket").orderBy("__us").rangeBetween(-reach * S.MICROS + 1, 0))}, reach, 0, bucket).drop("__us")
    whole = df.groupBy(*K).agg(F.avg("value").alias("__mean"))
    return near.join(whole, K).withColumn("baseline", F.coalesce("baseline", "__mean")).drop("__mean")


def ffill(df: DataFrame) -> DataFrame:
    return carried(df).withColumn("value", F.col("prev_value")).drop("prev_ts", "prev_value", "next_ts", "next_value")


def bfill(df: DataFrame) -> DataFrame:
    return carried(df).withColumn("value", F.col("next_value")).drop("prev_ts", "prev_value", "next_ts", "next_value")


def interpolate_with(df: DataFrame, fill: Callable[[], Column]) -> DataFrame:
    """``df`` with value by ``fill``, an expression of value, prev_value, next_value, prev_ts and next_ts."""
    return carried(df).withColumn("value", fill()).drop("prev_ts", "prev_value", "next_ts", "next_value")


def interpolate_time(df: DataFrame) -> DataFrame:
    """Linear in time between observations; the ends constant."""
    t, a, b = (S.micros(F.col(c)) for c in ("ts", "prev_ts", "next_ts"))
    between = F.col("prev_value") + (F.col("next_value") - F.col("prev_value")) * (t - a) / F.nullif(b - a, F.lit(0))
    value = F.coalesce("value", between, "prev_value", "next_value")
    return carried(df).withColumn("value", value).drop("prev_ts", "prev_value", "next_ts", "next_value")


def missing_gaps(df: DataFrame, every: int = 3600) -> DataFrame:
    """(panel_id, channel, start_ts, end_ts, length): runs of missing values on a grid.

    All rows of a run have the same observation before and after them, so a run is a group."""
    runs = carried(df).where("value is null").groupBy(*K, "prev_ts", "next_ts").agg(F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.count("*").alias("length"))
    return runs.select(*K, "start_ts", "end_ts", "length")


def time_gaps(df: DataFrame, seconds: int = 3600) -> DataFrame:
    """(panel_id, start_ts, end_ts): neighbouring timestamps further apart than ``seconds``."""
    stamps = df.select("panel_id", "ts").distinct().withColumn("channel", F.lit("")).withColumn("value", F.lit(1.0))
    before = carried(stamps.withColumn("ts", S.from_micros(S.micros(F.col("ts")))))
    # the last timestamp strictly before: one look back inside buckets, carried across them
    w = Window.partitionBy("panel_id").orderBy("b")
    stamps = before.select("panel_id", "ts").withColumn("b", F.floor(S.micros(F.col("ts")) / F.lit(BUCKET * S.MICROS)))
    ends = stamps.groupBy("panel_id", "b").agg(F.max("ts").alias("m")).select("panel_id", "b", F.last("m", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("carry"))
    seen = stamps.join(ends, ["panel_id", "b"]).withColumn("start_ts", F.coalesce(F.lag("ts").over(Window.partitionBy("panel_id", "b").orderBy("ts")), "carry"))
    return seen.where(S.micros(F.col("ts")) - S.micros(F.col("start_ts")) > seconds * S.MICROS).select("panel_id", "start_ts", F.col("ts").alias("end_ts"))


def anomaly_regions(flags: DataFrame, gap: int = 3600, pad: int = 600) -> DataFrame:
    """(panel_id, region_id, start_ts, end_ts, points): flagged timestamps at most ``gap`` seconds
    apart merge; each region is widened by ``pad`` seconds within the panel's rows."""
    spans = small(flags.groupBy("panel_id").agg(F.min("ts").alias("__lo"), F.max("ts").alias("__hi")))
    w = Window.partitionBy("panel_id").orderBy("ts")
    hits = flags.where("anomaly_flag = 1").select("panel_id", "ts").distinct()
    new = F.coalesce(S.micros(F.col("ts")) - S.micros(F.lag("ts").over(w)) > gap * S.MICROS, F.lit(True)).cast("int")
    runs = hits.withColumn("new", new).withColumn("region_id", F.sum("new").over(w)).groupBy("panel_id", "region_id").agg(F.min("ts").alias("a"), F.max("ts").alias("b"), F.count("*").alias("points"))
    moved = lambda c, s: S.from_micros(S.micros(F.col(c)) + s * S.MICROS)
    return runs.join(spans, "panel_id").select("panel_id", "region_id", F.greatest(moved("a", -pad), "__lo").alias("start_ts"), F.least(moved("b", pad), "__hi").alias("end_ts"), "points")


def median_filter(df: DataFrame, kernel: int = 3, pattern: str = "flow", every: int = 3600, bucket: int | None = BUCKET) -> DataFrame:
    """The running median of an odd ``kernel`` on channels that contain ``pattern``; outside the series stand zeros."""
    if kernel % 2 == 0:
        raise ValueError("the kernel must be odd")
    half = kernel // 2
    around = lambda w: F.array(*[F.lag("value", k, 0.0).over(w) for k in range(half, 0, -1)], F.col("value"), *[F.lead("value", k, 0.0).over(w) for k in range(1, half + 1)])
    out = bounded(df.where(F.col("channel").contains(pattern)), {"__around": around}, half * every, half * every, bucket)
    missing = F.exists("__around", lambda v: v.isNull())
    out = out.withColumn("value", F.when(~missing, F.element_at(F.array_sort("__around"), half + 1))).drop("__around")
    return out.unionByName(df.where(~F.col("channel").contains(pattern)))


def dilate(df: DataFrame, k: int, flag: str = "flag", every: int = 3600, bucket: int | None = BUCKET) -> DataFrame:
    """The flag spread by ``k`` rows to either side."""
    return bounded(df, {"__f": lambda w: F.max(flag).over(w.rowsBetween(-k, k))}, k * every, k * every, bucket).withColumn(flag, F.col("__f")).drop("__f")


def observed_flag(df: DataFrame) -> DataFrame:
    """``df`` with observed 0 or 1, from an existing weight or from the value."""
    told = F.coalesce("observed", F.lit(0)) >= 0.5 if "observed" in df.columns else F.col("value").isNotNull()
    return df.withColumn("observed", told.cast("int"))


def subsequence_distance(df: DataFrame, query: list[float], every: int = 3600, bucket: int | None = BUCKET) -> DataFrame:
    """(panel_id, channel, ts, distance): Euclidean distance of the window that starts at ts to ``query``; whole windows only."""
    m = len(query)
    out = bounded(df, {"__w": lambda w: F.array(*[F.lead("value", k).over(w) if k else F.col("value") for k in range(m)])}, 0, m * every, bucket)
    out = out.where(~F.exists("__w", lambda v: v.isNull()))
    square = F.aggregate(F.zip_with("__w", F.array(*[F.lit(float(q)) for q in query]), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    return out.select(*K, "ts", F.sqrt(square).alias("distance"))


def chronological_split(df: DataFrame, train: int = 80, val: int = 10, test: int = 10) -> DataFrame:
    """``df`` with rn, n and split: by the row's place among the panel's timestamps, cut at int(n * p / 100)."""
    if train + val + test != 100 or min(train, val, test) < 0:
        raise ValueError("percentages must add up to 100")
    stamps = row_numbers(df.select("panel_id", "ts").distinct(), ["panel_id"])
    a, b = F.floor(F.col("n") * train / 100), F.floor(F.col("n") * train / 100) + F.floor(F.col("n") * val / 100)
    stamps = stamps.withColumn("split", F.when(F.col("rn") <= a, "train").when(F.col("rn") <= b, "val").otherwise("test"))
    return df.join(stamps, ["panel_id", "ts"])


def eval_window(df: DataFrame, hist: int, target=None) -> DataFrame:
    """Each panel's last ``hist`` timestamps, or the ``hist`` that end at the last one not after ``target``."""
    stamps = df.select("panel_id", "ts").distinct()
    if target is not None:
        stamps = stamps.where(S.micros(F.col("ts")) <= S.micros(F.lit(target).cast("timestamp")))
    stamps = row_numbers(stamps, ["panel_id"]).where(F.col("rn") > F.col("n") - hist).select("panel_id", "ts")
    return df.join(stamps, ["panel_id", "ts"], "left_semi")


def adjust_window(bounds: DataFrame, hist: int, least: int = 100, ratio: float = 0.6) -> DataFrame:
    """``bounds`` (panel_id, n, start, end) with window_start, window_end and problem.

    Too few rows for two windows: the window is the last part, at least ``least`` rows, and a series
    under twice that is too short. Too few rows before the window: it keeps its start and shrinks
    to the rows there are; under ``least`` there is not enough data before it.
    """
    n, start = F.col("n"), F.col("start")
    few = n < 2 * hist + 1
    part = F.greatest(F.lit(least), n - F.greatest(F.lit(least), F.floor(n * ratio)))
    problem = F.when(few & (n < 2 * least), "too short").when(~few & (start < hist) & (start < least), "not enough data before test window")
    first = F.when(few, F.greatest(F.lit(least), n - part)).otherwise(start)
    last = F.when(few, n).when(start < hist, F.least(n, start + F.least(F.lit(hist), n - start))).otherwise(F.col("end"))
    return bounds.withColumns({"window_start": F.when(problem.isNull(), first), "window_end": F.when(problem.isNull(), last), "problem": problem})


def _placed(stamps: DataFrame, models: DataFrame, scope: str, train: int, val: int) -> DataFrame:
    """(panel_id, ts, rn, n, unseen) of timestamps (panel_id, ts)."""
    placed = row_numbers(stamps, ["panel_id"])
    if scope == "all":
        return placed.withColumn("unseen", F.lit(True))
    placed = placed.join(small(models.select("panel_id", "test_start", "train_end", "train_size")), "panel_id", "left")
    cut = F.floor(F.col("n") * train / 100) + F.floor(F.col("n") * val / 100)
    unseen = F.coalesce(F.col("ts") >= F.col("test_start"), F.col("ts") > F.col("train_end"), F.col("rn") > F.col("train_size"), F.col("rn") > cut)
    return placed.select("panel_id", "ts", "rn", "n", unseen.alias("unseen"))


def unseen_split(df: DataFrame, models: DataFrame, scope: str = "unseen", train: int = 80, val: int = 10) -> DataFrame:
    """``df`` with unseen: by the model's test_start (>=), else train_end (>), else train_size (rows), else percentages.

    ``models``: (panel_id, test_start, train_end, train_size), nulls where unknown. Scope ``all``: every row is unseen.
    """
    if scope == "all":
        return df.withColumn("unseen", F.lit(True))
    stamps = _placed(df.select("panel_id", "ts").distinct(), models, scope, train, val)
    return df.join(stamps.select("panel_id", "ts", "unseen"), ["panel_id", "ts"])


class TooFewRows(ValueError):
    """Panels whose unseen rows do not make an evaluation window; ``panels`` maps each to its problem."""

    def __init__(self, panels: dict[str, str]):
        super().__init__("; ".join(f"panel {p}: {problem}" for p, problem in sorted(panels.items())))
        self.panels = panels


def _window_ends(placed: DataFrame, hist: int, target, least: int | None, ratio: float) -> DataFrame:
    """(panel_id, first, n, window_start, window_end, problem) of the unseen timestamps ``placed``."""
    upto = F.lit(True) if target is None else S.micros(F.col("ts")) <= S.micros(F.lit(target).cast("timestamp"))
    # unseen timestamps are the last ones of a panel: their places follow each other
    ends = placed.groupBy("panel_id").agg(F.min("rn").alias("first"), F.count("*").alias("n"), F.count_if(upto).alias("end"))
    ends = ends.withColumn("start", F.greatest(F.lit(0), F.col("end") - hist))
    if least is None:
        problem = F.when(F.col("end") == 0, "no rows in the window").when(F.col("start") == 0, "no rows before the window")
        return ends.withColumns({"window_start": F.col("start"), "window_end": F.col("end"), "problem": problem})
    return adjust_window(ends, hist, least, ratio)


def window_problems(df: DataFrame, models: DataFrame, hist: int, scope: str = "unseen", target=None, least: int | None = None, ratio: float = 0.6, train: int = 80, val: int = 10) -> DataFrame:
    """(panel_id, n, problem) of the panels that ``scoring_windows`` gives no whole window, those without an unseen row too."""
    stamps = settled(df.select("panel_id", "ts").distinct(), "stamps")
    ends = _window_ends(_placed(stamps, models, scope, train, val).where("unseen"), hist, target, least, ratio)
    told = stamps.select("panel_id").distinct().join(small(ends.select("panel_id", "n", "problem")), "panel_id", "left")
    told = told.select("panel_id", F.coalesce("n", F.lit(0)).alias("n"), F.when(F.col("n").isNull(), "no unseen rows").otherwise(F.col("problem")).alias("problem"))
    return told.where("problem is not null")


def scoring_windows(df: DataFrame, models: DataFrame, hist: int, scope: str = "unseen", target=None, least: int | None = None, ratio: float = 0.6, train: int = 80, val: int = 10) -> DataFrame:
    """(panel_id, ts, fit, evaluated) of each unseen timestamp up to the end of the evaluation window.

    The window: the last ``hist`` unseen timestamps of a panel, or those that end at the last one not
    after ``target``; what is unseen before it fits the scorer. ``least``: the window gives way where
    there are too few rows (see ``adjust_window``); a panel for which that fails has no rows
    here and its problem in ``window_problems``.
    """
    stamps = settled(df.select("panel_id", "ts").distinct(), "stamps")
    placed = settled(_placed(stamps, models, scope, train, val).where("unseen"), "placed")
    ends = _window_ends(placed, hist, target, least, ratio)
    at = F.col("rn") - F.col("first")
    out = placed.join(small(ends.select("panel_id", "first", "window_start", "window_end")), "panel_id").where(at < F.col("window_end"))
    return out.select("panel_id", "ts", (at < F.col("window_start")).alias("fit"), (at >= F.col("window_start")).alias("evaluated"))


def residual_windows(df: DataFrame, w: int, every: int = 3600) -> DataFrame:
    """(panel_id, ts, channels, vector): the residuals of all channels over ``w`` consecutive rows; whole windows only."""
    lagged = lag_features(df.withColumn("value", F.col("residual")), w - 1, every).withColumn("v", F.concat(F.array("value"), "lags")) if w > 1 else df.dropna(subset=["residual"]).withColumn("v", F.array("residual"))
    rows = lagged.groupBy("panel_id", "ts").agg(F.sort_array(F.collect_list(F.struct("channel", "v"))).alias("a"))
    return rows.select("panel_id", "ts", F.size("a").alias("channels"), F.flatten(F.col("a.v")).alias("vector"))


def recent_points(df: DataFrame, n: int = 12) -> DataFrame:
    """The last ``n`` rows of each panel."""
    w = Window.partitionBy("panel_id").orderBy(F.desc("ts"))
    return df.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n).drop("__r")
