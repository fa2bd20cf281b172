"""Aggregations: accuracy, summaries, attribution, readiness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from .filters import in_interval
from .panel import K, exact_quantiles, settled, small


def eval_metrics(df: DataFrame) -> DataFrame:
    """(panel_id, channel, rmse, mae, n) over observed rows that have a prediction."""
    e = F.when(F.col("observed") >= 0.5, F.col("value") - F.col("pred"))
    return df.groupBy(*K).agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.count(e).alias("n"))


def forecast_metrics(df: DataFrame) -> DataFrame:
    """(panel_id, channel, mae, rmse, mape, n); the percentage's denominator is the actual plus 1e-10."""
    e = F.col("value") - F.col("pred")
    return df.where("value is not null and pred is not null").groupBy(*K).agg(F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), (F.avg(F.abs(e / (F.col("value") + 1e-10))) * 100).alias("mape"), F.count("*").alias("n"))


def channel_errors(df: DataFrame) -> DataFrame:
    """(panel_id, channel, span, mae, rmse, n, n_nan) over finite pairs: all rows and the test rows (split)."""
    good = S.is_finite(F.col("value")) & S.is_finite(F.col("pred"))
    e = F.when(good, F.col("value") - F.col("pred"))

    def errors(rows: DataFrame, span: str) -> DataFrame:
        return rows.groupBy(*K).agg(F.lit(span).alias("span"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.count(e).alias("n"), F.count_if(~good).alias("n_nan"))

    return errors(df, "full").unionByName(errors(df.where("split = 'test'"), "test"))


def imputation_metrics(df: DataFrame) -> DataFrame:
    """(method, mae, rmse, mape, n) at injected gaps: original against value; percentages where |original| > 1e-10."""
    e = F.col("value") - F.col("original")
    share = F.when(F.abs("original") > 1e-10, F.abs(e / F.col("original")) * 100)
    return df.where("injected").groupBy("method", *K).agg(F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(share).alias("mape"), F.count(e).alias("n"))


def summarize_methods(metrics: DataFrame) -> DataFrame:
    """(method, metric means and sample deviations, runs), the best by mean MAE marked."""
    out = metrics.groupBy("method").agg(*[f(c).alias(f"{c}_{n}") for c in ("mae", "rmse", "mape") for f, n in ((F.avg, "mean"), (F.stddev_samp, "std"))], F.count("*").alias("runs"))
    best = out.agg(F.min_by("method", F.struct("mae_mean", "method")).alias("__best"))
    return out.crossJoin(F.broadcast(best)).withColumn("best", F.col("method") == F.col("__best")).drop("__best")


def score_summary(df: DataFrame) -> DataFrame:
    """For each panel: rows, flags, rate and the distribution of raw and normalised scores; exact quantiles."""
    df = settled(df.select("panel_id", "anomaly_score", "anomaly_score_normalized", "anomaly_flag"), "scores")
    out = [F.count("*").alias("n"), F.sum("anomaly_flag").alias("flags")]
    columns = (("anomaly_score", "score"), ("anomaly_score_normalized", "normalized"))
    for c, name in columns:
        out += [F.min(c).alias(f"{name}_min"), F.max(c).alias(f"{name}_max"), F.avg(c).alias(f"{name}_mean"), F.stddev_samp(c).alias(f"{name}_std")]
    rows = df.groupBy("panel_id").agg(*out).withColumn("rate", F.try_divide("flags", "n"))
    for c, name in columns:
        points = {f"{name}_{p}": q for p, q in (("p25", 0.25), ("median", 0.5), ("p75", 0.75), ("p95", 0.95), ("p99", 0.99))}
        rows = rows.join(small(exact_quantiles(df, ["panel_id"], c, points)), "panel_id", "left")
    return rows


def feature_errors(df: DataFrame) -> DataFrame:
    """(panel_id, channel, mean_abs_residual, rmse, place), the worst first."""
    r = F.col("value") - F.col("pred")
    out = df.groupBy(*K).agg(F.avg(F.abs(r)).alias("mean_abs_residual"), F.sqrt(F.avg(r * r)).alias("rmse"))
    return out.withColumn("place", F.row_number().over(Window.partitionBy("panel_id").orderBy(F.desc("mean_abs_residual"), "channel")))


def residual_score_corr(df: DataFrame) -> DataFrame:
    """(panel_id, channel, corr) of absolute residual and score."""
    return df.groupBy(*K).agg(F.corr(F.abs(F.col("value") - F.col("pred")), "anomaly_score").alias("corr"))


def high_score_contrast(df: DataFrame, q: float = 0.95) -> DataFrame:
    """(panel_id, channel, high, normal, contrast): mean absolute residual above the panel's score quantile and below."""
    df = settled(df.select(*K, "ts", "value", "pred", "anomaly_score"), "scored")
    cut = small(exact_quantiles(df.select("panel_id", "ts", "anomaly_score").distinct(), ["panel_id"], "anomaly_score", {"__cut": q}))
    r, high = F.abs(F.col("value") - F.col("pred")), F.col("anomaly_score") > F.col("__cut")
    out = df.join(cut, "panel_id").groupBy(*K).agg(F.avg(F.when(high, r)).alias("high"), F.avg(F.when(~high, r)).alias("normal"))
    return out.withColumn("contrast", F.col("high") - F.col("normal"))


def score_attribution(df: DataFrame) -> DataFrame:
    """(panel_id, channel, attribution): the mean of the channel's share of squared residual times the score."""
    r2 = (F.col("value") - F.col("pred")) ** 2
    total = df.groupBy("panel_id", "ts").agg(F.sum(r2).alias("__t"))
    return df.join(total, ["panel_id", "ts"]).groupBy(*K).agg(F.avg(F.try_divide(r2, F.col("__t")) * F.col("anomaly_score")).alias("attribution"))


def group_flag_summary(df: DataFrame) -> DataFrame:
    """(panel_id, group, rows, flags, rate, threshold) of long group scores."""
    return df.groupBy("panel_id", "group").agg(F.count("*").alias("rows"), F.sum("flag").alias("flags"), F.avg("flag").alias("rate"), F.max("threshold").alias("threshold"))


def known_window_eval(flags: DataFrame, intervals: DataFrame) -> DataFrame:
    """(panel_id, flags_in, flags_out, known_points, precision): flags inside and outside known windows."""
    hit = F.col("anomaly_flag") == 1
    return in_interval(flags, intervals).groupBy("panel_id").agg(F.count_if(hit & F.col("in_known")).alias("flags_in"), F.count_if(hit & ~F.col("in_known")).alias("flags_out"), F.count_if("in_known").alias("known_points")).withColumn("precision", F.try_divide(F.col("flags_in"), F.col("flags_in") + F.col("flags_out")))


def outlier_summary(before: DataFrame, bounds: DataFrame) -> DataFrame:
    """(panel_id, channel, total, removed, pct, lower, upper, min_removed, max_removed)."""
    out = F.coalesce(F.col("value") < F.col("lower"), F.lit(False)) | F.coalesce(F.col("value") > F.col("upper"), F.lit(False))
    gone = F.when(out, F.col("value"))
    rows = before.join(small(bounds), K).groupBy(*K, "lower", "upper").agg(F.count("value").alias("total"), F.count(gone).alias("removed"), F.min(gone).alias("min_removed"), F.max(gone).alias("max_removed"))
    return rows.withColumn("pct", F.try_divide(F.col("removed"), F.col("total")) * 100)


def leaderboard(scores: DataFrame, models: list[str] | None = None) -> DataFrame:
    """One row a channel, one column a model, with the best model and its score; the smaller is better."""
    board = scores.groupBy("channel").pivot("model", models).agg(F.first("score"))
    best = scores.groupBy("channel").agg(F.min_by("model", F.struct("score", "model")).alias("winner"), F.min("score").alias("winner_score"))
    return board.join(best, "channel")


def leaderboard_z(scores: DataFrame) -> DataFrame:
    """(channel, model, z): standardised over the channel's models; null where they do not differ."""
    w = Window.partitionBy("channel")
    return scores.select("channel", "model", ((F.col("score") - F.avg("score").over(w)) / F.nullif(F.stddev_samp("score").over(w), F.lit(0.0))).alias("z"))


def winner_share(board: DataFrame) -> DataFrame:
    """(winner, n, share)."""
    counts = board.groupBy("winner").agg(F.count("*").alias("n"))
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("__all")))).select("winner", "n", F.try_divide("n", "__all").alias("share"))


def hourly_profile(df: DataFrame) -> DataFrame:
    """(channel, hour, mean)."""
    return df.groupBy("channel", F.hour("ts").alias("hour")).agg(F.avg("value").alias("mean"))


def median_mad(df: DataFrame) -> DataFrame:
    """(panel_id, channel, median, mad): the median and the median distance from it, 1e-12 if that is 0."""
    rows = settled(df.select(*K, "value"), "values")
    mid = settled(exact_quantiles(rows, K, "value", {"median": 0.5}), "medians")
    spread = rows.join(small(mid), K).select(*K, F.abs(F.col("value") - F.col("median")).alias("e"))
    mad = exact_quantiles(spread, K, "e", {"mad": 0.5})
    every = rows.select(*K).distinct().join(small(mid), K, "left").join(small(mad), K, "left")
    return every.select(*K, "median", S.guard_zero(F.col("mad"), 1e-12).alias("mad"))


def freshness(df: DataFrame, now: Column, every: int = 3600, stale: int = 3600, tail: int = 12) -> DataFrame:
    """(panel_id, latest_ts, last_valid_ts, age_seconds, trailing_missing, trailing_seconds, status).

    A row is missing if all its channels are; degraded: older than ``stale`` seconds, or ``tail`` missing rows at the end.
    """
    stamps = df.groupBy("panel_id", "ts").agg(F.count("value").alias("seen"))
    ends = stamps.groupBy("panel_id").agg(F.max("ts").alias("latest_ts"), F.max(F.when(F.col("seen") > 0, F.col("ts"))).alias("last_valid_ts"))
    rows = stamps.join(small(ends), "panel_id").groupBy("panel_id", "latest_ts", "last_valid_ts").agg(F.count_if(F.coalesce(F.col("ts") > F.col("last_valid_ts"), F.lit(True))).alias("trailing_missing"))
    age = (S.micros(now) - S.micros(F.coalesce("last_valid_ts", "latest_ts"))) / F.lit(S.MICROS)
    rows = rows.withColumns({"age_seconds": age, "trailing_seconds": F.col("trailing_missing") * every})
    return rows.withColumn("status", F.when((F.col("age_seconds") > stale) | (F.col("trailing_missing") >= tail), "degraded").otherwise("ok"))


def readiness(panels: DataFrame, df: DataFrame, models: DataFrame, now: Column, days: int) -> DataFrame:
    """One row: data_ready (every configured panel has rows newer than ``days``), models_ready (the
    oldest of their newest models is), ready."""
    limit = S.micros(now) - F.lit(days * 86_400 * S.MICROS)
    last = df.groupBy("panel_id").agg(F.max("ts").alias("last"))
    newest = models.groupBy("panel_id").agg(F.max(F.to_timestamp("version", "yyyyMMdd_HHmmss")).alias("model"))
    every = panels.select("panel_id").join(last, "panel_id", "left").join(newest, "panel_id", "left")
    fresh = lambda c: F.coalesce(F.bool_and(F.coalesce(S.micros(F.col(c)) > limit, F.lit(False))), F.lit(False))
    return every.agg(fresh("last").alias("data_ready"), fresh("model").alias("models_ready")).withColumn("ready", F.col("data_ready") & F.col("models_ready"))


def strategy_table(df: DataFrame) -> DataFrame:
    """(panel_id, strategy, rows, flags, rate, score mean and quantiles, mean normalised score), in that order."""
    out = df.groupBy("panel_id", "strategy").agg(F.count("*").alias("rows"), F.sum("anomaly_flag").alias("flags"), F.avg("anomaly_flag").alias("rate"), F.avg("anomaly_score").alias("score_mean"), F.percentile("anomaly_score", 0.95).alias("score_q95"), F.percentile("anomaly_score", 0.99).alias("score_q99"), F.avg("anomaly_score_normalized").alias("normalized_mean"))
    return out.orderBy("panel_id", "strategy")


def split_bounds(df: DataFrame) -> DataFrame:
    """(panel_id, n, train/val/test sizes and boundaries) of rows with split."""
    rows = df.select("panel_id", "ts", "split").distinct()
    of = lambda s: F.when(F.col("split") == s, F.col("ts"))
    return rows.groupBy("panel_id").agg(F.count("*").alias("n"), *[F.count(of(s)).alias(f"n_{s}") for s in ("train", "val", "test")], F.max(of("train")).alias("train_end"), F.max(of("val")).alias("val_end"), F.min(of("test")).alias("test_start"))


def r2(df: DataFrame) -> DataFrame:
    """(panel_id, channel, r2): 1 - SSE / SST over rows with both values."""
    rows = df.where("value is not null and pred is not null")
    sse, n = F.sum((F.col("value") - F.col("pred")) ** 2), F.count("*")
    return rows.groupBy(*K).agg((1 - sse / F.nullif(F.var_pop("value") * n, F.lit(0.0))).alias("r2"))


def region_contributions(contributions: DataFrame, regions: DataFrame) -> DataFrame:
    """(panel_id, region_id, channel, contribution): means inside regions."""
    from .joins import join_regions

    return join_regions(contributions, regions).groupBy("panel_id", "region_id", "channel").agg(F.avg("contribution").alias("contribution"))


def suspicious_channels(df: DataFrame) -> DataFrame:
    """(panel_id, channel, low, high, n): channels that look like an index: from 0 to over 0.9 n, n > 10."""
    return df.groupBy(*K).agg(F.min("value").alias("low"), F.max("value").alias("high"), F.count("value").alias("n")).where("low = 0 and high > 0.9 * n and n > 10")


def snapshot_metadata(df: DataFrame) -> DataFrame:
    """(panel_id, rows, start_ts, end_ts) of each panel's timestamps."""
    return df.groupBy("panel_id").agg(F.count_distinct("ts").alias("rows"), F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"))
