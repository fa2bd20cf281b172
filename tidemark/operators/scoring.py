"""Residual scores, thresholds, groups, contributions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from . import joins
from .panel import exact_quantiles, settled, small

#: Rows with group, value, pred, fit and evaluated -> (panel_id, group, ts, fit, evaluated, score).
Scorer = Callable[[DataFrame], DataFrame]


def score_norm(df: DataFrame, order: float = 4.0, extra: list[str] = ()) -> DataFrame:
    """(panel_id, group, ts, extra, score): the L^order norm of the channels' residuals; null if one is missing."""
    r = F.abs(F.col("value") - F.col("pred"))
    keys = ["panel_id", "group", "ts", *extra]
    out = df.groupBy(*keys).agg(F.sum(F.pow(r, F.lit(float(order)))).alias("s"), F.count(r).alias("k"), F.count("*").alias("n"))
    return out.select(*keys, F.when(F.col("k") == F.col("n"), F.pow("s", F.lit(1.0 / order))).alias("score"))


def group_quantiles(groups: DataFrame, q: float = 0.99) -> DataFrame:
    """(panel_id, group, q): a group's own quantile, else the panel's shared one by Bonferroni."""
    per = groups.groupBy("panel_id", "group").agg(F.max("quantile").alias("own"))
    n = F.count("*").over(Window.partitionBy("panel_id"))
    return per.select("panel_id", "group", F.coalesce("own", S.bonferroni(q, n)).alias("q"))


def fit_threshold(fit: DataFrame, q: float | DataFrame = 0.99, low: float = 0.01) -> DataFrame:
    """(panel_id, group, threshold, q_low): exact quantiles of the fit scores.

    ``q``: one quantile, or a table (panel_id, group, q): then each group's own.
    """
    own = q if isinstance(q, DataFrame) else None
    return exact_quantiles(fit, ["panel_id", "group"], "score", {"threshold": "q" if own is not None else q, "q_low": low}, own)


def flag(scores: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Scores with flag (at or above the threshold) and normalised score; groups without threshold never flag."""
    out = scores.join(small(thresholds), ["panel_id", "group"], "left")
    hit = F.coalesce(F.col("score") >= F.col("threshold"), F.lit(False)).cast("int")
    return out.withColumns({"flag": hit, "normalized": normalized()}).drop("q_low")


def normalized() -> Column:
    """The score between q_low and the threshold, clipped to [0, 1]; null unless the threshold is above q_low."""
    return F.when(F.col("threshold") > F.col("q_low"), S.rescale(F.col("score"), F.col("q_low"), F.col("threshold")))


def combine_groups(scored: DataFrame) -> DataFrame:
    """(panel_id, ts, anomaly_score, anomaly_score_normalized, anomaly_threshold, anomaly_flag, winner).

    The flag is set if any group's is; score and threshold are those of the group with the largest
    normalised score, the first by name among equals.
    """
    best = F.struct((-F.coalesce("normalized", F.lit(float("-inf")))).alias("o"), F.col("group").alias("g"), F.col("score").alias("s"), F.col("normalized").alias("z"), F.col("threshold").alias("t"))
    out = scored.groupBy("panel_id", "ts").agg(F.max("flag").alias("anomaly_flag"), F.min(best).alias("b"))
    return out.select("panel_id", "ts", F.col("b.s").alias("anomaly_score"), F.col("b.z").alias("anomaly_score_normalized"), F.col("b.t").alias("anomaly_threshold"), "anomaly_flag", F.col("b.g").alias("winner"))


def group_details(scored: DataFrame, groups: list[str]) -> DataFrame:
    """One row a timestamp with group_<g>_raw, _normalized, _threshold and _flag."""
    of = lambda g, c: F.max(F.when(F.col("group") == g, F.col(c)))
    return scored.groupBy("panel_id", "ts").agg(*[of(g, c).alias(f"group_{g}_{n}") for g in groups for c, n in (("score", "raw"), ("normalized", "normalized"), ("threshold", "threshold"), ("flag", "flag"))])


def norm_scorer(order: float = 4.0) -> Scorer:
    """The default scorer: the L^order norm needs no fit; rows ``fit`` and others are scored alike."""
    return lambda rows: score_norm(rows, order, ["fit", "evaluated"])


def score_rows(rows: DataFrame, groups: DataFrame, q: float = 0.99, order: float = 4.0, scorer: Scorer | None = None) -> DataFrame:
    """Long group scores of the rows ``evaluated``, with thresholds fitted on the rows ``fit`` (both flags of a
    timestamp; a row may be both or neither).

    ``scorer``: rows with group, value and pred -> (panel_id, group, ts, score, fit, evaluated); by
    default the norm of ``order``, see ``ml_scorers`` for learned ones. One pass: each row is scored
    once and the scores, one row a group and timestamp, are settled for the threshold and the flags.
    """
    scores = (scorer or norm_scorer(order))(joins.assign_groups(rows, groups))
    scores = settled(scores, "scores")
    fit = scores.where("fit").select("panel_id", "group", "score")
    bare = fit.select("panel_id", "group").distinct().join(small(group_quantiles(groups, q)), ["panel_id", "group"], "left").select("panel_id", "group", F.coalesce("q", F.lit(q)).alias("q"))
    return flag(scores.where("evaluated").drop("fit", "evaluated"), fit_threshold(fit, bare))


def score_grouped(fit: DataFrame, rows: DataFrame, groups: DataFrame, q: float = 0.99, order: float = 4.0, scorer: Scorer | None = None) -> DataFrame:
    """Long group scores of ``rows`` with thresholds fitted on ``fit``; both with value and pred."""
    columns = ["panel_id", "channel", "ts", "value", "pred"]
    if fit is rows:
        both = rows.select(*columns, F.lit(True).alias("fit"), F.lit(True).alias("evaluated"))
    else:
        side = lambda df, is_fit: df.select(*columns, F.lit(is_fit).alias("fit"), F.lit(not is_fit).alias("evaluated"))
        both = side(fit, True).unionByName(side(rows, False))
    return score_rows(both, groups, q, order, scorer)


def system_groups(df: DataFrame) -> DataFrame:
    """Every channel of a panel in one group."""
    return df.select("panel_id", "channel").distinct().select("panel_id", F.lit("system").alias("group"), "channel", F.lit(None).cast("double").alias("quantile"))


def contributions(df: DataFrame, scores: DataFrame) -> DataFrame:
    """(panel_id, channel, ts, contribution): the channel's share of ((value - pred) / std)^2 times the
    score; std of the channel by sample, 1 if 0; null where nothing deviates."""
    std = small(df.groupBy("panel_id", "channel").agg(F.stddev_samp("value").alias("__std")))
    d = ((F.col("value") - F.col("pred")) / S.guard_zero(F.coalesce("__std", F.lit(1.0)), 1.0)) ** 2
    total = F.sum("__d").over(Window.partitionBy("panel_id", "ts"))  # a panel's channels
    rows = df.join(std, ["panel_id", "channel"]).select("panel_id", "channel", "ts", d.alias("__d")).withColumn("__t", total)
    out = rows.join(scores.select("panel_id", "ts", "anomaly_score"), ["panel_id", "ts"])
    return out.select("panel_id", "channel", "ts", (F.col("__d") / F.nullif(F.col("__t"), F.lit(0.0)) * F.col("anomaly_score")).alias("contribution"))


def trim_fit(fit: DataFrame, q: float = 0.95, least: int = 10) -> DataFrame:
    """Fit rows without the timestamps whose mean absolute error is above the panel's quantile ``q``;
    a panel that would keep fewer than ``least`` keeps all."""
    errors = settled(fit.groupBy("panel_id", "ts").agg(F.avg(F.abs(F.col("value") - F.col("pred"))).alias("e")), "errors")
    cut = small(exact_quantiles(errors, ["panel_id"], "e", {"__cut": q}))
    kept = errors.join(cut, "panel_id", "left").withColumn("ok", F.coalesce(F.col("e") <= F.col("__cut"), F.lit(False)))
    enough = small(kept.groupBy("panel_id").agg((F.count_if("ok") >= least).alias("enough")))
    keep = kept.join(enough, "panel_id").where("ok or not enough").select("panel_id", "ts")
    return fit.join(keep, ["panel_id", "ts"], "left_semi")
