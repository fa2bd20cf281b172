"""Detection: prediction, fit and evaluation windows, scores, flags, regions, contributions.

Predictions and scores are written to the shared folder once and read where they are needed again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import aggregates, filters, joins, models, range_quantiles, scoring, windows
from ..operators.panel import row_numbers, settled, small


def predicted(df: DataFrame, trained: DataFrame | None, every: int = 3600) -> DataFrame:
    """``df`` with pred by ``trained`` models, or by the value before; settled."""
    return settled(models.predict(df, trained, every) if trained is not None else models.predict_naive(df, every), "predicted")


def _usable(observed: bool) -> Column:
    """Whether all channels of a timestamp have finite true and predicted values (and were observed)."""
    good = S.is_finite(F.col("value")) & S.is_finite(F.col("pred"))
    if observed:
        good = good & (F.coalesce("observed", F.lit(0)) >= 0.5)
    return F.bool_and(good).over(Window.partitionBy("panel_id", "ts"))  # a panel's channels


def detect(df: DataFrame, trained: DataFrame | None, bounds: DataFrame, groups: DataFrame | None = None, hist: int = 100, q: float = 0.99, order: float = 4.0, scope: str = "unseen", multipliers: DataFrame | None = None, every: int = 3600, target=None, least: int | None = None, strict: bool = False, observed_only: bool = False, scorer: scoring.Scorer | None = None) -> DataFrame:
    """Long group scores of the evaluation window: the last ``hist`` unseen timestamps of each panel.

    ``bounds``: (panel_id, test_start, train_end, train_size). Without ``trained`` models the
    value before predicts. What is unseen before the window fits scorer and thresholds; fit rows
    with an imputed or non-finite value are left out.

    ``target``: the window ends there; ``least``: how it gives way where rows are few (see
    ``windows.scoring_windows``). ``observed_only``: imputed timestamps are not evaluated either.
    ``strict``: a missing or infinite value among the evaluated rows is an error, and so is a panel without a whole
    window (``windows.TooFewRows``; without it see ``windows.window_problems``). ``scorer``: see
    ``ml_scorers.scorer``; the norm of ``order`` by default.
    """
    told = predicted(df, trained, every)
    if strict:
        few = windows.window_problems(told, bounds, hist, scope, target, least).collect()  # the panels that fail
        if few:
            raise windows.TooFewRows({r["panel_id"]: r["problem"] for r in few})
    marks = windows.scoring_windows(told, bounds, hist, scope, target, least)
    if multipliers is not None:
        # the window counts timestamps that have a multiplier
        told = settled(filters.apply_multiplier(windows.unseen_split(told, bounds, scope).where("unseen").drop("unseen"), multipliers), "weighted")
        marks = windows.scoring_windows(told, bounds, hist, "all", target, least)
    rows = told.join(marks, ["panel_id", "ts"])
    rows = rows.withColumn("fit", F.col("fit") & _usable("observed" in told.columns))
    if observed_only:
        seen = F.min(F.coalesce("observed", F.lit(0))).over(Window.partitionBy("panel_id", "ts")) >= 0.5
        rows = rows.withColumn("__seen", seen).withColumn("evaluated", F.col("evaluated") & F.col("__seen")).drop("__seen")
    rows = rows.where("fit or evaluated")
    if strict:
        filters.validate_inputs(rows.where("evaluated"), True)
    return scoring.score_rows(rows, groups if groups is not None else scoring.system_groups(told), q, order, scorer)


def score_all(df: DataFrame, trained: DataFrame | None, groups: DataFrame | None = None, q: float = 0.99, order: float = 4.0, every: int = 3600, scorer: scoring.Scorer | None = None) -> DataFrame:
    """Every finite row scored, with thresholds fitted on all of them."""
    return score_told(predicted(df, trained, every), groups, q, order, scorer)


def score_told(told: DataFrame, groups: DataFrame | None = None, q: float = 0.99, order: float = 4.0, scorer: scoring.Scorer | None = None) -> DataFrame:
    """``score_all`` of rows that have predictions already, settled ones best."""
    rows = filters.drop_invalid_fit_rows(told)
    return scoring.score_grouped(rows, rows, groups if groups is not None else scoring.system_groups(told), q, order, scorer)


def compare_scopes(unseen: DataFrame, every_row: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Overlap of the two scopes' flags by panel, and flag counts by scope and group."""
    overlap = joins.flag_overlap(scoring.combine_groups(unseen), scoring.combine_groups(every_row))
    both = aggregates.group_flag_summary(unseen).withColumn("scope", F.lit("unseen")).unionByName(aggregates.group_flag_summary(every_row).withColumn("scope", F.lit("all")))
    return overlap, both


def replay_known(df: DataFrame, trained: DataFrame | None, intervals: DataFrame, bounds: DataFrame, groups: DataFrame | None = None, hist: int = 100, q: float = 0.99, order: float = 4.0, every: int = 3600, slack: int = 200) -> DataFrame:
    """(window_id, panel_id, ts, mode, anomaly_score, ..., anomaly_flag, winner) inside each known window (window_id, start_ts, end_ts).

    Each window is detected as if it were the last of its panel. Mode ``default``: it lies within the last
    ``hist`` unseen timestamps, which are the evaluation window. ``shift``: it ends before the unseen rows
    begin; its rows count as unseen from ``hist`` + ``slack`` steps before its end. ``target``: any other; the
    evaluation window ends one step after it. Rows are predicted and scored once; a window's thresholds come
    from counts along the series (see ``range_quantiles``), so that a score is not copied for each window.
    """
    told = predicted(df, trained, every)
    stamps = settled(told.select("panel_id", "ts").distinct(), "stamps")
    placed = settled(windows.unseen_split(row_numbers(stamps, ["panel_id"]), bounds), "placed")
    ends = settled(placed.groupBy("panel_id").agg(F.min(F.when(F.col("unseen"), F.col("ts"))).alias("from_ts"), F.max("ts").alias("last_ts"), F.min(F.when(F.col("unseen"), F.col("rn"))).alias("from_rn"), F.max("rn").alias("n")), "ends")
    us, step = lambda c: S.micros(F.col(c)), every * S.MICROS
    # one row for each panel and configured window
    asked = ends.join(small(intervals.where("start_ts <= end_ts").select("window_id", "start_ts", "end_ts")), F.lit(True))
    first = asked.withColumn("rn", F.greatest(F.col("from_rn"), F.col("n") - hist + 1))
    begin = first.join(placed.select("panel_id", "rn", F.col("ts").alias("default_ts")), ["panel_id", "rn"]).drop("rn")
    mode = F.when(us("end_ts") < us("from_ts"), "shift").when((us("start_ts") >= us("default_ts")) & (us("end_ts") <= us("last_ts")), "default").otherwise("target")
    asked = begin.withColumn("mode", mode)
    upto = F.when(F.col("mode") == "shift", us("end_ts")).when(F.col("mode") == "default", us("last_ts")).otherwise(F.least(us("end_ts") + step, us("last_ts")))
    since = F.when(F.col("mode") == "shift", us("end_ts") - (hist + slack) * step).otherwise(us("from_ts") - 1)
    asked = settled(asked.select("panel_id", "window_id", "start_ts", "end_ts", "mode", since.alias("since"), upto.alias("upto")), "windows")
    # the places of the first and the last timestamp of each window's rows, by counting those before
    sides = F.explode(F.array(F.struct(F.lit("before").alias("side"), (F.col("since") + 1).alias("at")), F.struct(F.lit("last_rn").alias("side"), (F.col("upto") + 1).alias("at"))))
    at = asked.select("panel_id", "window_id", sides.alias("e")).select("panel_id", F.struct("window_id", "e.side").alias("end"), "e.at")
    places = range_quantiles.counts_before(placed.select("panel_id", us("ts").alias("pos"), F.lit(0).alias("sub")), at, ["panel_id"], range_quantiles.WIDTH * step)
    of = lambda side: F.max(F.when(F.col("end.side") == side, F.col("n"))).alias(side)
    last = asked.join(small(places.groupBy("panel_id", F.col("end.window_id").alias("window_id")).agg(of("before"), of("last_rn"))), ["panel_id", "window_id"]).where("last_rn > before")
    last = settled(last, "windows")

    named = groups if groups is not None else scoring.system_groups(told)
    rows = told.withColumn("ok", F.coalesce(_usable("observed" in told.columns), F.lit(False)))
    scores = scoring.score_norm(joins.assign_groups(rows, named), order, ["ok"])
    scores = settled(scores.join(placed.select("panel_id", "ts", "rn"), ["panel_id", "ts"]), "scores")
    # thresholds: quantiles of the scores of each window's fit rows
    quantiles = scores.select("panel_id", "group").distinct().join(small(scoring.group_quantiles(named, q)), ["panel_id", "group"], "left").select("panel_id", "group", F.coalesce("q", F.lit(q)).alias("q"))
    asks = last.join(small(quantiles), "panel_id").select("panel_id", "group", F.col("window_id").alias("ask"), (F.col("before") + 1).alias("lo"), (F.col("last_rn") - hist).alias("hi"), "q", F.lit(0.01).alias("low"))
    fit = scores.where("ok").select("panel_id", "group", F.col("rn").alias("pos"), F.col("score").alias("value"))
    limits = range_quantiles.range_quantiles(fit, asks, ["panel_id", "group"], {"threshold": "q", "q_low": "low"})
    # the rows that each window shows, by buckets of places
    bucket = lambda c: F.floor(c / F.lit(range_quantiles.WIDTH))
    shown = last.withColumn("bucket", F.explode(F.sequence(bucket(F.greatest(F.col("last_rn") - hist + 1, F.lit(1))), bucket(F.col("last_rn")))))
    seen = scores.withColumn("bucket", bucket(F.col("rn"))).join(small(shown), ["panel_id", "bucket"])
    seen = seen.where((F.col("rn") > F.col("last_rn") - hist) & (F.col("rn") <= F.col("last_rn")) & (us("ts") > F.col("since")) & F.col("ts").between(F.col("start_ts"), F.col("end_ts")))
    key = F.concat_ws("#", "panel_id", F.col("window_id").cast("string"))
    flagged = scoring.flag(seen.select(key.alias("panel_id"), "group", "ts", "score"), limits.withColumnRenamed("ask", "window_id").select(key.alias("panel_id"), "group", "threshold", "q_low"))
    out = scoring.combine_groups(flagged)
    modes = last.select(key.alias("panel_id"), F.col("panel_id").alias("panel"), "window_id", "mode")
    return out.join(small(modes), "panel_id").drop("panel_id").withColumnRenamed("panel", "panel_id")


def flagship(hourly: DataFrame, hist: int = 200, q: float = 0.99) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(regions, contributions, scores): which hours were anomalous in each panel, and which channels drove it."""
    from ..operators import imputation

    panel = settled(imputation.impute(hourly), "panel")
    told = predicted(panel, None)
    scores = settled(scoring.combine_groups(detect(panel, None, no_bounds(panel), hist=hist, q=q, scope="all")), "scores")
    rows = told.join(scores.select("panel_id", "ts"), ["panel_id", "ts"], "left_semi")
    return windows.anomaly_regions(scores), scoring.contributions(rows, scores), scores


def no_bounds(df: DataFrame) -> DataFrame:
    """(panel_id, test_start, train_end, train_size) without a boundary: percentages count."""
    none: Column = F.lit(None)
    return df.select("panel_id").distinct().select("panel_id", none.cast("timestamp").alias("test_start"), none.cast("timestamp").alias("train_end"), none.cast("long").alias("train_size"))
