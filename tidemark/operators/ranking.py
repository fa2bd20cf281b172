"""Top-k, latest rows, and set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .joins import join_regions
from .panel import K


def top_anomalies(df: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` highest scores of each panel, with place."""
    w = Window.partitionBy("panel_id").orderBy(F.desc("anomaly_score"), "ts")
    return df.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def top_features(df: DataFrame, k: int = 3) -> DataFrame:
    """The ``k`` channels of the largest contribution at each timestamp, with place."""
    w = Window.partitionBy("panel_id", "ts").orderBy(F.desc_nulls_last("contribution"), "channel")
    return df.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def event_contributions(contributions: DataFrame, regions: DataFrame, k: int = 5) -> DataFrame:
    """(panel_id, region_id, start_ts, end_ts, features): each region's ``k`` channels by mean
    contribution, best first; the newest region first."""
    means = join_regions(contributions, regions).groupBy("panel_id", "region_id", "channel").agg(F.avg("contribution").alias("c"))
    best = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("c")).alias("o"), F.col("channel").alias("channel"), F.col("c").alias("contribution")))), 1, k)  # a panel's channels at most
    tops = means.groupBy("panel_id", "region_id").agg(best.alias("b"))
    tops = tops.withColumn("features", F.transform("b", lambda x: F.struct(x["channel"].alias("feature"), x["contribution"].alias("contribution")))).drop("b")
    return regions.select("panel_id", "region_id", "start_ts", "end_ts").join(tops, ["panel_id", "region_id"], "left").orderBy(F.desc("start_ts"), "panel_id")


def current_status(scores: DataFrame, values: DataFrame) -> DataFrame:
    """(panel_id, ts, anomaly_flag, anomaly_score, channels): each panel's latest row; its channels by
    current value, nulls first, then falling."""
    last = scores.groupBy("panel_id").agg(F.max(F.struct("ts", "anomaly_flag", "anomaly_score")).alias("l")).select("panel_id", "l.*")
    now = values.join(last.select("panel_id", "ts"), ["panel_id", "ts"], "left_semi")
    entry = F.struct(F.col("value").isNotNull().alias("has"), (-F.col("value")).alias("o"), "channel", "value")
    lists = now.groupBy("panel_id").agg(F.sort_array(F.collect_list(entry)).alias("e"))
    return last.join(lists, "panel_id", "left").select("panel_id", "ts", "anomaly_flag", "anomaly_score", F.transform("e", lambda x: x["channel"]).alias("channels"))


def best_model(trials: DataFrame) -> DataFrame:
    """(channel, model, metric): the smallest metric; of equal ones the first trial."""
    return trials.groupBy("channel").agg(F.min_by(F.struct("model", "metric"), F.struct("metric", "trial")).alias("b")).select("channel", "b.model", "b.metric")


def common_timestamps(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("panel_id", "ts").intersect(b.select("panel_id", "ts"))


def schema_diff(live: DataFrame, baseline: DataFrame, suffix: str = "__weight") -> DataFrame:
    """(panel_id, channel, side): channels that only one side has, weights aside."""
    of = lambda df: df.where(~F.col("channel").endswith(suffix)).select(*K).distinct()
    return of(live).exceptAll(of(baseline)).withColumn("side", F.lit("live")).unionByName(of(baseline).exceptAll(of(live)).withColumn("side", F.lit("baseline")))


def union_first(*parts: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of all parts; of equal keys the first part's."""
    every = reduce(DataFrame.unionByName, [p.withColumn("__part", F.lit(i)) for i, p in enumerate(parts)])
    rest = [c for c in every.columns if c not in keys and c != "__part"]
    best = every.groupBy(*keys).agg(F.min_by(F.struct(*rest), "__part").alias("__b"))
    return best.select(*keys, *[F.col(f"__b.{c}").alias(c) for c in rest])
