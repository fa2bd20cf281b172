"""Joins: as-of, coalescing, interval and band joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from .panel import settled, small


#: Buckets over which one task carries a value.
PART = 256


def asof_join(df: DataFrame, exog: DataFrame, cols: list[str], bucket: int = 3600) -> DataFrame:
    """``df`` with the last value of each of ``cols`` of ``exog`` (ts, cols) at or before its ts; null before the first.

    The answer depends on the time alone: the distinct timestamps of all panels are stacked with
    the external rows and filled forward, all columns in one pass, in buckets of ``bucket`` seconds;
    what a bucket starts with is carried over the buckets, one row each. A value equal in time counts; of external rows with one ts the largest value.
    """
    place = F.floor(S.micros(F.col("ts")) / F.lit(bucket * S.MICROS))
    columns = [F.col(f"`{c}`").cast("double").alias(c) for c in cols]
    none = [F.lit(None).cast("double").alias(c) for c in cols]
    both = df.select("ts").distinct().select("ts", *none, F.lit(1).alias("own")).unionByName(exog.select("ts", *columns).groupBy("ts").agg(*[F.max(f"`{c}`").alias(c) for c in cols], F.lit(0).alias("own")))
    both = settled(both.where("ts is not null").withColumn("bucket", place), "stamps")
    last = lambda c: F.max(F.when(F.col(f"`{c}`").isNotNull(), F.struct("ts", F.col(f"`{c}`").alias("v"))))["v"]
    ends = both.groupBy("bucket").agg(*[last(c).alias(f"__{c}") for c in cols])
    # carried over the buckets of a part, then over the parts: no window without a key
    ends = ends.withColumn("part", F.floor(F.col("bucket") / PART))
    along = Window.partitionBy("part").orderBy("bucket")
    of = lambda c, w: F.last(f"`__{c}`", ignorenulls=True).over(w)
    ends = settled(ends.select("bucket", "part", *[of(c, along.rowsBetween(Window.unboundedPreceding, -1)).alias(f"__{c}") for c in cols], *[of(c, along).alias(f"__upto_{c}") for c in cols]), "ends")
    parts = ends.groupBy("part").agg(*[F.max_by(f"`__upto_{c}`", F.when(F.col(f"`__upto_{c}`").isNotNull(), F.col("bucket"))).alias(f"__p_{c}") for c in cols])
    before = parts.select("part").join(parts.withColumnRenamed("part", "earlier"), F.col("earlier") < F.col("part")).groupBy("part").agg(*[F.max_by(f"`__p_{c}`", F.when(F.col(f"`__p_{c}`").isNotNull(), F.col("earlier"))).alias(f"__p_{c}") for c in cols])
    ends = ends.join(small(before), "part", "left").select("bucket", *[F.coalesce(F.col(f"`__{c}`"), F.col(f"`__p_{c}`")).alias(f"__{c}") for c in cols])
    # at equal ts the external row stands before the own one
    w = Window.partitionBy("bucket").orderBy("ts", "own")
    filled = both.join(small(ends), "bucket").select("ts", "own", *[F.coalesce(F.last(f"`{c}`", ignorenulls=True).over(w), F.col(f"`__{c}`")).alias(c) for c in cols]).where("own = 1").drop("own")
    return df.join(filled, "ts", "left").select(*[df[c] for c in df.columns], *[F.col(f"`{c}`") for c in cols])


def join_sources(df: DataFrame, sources: dict[str, DataFrame | None]) -> tuple[DataFrame, DataFrame]:
    """All sources joined as of each ts, as exogenous_<source>_<measure>; and (source, status, error).

    A source that is None is disabled; one that cannot be analysed or has no ts is an error and is skipped.
    """
    told = []
    for name, source in sources.items():
        if source is None:
            told.append((name, "disabled", None))
            continue
        try:
            measures = [c for c in source.columns if c != "ts"]
            if "ts" not in source.columns or not measures:
                raise ValueError("no ts or no measure")
        except Exception as e:  # a source that fails does not stop the others
            told.append((name, "error", str(e).splitlines()[0]))
            continue
        df = asof_join(df, source.select("ts", *[F.col(c).alias(f"exogenous_{name}_{c}") for c in measures]), [f"exogenous_{name}_{c}" for c in measures])
        told.append((name, "ok", None))
    return df, df.sparkSession.createDataFrame(told, "source string, status string, error string")


def align(*dfs: DataFrame) -> DataFrame:
    """Rows whose (panel_id, ts) all frames have."""
    return reduce(lambda a, b: a.join(b, ["panel_id", "ts"]), dfs)


def merge_results(panel: DataFrame, flags: DataFrame, scores: DataFrame, forecast: DataFrame) -> DataFrame:
    """Each panel row with its flag, scores and prediction, where they exist."""
    return panel.join(flags, ["panel_id", "ts"], "left").join(scores, ["panel_id", "ts"], "left").join(forecast, ["panel_id", "channel", "ts"], "left")


def combine_first(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Both sides' rows; of a cell that both have, the old value unless it is missing."""
    columns = list(dict.fromkeys([*old.columns, *new.columns]))
    o, n = old.alias("o"), new.alias("n")
    on = reduce(lambda a, b: a & b, [F.col(f"o.{k}") == F.col(f"n.{k}") for k in keys])
    take = lambda c: F.coalesce(*[F.col(f"{s}.{c}") for s, df in (("o", old), ("n", new)) if c in df.columns]).alias(c)
    return o.join(n, on, "full").select(*[take(c) for c in columns])


def stitch_history(history: DataFrame, current: DataFrame) -> DataFrame:
    """Rows of ``history`` for lags, with recent: whether a row is ``current``'s; current wins where both have a row."""
    keys = ["panel_id", "channel", "ts"]
    older = history.join(current.select(*keys), keys, "left_anti")
    return older.withColumn("recent", F.lit(False)).unionByName(current.withColumn("recent", F.lit(True)))


def join_regions(df: DataFrame, regions: DataFrame) -> DataFrame:
    """``df`` with region_id for each region (panel_id, region_id, start_ts, end_ts) that holds its ts.

    Regions are spread over the days they touch, so that the join has an equality key beside the range.
    """
    day = lambda c: F.date_trunc("day", F.col(c))
    days = regions.select("panel_id", "region_id", "start_ts", "end_ts", F.explode(F.sequence(day("start_ts"), day("end_ts"), F.expr("interval 1 day"))).alias("__day"))
    return df.withColumn("__day", day("ts")).join(days, ["panel_id", "__day"]).where("ts between start_ts and end_ts").drop("__day", "start_ts", "end_ts")


def classify_gaps(live: DataFrame, full: DataFrame, within: int = 3600) -> DataFrame:
    """``live`` gaps (panel_id, start_ts, end_ts) with kind: natural if the reference has a gap with
    both ends less than ``within`` seconds away, else fixable."""
    bucket = lambda c: F.floor(S.micros(F.col(c)) / F.lit(within * S.MICROS))
    ours = live.withColumn("__b", F.explode(F.array(bucket("start_ts") - 1, bucket("start_ts"), bucket("start_ts") + 1)))
    theirs = full.select(F.col("panel_id"), F.col("start_ts").alias("__a"), F.col("end_ts").alias("__z")).withColumn("__b", bucket("__a"))
    near = ours.join(theirs, ["panel_id", "__b"]).where((F.abs(S.micros(F.col("start_ts")) - S.micros(F.col("__a"))) < within * S.MICROS) & (F.abs(S.micros(F.col("end_ts")) - S.micros(F.col("__z"))) < within * S.MICROS))
    found = near.select("panel_id", "start_ts", "end_ts").distinct().withColumn("kind", F.lit("natural"))
    return live.join(found, ["panel_id", "start_ts", "end_ts"], "left").withColumn("kind", F.coalesce("kind", F.lit("fixable")))


def join_profile(df: DataFrame, profile: DataFrame) -> DataFrame:
    """``df`` with expected: the profile's mean (channel, hour, mean) of its hour, else the channel's mean of the profile."""
    whole = profile.groupBy("channel").agg(F.avg("mean").alias("__all"))
    out = df.withColumn("hour", F.hour("ts")).join(small(profile.select("channel", "hour", "mean")), ["channel", "hour"], "left").join(small(whole), "channel", "left")
    return out.withColumn("expected", F.coalesce("mean", "__all")).drop("mean", "__all", "hour")


def flag_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """For each panel, on shared timestamps: rows, flags and rates of both, only A, only B, both, Jaccard, median scores."""
    x = a.select("panel_id", "ts", F.col("anomaly_flag").alias("fa"), F.col("anomaly_score").alias("sa"))
    y = b.select("panel_id", "ts", F.col("anomaly_flag").alias("fb"), F.col("anomaly_score").alias("sb"))
    both, either = F.sum(F.expr("int(fa = 1 and fb = 1)")), F.sum(F.expr("int(fa = 1 or fb = 1)"))
    out = x.join(y, ["panel_id", "ts"]).groupBy("panel_id").agg(F.count("*").alias("rows"), F.sum("fa").alias("flags_a"), F.sum("fb").alias("flags_b"), F.sum(F.expr("int(fa = 1 and fb = 0)")).alias("only_a"), F.sum(F.expr("int(fa = 0 and fb = 1)")).alias("only_b"), both.alias("both"), either.alias("either"), F.median("sa").alias("median_a"), F.median("sb").alias("median_b"))
    return out.select("*", F.try_divide("flags_a", "rows").alias("rate_a"), F.try_divide("flags_b", "rows").alias("rate_b"), F.try_divide("both", "either").alias("jaccard")).drop("either")


def values_at_flags(actual: DataFrame, forecast: DataFrame, flags: DataFrame) -> DataFrame:
    """(panel_id, channel, ts, value, pred) at flagged timestamps."""
    hits = flags.where("anomaly_flag = 1").select("panel_id", "ts").distinct()
    return actual.join(hits, ["panel_id", "ts"], "left_semi").join(forecast.select("panel_id", "channel", "ts", "pred"), ["panel_id", "channel", "ts"], "left").select("panel_id", "channel", "ts", "value", "pred")


def strategy_grid(*frames: DataFrame) -> DataFrame:
    """Every combination of parameter rows."""
    return reduce(lambda a, b: a.crossJoin(b), frames)


def assign_groups(df: DataFrame, groups: DataFrame) -> DataFrame:
    """``df`` with group: a row for each group (panel_id, group, channel) its channel is in.

    A panel without a usable group is one group, system; channels outside all groups of the others
    are left out.
    """
    named = df.select("panel_id", "channel").distinct()
    usable = named.join(small(groups.select("panel_id", "group", "channel")), ["panel_id", "channel"])
    bare = named.join(usable.select("panel_id").distinct(), "panel_id", "left_anti").select("panel_id", "channel", F.lit("system").alias("group"))
    return df.join(small(usable.select("panel_id", "channel", "group").unionByName(bare)), ["panel_id", "channel"])


def missing_group_channels(df: DataFrame, groups: DataFrame) -> DataFrame:
    """(panel_id, group, channel) that the panels do not have."""
    return groups.select("panel_id", "group", "channel").join(df.select("panel_id", "channel").distinct(), ["panel_id", "channel"], "left_anti").select("panel_id", "group", "channel")


def compare_overlap(raw: DataFrame, processed: DataFrame) -> DataFrame:
    """Rows of both stages for common channels within the time range that both cover, with stage."""
    span = lambda df, a, b: df.groupBy("panel_id").agg(F.min("ts").alias(a), F.max("ts").alias(b))
    bounds = span(raw, "a1", "b1").join(span(processed, "a2", "b2"), "panel_id").select("panel_id", F.greatest("a1", "a2").alias("__a"), F.least("b1", "b2").alias("__b"))
    common = raw.select("panel_id", "channel").distinct().intersect(processed.select("panel_id", "channel").distinct())
    keep = small(common.join(bounds, "panel_id"))
    columns = ["panel_id", "channel", "ts", "value"]
    both = raw.select(*columns, F.lit("raw").alias("stage")).unionByName(processed.select(*columns, F.lit("processed").alias("stage")))
    return both.join(keep, ["panel_id", "channel"]).where("ts between __a and __b").drop("__a", "__b")
