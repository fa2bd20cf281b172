"""Projections, masks and row filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from . import intervals as intervals_index
from .panel import small


def classify_channels(df: DataFrame, exog: list[str] = (), suffix: str = "__weight", multipliers: list[str] = ()) -> DataFrame:
    """(panel_id, channel, role, ordinal): weight, multiplier, exog or target; configured exogenous
    names come first, then by name."""
    c = F.col("channel")
    multiplier = F.lit(False)
    for m in multipliers:
        multiplier = multiplier | c.startswith(m)
    rank = F.lit(len(exog))
    for i, e in reversed(list(enumerate(exog))):
        rank = F.when(c == e, i).otherwise(rank)
    role = F.when(c.endswith(suffix), "weight").when(multiplier, "multiplier").when(c.startswith("exogenous_") | c.isin(*exog), "exog").otherwise("target")
    return df.select("panel_id", "channel").distinct().select("panel_id", "channel", role.alias("role"), rank.alias("ordinal"))


def multiplier_channel(df: DataFrame, prefixes: list[str], suffix: str = "__weight") -> DataFrame:
    """(panel_id, multiplier): the first channel with one of ``prefixes``, weights aside."""
    c = F.col("channel")
    hit = F.lit(False)
    for p in prefixes:
        hit = hit | c.startswith(p)
    return df.where(hit & ~c.endswith(suffix)).groupBy("panel_id").agg(F.min("channel").alias("multiplier"))


def mask_bounds(df: DataFrame, bounds: DataFrame) -> DataFrame:
    """Values strictly outside ``bounds`` (panel_id, channel, lower, upper; either may be null) become null."""
    b = small(bounds.select("panel_id", "channel", "lower", "upper"))
    out = F.coalesce(F.col("value") < F.col("lower"), F.lit(False)) | F.coalesce(F.col("value") > F.col("upper"), F.lit(False))
    return df.join(b, ["panel_id", "channel"], "left").withColumn("value", F.when(~out, F.col("value"))).drop("lower", "upper")


def mask_maintenance(df: DataFrame, flag_channel: str) -> DataFrame:
    """Blanks every channel where the flag is not 0 or is missing, and drops the flag; a panel without flag stays."""
    flags = df.where(F.col("channel") == flag_channel).select("panel_id", "ts", F.col("value").alias("flag"))
    has = flags.select("panel_id").distinct().withColumn("has", F.lit(True))
    rest = df.where(F.col("channel") != flag_channel)
    out = rest.join(flags, ["panel_id", "ts"], "left").join(has, "panel_id", "left")
    on = F.col("has").isNotNull() & (F.coalesce(F.col("flag"), F.lit(1.0)) != 0)
    return out.withColumn("value", F.when(~on, F.col("value"))).drop("flag", "has")


def mask_intervals(df: DataFrame, intervals: DataFrame, buffer: int = 0, channels: list[str] | None = None) -> DataFrame:
    """Blanks ``channels`` (all by default) inside known intervals."""
    on = F.col("known") & (F.col("channel").isin(*channels) if channels else F.lit(True))
    return intervals_index.within(df, intervals, buffer).withColumn("value", F.when(~on, F.col("value"))).drop("known")


def filter_intervals(df: DataFrame, intervals: DataFrame, buffer: int = 0, per_window: bool = False) -> DataFrame:
    """Rows inside known intervals, once; or a copy for each interval with its bounds."""
    if not per_window:
        return intervals_index.within(df, intervals, buffer).where("known").drop("known")
    return intervals_index.each_within(df, intervals, buffer)


def in_interval(df: DataFrame, intervals: DataFrame) -> DataFrame:
    """``df`` with in_known."""
    return intervals_index.within(df, intervals).withColumnRenamed("known", "in_known")


def drop_imputed_rows(df: DataFrame) -> DataFrame:
    """Timestamps at which every channel was observed."""
    least = F.min(F.coalesce("observed", F.lit(0))).over(Window.partitionBy("panel_id", "ts"))  # a panel's channels
    return df.withColumn("__least", least).where("__least >= 0.5").drop("__least")


def drop_invalid_fit_rows(fit: DataFrame) -> DataFrame:
    """Timestamps at which all channels have finite true and predicted values."""
    good = F.bool_and(S.is_finite(F.col("value")) & S.is_finite(F.col("pred"))).over(Window.partitionBy("panel_id", "ts"))  # a panel's channels
    return fit.withColumn("__ok", good).where("__ok").drop("__ok")


def validate_inputs(df: DataFrame, strict: bool = False) -> DataFrame:
    """One row: missing and infinite values of value and pred; ``strict`` raises if there are any."""
    inf = lambda c: F.count_if(F.abs(F.col(c)) == float("inf"))
    none = lambda c: F.count_if(F.col(c).isNull() | F.isnan(c))
    out = df.agg(none("value").alias("value_missing"), inf("value").alias("value_infinite"), none("pred").alias("pred_missing"), inf("pred").alias("pred_infinite"))
    if strict and any(out.first()):
        raise ValueError("missing or infinite values in the rows to be scored")
    return out


def lookback(df: DataFrame, days: int) -> DataFrame:
    """Rows of each panel's last ``days`` days."""
    last = small(df.groupBy("panel_id").agg(F.max("ts").alias("__last")))
    return df.join(last, "panel_id").where(S.micros(F.col("ts")) >= S.micros(F.col("__last")) - days * 86_400 * S.MICROS).drop("__last")


def select_series(df: DataFrame, panels: list[str] | None = None, channels: list[str] | None = None) -> DataFrame:
    """Chosen panels and channels; an unknown panel is an error, an unknown channel finds nothing."""
    if panels:
        known = {r[0] for r in df.where(F.col("panel_id").isin(*panels)).select("panel_id").distinct().collect()}  # as many as asked for
        if missing := sorted(set(panels) - known):
            raise ValueError(f"unknown panels: {missing}")
        df = df.where(F.col("panel_id").isin(*panels))
    return df.where(F.col("channel").isin(*channels)) if channels else df


def unknown_channels(df: DataFrame, channels: list[str]) -> DataFrame:
    """(channel): those of ``channels`` that no panel has."""
    asked = df.sparkSession.createDataFrame([(c,) for c in channels], "channel string")
    return asked.join(df.select("channel").distinct(), "channel", "left_anti")


def to_zone(df: DataFrame, tz: str, back: bool = False) -> DataFrame:
    """ts shown in a zone; ``back`` from there to UTC."""
    return df.withColumn("ts", F.to_utc_timestamp("ts", tz) if back else F.from_utc_timestamp("ts", tz))


def adjust_by_baseline(df: DataFrame, channel: str = "temperature", baseline: str = "baseline") -> DataFrame:
    """``channel`` less ``baseline``; the baseline is dropped either way."""
    base = df.where(F.col("channel") == baseline).select("panel_id", "ts", F.col("value").alias("__base"))
    rest = df.where(F.col("channel") != baseline)
    has = base.select("panel_id").distinct().withColumn("__has", F.lit(True))
    out = rest.join(base, ["panel_id", "ts"], "left").join(has, "panel_id", "left")
    return out.withColumn("value", F.when((F.col("channel") == channel) & F.col("__has").isNotNull(), F.col("value") - F.col("__base")).otherwise(F.col("value"))).drop("__base", "__has")


def average_channels(df: DataFrame, pattern: str, out: str) -> DataFrame:
    """The mean of the channels that contain ``pattern``, as channel ``out`` (always observed), instead of them."""
    hit = F.col("channel").contains(pattern)
    mean = df.where(hit).groupBy("panel_id", "ts").agg(F.avg("value").alias("value")).select("panel_id", F.lit(out).alias("channel"), "ts", "value")
    if "observed" in df.columns:
        mean = mean.withColumn("observed", F.lit(1))
    return df.where(~hit).unionByName(mean)


def residuals(df: DataFrame) -> DataFrame:
    """``df`` with residual, abs_residual and squared_residual of value and pred."""
    r = F.col("value") - F.col("pred")
    return df.withColumns({"residual": r, "abs_residual": F.abs(r), "squared_residual": r * r})


def apply_multiplier(df: DataFrame, multipliers: DataFrame) -> DataFrame:
    """value and pred times the multiplier (panel_id, ts, multiplier) of their timestamp."""
    out = df.join(multipliers.select("panel_id", "ts", "multiplier"), ["panel_id", "ts"])
    return out.withColumns({"value": F.col("value") * F.col("multiplier"), "pred": F.col("pred") * F.col("multiplier")}).drop("multiplier")


def shift_time(df: DataFrame, seconds: int) -> DataFrame:
    return df.withColumn("ts", S.from_micros(S.micros(F.col("ts")) + seconds * S.MICROS))


def prediction_range(df: DataFrame, hours: int) -> DataFrame:
    """(panel_id, start_ts, end_ts): where predictions are, widened by ``hours``; no row without any."""
    pad = hours * 3600 * S.MICROS
    spans = df.where(F.col("pred").isNotNull()).groupBy("panel_id").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    return spans.select("panel_id", S.from_micros(S.micros(F.col("a")) - pad).alias("start_ts"), S.from_micros(S.micros(F.col("b")) + pad).alias("end_ts"))


def label_channels(df: DataFrame, units: DataFrame) -> DataFrame:
    """(panel_id, channel, source, unit): by name and by the table ``units`` (pattern, unit), longest pattern first."""
    c = F.col("channel")
    source = F.when(c.startswith("exogenous_"), F.split_part(c, F.lit("_"), F.lit(2))).when(c.startswith("channel_"), F.concat_ws(" ", F.lit("channel"), F.split_part(c, F.lit("_"), F.lit(2)))).otherwise(c)
    named = df.select("panel_id", "channel").distinct()
    found = named.join(small(units), c.contains(F.col("pattern")), "left").groupBy("panel_id", "channel").agg(F.max_by("unit", F.struct(F.length("pattern"), "pattern")).alias("unit"))
    return found.select("panel_id", "channel", source.alias("source"), F.coalesce("unit", F.lit("")).alias("unit"))


def nan_only_panels(df: DataFrame) -> DataFrame:
    """(panel_id): panels without a single value."""
    return df.groupBy("panel_id").agg(F.count("value").alias("n")).where("n = 0").select("panel_id")


def no_data_intervals(last: DataFrame, now: Column) -> DataFrame:
    """(panel_id, start_ts, end_ts, gap): from the last row to ``now`` where that is over an hour."""
    hours = (S.micros(now) - S.micros(F.col("latest_ts"))) / F.lit(3600 * S.MICROS)
    gap = F.when(hours >= 24, F.format_string("%d d %d h", F.floor(hours / 24), F.floor(hours % 24))).otherwise(F.format_string("%d h", F.floor(hours)))
    return last.where(hours > 1).select("panel_id", F.col("latest_ts").alias("start_ts"), now.alias("end_ts"), gap.alias("gap"))
