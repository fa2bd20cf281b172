"""Tables as Parquet, JSON and CSV: panels, versioned snapshots, models, results, external series."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators.panel import clean, small

PANEL = "channel string, ts timestamp, value double, panel_id string"
VERSION = r"^\d{8}_\d{6}$"


def events_panel(spark: SparkSession, folder: str, panels: int = 2) -> DataFrame:
    """The ``events`` table as a raw panel: panel_id = user_id modulo ``panels``, channel = event_type."""
    e = spark.read.parquet(f"{folder.rstrip('/')}/events.parquet")
    return clean(e.select((F.col("user_id") % panels).cast("string").alias("panel_id"), F.col("event_type").alias("channel"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").cast("double").alias("value")))


def write_panels(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).option("compression", "snappy").partitionBy("panel_id").parquet(path)


def read_panels(spark: SparkSession, path: str, panels: list[str] | None = None) -> DataFrame:
    """The panels below ``path``; chosen ones prune partitions. A missing path is an error."""
    df = spark.read.schema(PANEL).parquet(path)
    df = df.where(F.col("panel_id").isin(*panels)) if panels else df
    return df.select("panel_id", "channel", "ts", "value")


def write_version(df: DataFrame, path: str, version: str) -> None:
    """Adds a snapshot under ``version`` (yyyymmdd_hhmmss or live); writing it again replaces it alone."""
    df.withColumn("version", F.lit(version)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("version", "panel_id").parquet(path)


def latest_version(df: DataFrame) -> DataFrame:
    """Rows of the newest version; names that are no version are left out."""
    named = df.where(F.col("version").rlike(VERSION))
    return named.join(F.broadcast(named.agg(F.max("version").alias("version"))), "version")


def read_version(spark: SparkSession, path: str, version: str | None = None) -> DataFrame:
    """A snapshot: the pinned ``version``, or the newest one, found in the partition names."""
    df = spark.read.option("recursiveFileLookup", "false").option("basePath", path).schema(PANEL + ", version string").parquet(path)
    if version is None:
        version = df.where(F.col("version").rlike(VERSION)).agg(F.max("version")).first()[0]
        if version is None:
            raise FileNotFoundError(f"no version below {path}")
    return df.where(F.col("version") == version).select("version", "panel_id", "channel", "ts", "value")


def write_snapshot_metadata(meta: DataFrame, path: str, requested: tuple[str, str] | None = None) -> None:
    """Row counts and ranges of panels as JSON, with the range that was asked for."""
    a, b = requested or (None, None)
    meta.withColumns({"requested_start": F.lit(a), "requested_end": F.lit(b)}).write.mode("overwrite").json(path)


def latest_model(models: DataFrame, version: str | None = None) -> DataFrame:
    """The models of each panel's newest version that has that panel, or of the pinned version."""
    if version is not None:
        return models.where(F.col("version") == version)
    newest = models.groupBy("panel_id").agg(F.max("version").alias("version"))
    return models.join(small(newest), ["panel_id", "version"])


def save_models(models: DataFrame, path: str, version: str) -> None:
    models.withColumn("version", F.lit(version)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("version").parquet(path)


def save_results(scores: DataFrame, contributions: DataFrame, path: str, run: str) -> None:
    """Scores and flags as CSV with a header, contributions as Parquet, under ``run`` (a time stamp, or live)."""
    scores.withColumn("run", F.lit(run)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run", "panel_id").option("header", True).csv(f"{path}/scores")
    contributions.withColumn("run", F.lit(run)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run", "panel_id").parquet(f"{path}/contributions")


def read_results(spark: SparkSession, path: str) -> DataFrame:
    schema = "ts timestamp, anomaly_score double, anomaly_score_normalized double, anomaly_threshold double, anomaly_flag int, run string, panel_id string"
    return spark.read.schema(schema).option("header", True).csv(f"{path}/scores")


def save_eval(evaluation: DataFrame, path: str) -> None:
    evaluation.write.mode("overwrite").option("header", True).csv(path)


def write_exog(df: DataFrame, path: str) -> None:
    """An external series; without a ts it is refused."""
    if "ts" not in df.columns:
        raise ValueError("an external series needs ts")
    df.write.mode("overwrite").parquet(path)


def read_exog(spark: SparkSession, path: str) -> DataFrame:
    """An external series; naive times count as UTC."""
    df = spark.read.parquet(path)
    if "ts" not in df.columns:
        raise ValueError("an external series needs ts")
    return df.withColumn("ts", F.col("ts").cast("timestamp"))


def explode_hourly_json(df: DataFrame, variables: list[str], column: str = "payload") -> DataFrame:
    """(ts, variables) from payloads {"hourly": {"time": [...], variable: [...]}}; payloads with an
    error or without times are left out, absent variables are null."""
    fields = ", ".join(f"`{v}`: array<double>" for v in variables)
    body = F.from_json(column, f"struct<error: boolean, hourly: struct<time: array<string>, {fields}>>")
    rows = df.select(body.alias("b")).where("b.hourly.time is not null and not coalesce(b.error, false)")
    zipped = F.arrays_zip(F.col("b.hourly.time").alias("time"), *[F.coalesce(F.col(f"b.hourly.{v}"), F.array().cast("array<double>")).alias(v) for v in variables])
    out = rows.select(F.explode(zipped).alias("r"))
    return out.select(F.col("r.time").try_cast("timestamp").alias("ts"), *[F.col(f"r.{v}").alias(v) for v in variables]).where("ts is not null")


def shape_single_channel(df: DataFrame, prefer: str = "Actual Load", time: str = "ts", tz: str | None = None) -> DataFrame:
    """(ts, value): the preferred column, else one whose name contains actual, else the first;
    numbers only, in UTC, sorted."""
    columns = [c for c in df.columns if c != time]
    chosen = prefer if prefer in columns else next((c for c in columns if "actual" in c.lower()), columns[0])
    ts = F.to_utc_timestamp(time, tz) if tz else F.col(time).cast("timestamp")
    return df.select(ts.alias("ts"), S.to_number(F.col(f"`{chosen}`").cast("string")).alias("value")).dropna().orderBy("ts")


def upsert_channel_config(config: DataFrame, winners: DataFrame) -> DataFrame:
    """(panel_id, channel, model, params): the winners' settings over the existing ones; channels with an error keep theirs."""
    good = winners.where("error is null").select("panel_id", "channel", F.col("model").alias("__m"), F.col("params").alias("__p"))
    out = config.select("panel_id", "channel", "model", "params").join(good, ["panel_id", "channel"], "full")
    return out.select("panel_id", "channel", F.coalesce("__m", "model").alias("model"), F.when(F.col("__m").isNotNull(), F.col("__p")).otherwise(F.col("params")).alias("params"))


def save_tuning(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").partitionBy("panel_id").json(path)


def save_status(df: DataFrame, path: str) -> None:
    df.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def detail_export(told: DataFrame, strategies: DataFrame, channels: list[str] | None = None) -> DataFrame:
    """One row a timestamp: each channel's value, prediction and absolute error, their mean error,
    and score, normalised score and flag of each strategy."""
    e = F.abs(F.col("value") - F.col("pred"))
    wide = told.groupBy("panel_id", "ts").pivot("channel", channels).agg(F.first("value").alias("true"), F.first("pred").alias("pred"), F.first(e).alias("abs_err"))
    mean = told.groupBy("panel_id", "ts").agg(F.avg(e).alias("mean_abs_err"))
    by = strategies.groupBy("panel_id", "ts").pivot("strategy").agg(F.first("anomaly_score").alias("score"), F.first("anomaly_score_normalized").alias("norm"), F.first("anomaly_flag").alias("flag"))
    return wide.join(mean, ["panel_id", "ts"]).join(by, ["panel_id", "ts"], "left")


def missing_ranges(cache: DataFrame, start: Column, end: Column) -> DataFrame:
    """(start_ts, end_ts): the hours of [start, end] before and after what the cache holds; all of it if that is empty."""
    hour = 3600 * S.MICROS
    a, b = F.floor(S.micros(start) / hour) * hour, F.ceil(S.micros(end) / hour) * hour
    have = cache.agg(F.min("ts").alias("lo"), F.max("ts").alias("hi")).select(S.micros(F.col("lo")).alias("lo"), S.micros(F.col("hi")).alias("hi"), a.alias("a"), b.alias("b"))
    none = F.array(F.struct(F.col("a").alias("s"), F.col("b").alias("e")))
    sides = F.array(F.struct(F.col("a").alias("s"), F.least(F.col("b"), F.col("lo") - hour).alias("e")), F.struct(F.greatest(F.col("a"), F.col("hi") + hour).alias("s"), F.col("b").alias("e")))
    out = have.select(F.explode(F.when(F.col("lo").isNull(), none).otherwise(sides)).alias("r")).where("r.s <= r.e")
    return out.select(S.from_micros(F.col("r.s").cast("long")).alias("start_ts"), S.from_micros(F.col("r.e").cast("long")).alias("end_ts"))


def split_range(ranges: DataFrame, cutoff: Column) -> DataFrame:
    """(start_ts, end_ts, source): the part up to ``cutoff`` from the archive, the part after it from the forecast; empty parts fall away."""
    part = lambda s, e, n: F.struct(s.alias("s"), e.alias("e"), F.lit(n).alias("n"))
    hour = F.expr("interval 1 hour")
    parts = F.array(part(F.col("start_ts"), F.least(F.col("end_ts"), cutoff), "archive"), part(F.greatest(F.col("start_ts"), cutoff + hour), F.col("end_ts"), "forecast"))
    return ranges.select(F.explode(parts).alias("p")).where("p.s <= p.e").select(F.col("p.s").alias("start_ts"), F.col("p.e").alias("end_ts"), F.col("p.n").alias("source"))


def stitch(*parts: DataFrame, key: str = "ts") -> DataFrame:
    """Rows of all parts, of equal keys the first part's."""
    every = reduce(DataFrame.unionByName, [p.withColumn("__i", F.lit(i)) for i, p in enumerate(parts)])
    w = Window.partitionBy(key).orderBy("__i")
    return every.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__i", "__r")


def cyclic_fallback(df: DataFrame, start: Column, end: Column, period: int = 24) -> DataFrame:
    """(ts, value, synthetic): hours from ``start`` to ``end`` with the last ``period`` values again and again; fewer are an error."""
    tail = df.where("value is not null").orderBy(F.desc("ts")).limit(period).select("ts", "value")
    tail = tail.agg(F.sort_array(F.collect_list(F.struct("ts", "value"))).alias("a")).select(F.posexplode("a").alias("i", "r")).select("i", "r.*")  # a period of rows
    if tail.count() < period:
        raise ValueError(f"fewer than {period} rows to repeat")
    grid = df.sparkSession.range(1).select(F.explode(F.sequence(start, end, F.expr("interval 1 hour"))).alias("ts"))
    grid = grid.withColumn("i", F.pmod(F.round((S.micros(F.col("ts")) - S.micros(start)) / F.lit(3600 * S.MICROS)).cast("int"), F.lit(period)))
    return grid.join(F.broadcast(tail.select("i", "value")), "i").select("ts", "value", F.lit(True).alias("synthetic"))


def fetch_window(df: DataFrame, now: Column, start: Column | None = None) -> DataFrame:
    """One row (start_ts, end_ts): what the panels span, else the configured start or 30 days before ``now``, until ``now``."""
    default = start if start is not None else now - F.expr("interval 30 days")
    return df.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).select(F.coalesce("a", default).alias("start_ts"), F.coalesce("b", now).alias("end_ts"))
