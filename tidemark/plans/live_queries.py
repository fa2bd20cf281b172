"""The registered queries of the live panel and of the round trips through storage, with their SQL.

Streams read what the panel's tables wrote to the shared folder as newly landed files, take all of it
(``availableNow``) and write there; the query shows what they wrote. Stored results are shown as read back.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import models as M
from ..operators import scoring as C
from ..operators.panel import K, settled, shared_folder
from ..sources import tables as T
from ..streaming import live as L
from ..streaming import scores as X
from . import queries as Q
from . import tune as U
from .queries import add, select

LONG = "panel_id string, channel string, ts timestamp, value double"
FLAGS = "panel_id string, ts timestamp, anomaly_flag int"


def _path(s: SparkSession, name: str) -> str:
    return f"{shared_folder(s)}/tidemark-{s.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def _files(df: DataFrame, name: str) -> str:
    """The folder of the files that ``df`` lands in."""
    path = _path(df.sparkSession, name)
    df.write.parquet(path)
    return path


def _landed(stream: DataFrame, name: str) -> DataFrame:
    """What ``stream`` writes of all files that are there."""
    s, path = stream.sparkSession, _path(stream.sparkSession, name)
    writer = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/log")
    writer.trigger(availableNow=True).start().awaitTermination()
    return s.read.schema(stream.schema).parquet(f"{path}/out")


def _arriving(s: SparkSession, df: DataFrame) -> DataFrame:
    return L.stream_panels(s, _files(df.select(*K, "ts", "value"), "arriving"), LONG)


def _followed(s: SparkSession, df: DataFrame) -> DataFrame:
    """The live table after it followed the stream of ``df``."""
    path = _path(s, "live")
    table = L.LiveTable(s, f"{path}/table")
    table.follow(_arriving(s, df), f"{path}/log").awaitTermination()
    return table.read()


def _raised(df: DataFrame) -> DataFrame:
    """``df`` with other values, so that a result tells which side a row came from."""
    return df.withColumn("value", F.col("value") + 1)


def _metric(s: SparkSession, d: str) -> DataFrame:
    return U.metric(Q.whole(s, d), "mae")


# ------------------------------------------------------------------ streams
def stream_regions(s: SparkSession, d: str) -> DataFrame:
    flags = _files(Q.system_scores(s, d).select("panel_id", "ts", F.col("anomaly_flag").cast("int").alias("anomaly_flag")), "flags")
    return _landed(L.stream_regions(s.readStream.schema(FLAGS).parquet(flags), "90 minutes"), "regions")


def stream_score(s: SparkSession, d: str) -> DataFrame:
    return _landed(L.stream_score(_arriving(s, Q.panel(s, d)), Q.fixed_models(s, d)), "scored").select(*K, "ts", "pred")


def stream_flags(s: SparkSession, d: str) -> DataFrame:
    """Flags of the stream against thresholds that the batch scores of the same models give."""
    rows, fixed = Q.panel(s, d).where("channel <> 'error'"), Q.fixed_models(s, d)
    told = C.score_norm(M.predict(rows, fixed, reach=3).withColumn("group", F.lit("system")))
    limits = settled(C.fit_threshold(settled(told.where("score IS NOT NULL"), "scores")), "limits")
    X.state_in_rocksdb(s)
    try:
        return _landed(X.stream_flags(_arriving(s, rows), fixed, limits, 3), "flags").drop("group")
    finally:
        s.conf.unset("spark.sql.streaming.stateStore.providerClass")


def live_versions(s: SparkSession, d: str) -> DataFrame:
    """The live table after its second merge, and how many rows its first version still shows."""
    table, base = L.LiveTable(s, f"{_path(s, 'live')}/table"), Q.panel(s, d).select(*K, "ts", "value")
    table.merge(base.where("ts < '2024-01-20'"))
    table.merge(_raised(base).where("ts >= '2024-01-18'"))
    return table.read().withColumn("first_rows", F.lit(table.read(version=0).count()))


def upsert_live(s: SparkSession, d: str) -> DataFrame:
    base = Q.panel(s, d).select(*K, "ts", "value", "observed")
    known = base.where("ts < '2024-01-20'").withColumn("value", F.when(F.col("observed") == 1, F.col("value")))
    return L.upsert_live(_raised(base), known)


add("stream_panels", lambda s, d: _landed(_arriving(s, Q.raw(s, d)), "panels"), select(Q.RAW, "SELECT * FROM raw"), "ts", "value")
# bins come out once they lie two hours behind the newest reading
add("stream_resample", lambda s, d: _landed(L.stream_resample(_arriving(s, Q.raw(s, d))), "bins"), select(Q.HOURLY, "SELECT * FROM means WHERE ts <= (SELECT date_trunc('milliseconds', max(ts) - INTERVAL 1 MICROSECOND) - INTERVAL 2 HOUR FROM raw)"), "ts", "value")
SESSIONS = Q.SYSTEM + """, hit AS (SELECT panel_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY panel_id ORDER BY ts) < INTERVAL 90 MINUTE THEN 0 ELSE 1 END AS new FROM scores WHERE anomaly_flag = 1),
run AS (SELECT panel_id, ts, sum(new) OVER (PARTITION BY panel_id ORDER BY ts) AS k FROM hit), sessions AS (SELECT panel_id, min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS points FROM run GROUP BY panel_id, k)"""
add("stream_regions", stream_regions, select(SESSIONS, "SELECT * FROM sessions WHERE end_ts + INTERVAL 90 MINUTE <= (SELECT max(ts) - INTERVAL 2 HOUR FROM hit)"), "start_ts end_ts")
add("stream_score", stream_score, select(Q.FIXED, "SELECT panel_id, channel, ts, pred FROM fx WHERE channel <> 'error'"), "ts", "pred")
FLAGGED = Q.FIXED + """, fs AS (SELECT panel_id, ts, CASE WHEN count(value - pred) = count(*) THEN pow(sum(pow(abs(value - pred), 4)), 0.25) END AS score FROM fx WHERE channel <> 'error' GROUP BY panel_id, ts),
ft AS (SELECT panel_id, quantile_cont(score, 0.99) AS threshold, quantile_cont(score, 0.01) AS q_low FROM fs WHERE score IS NOT NULL GROUP BY panel_id)"""
add("stream_flags", stream_flags, select(FLAGGED, "SELECT fs.panel_id, ts, score, threshold, CAST(coalesce(score >= threshold, false) AS INTEGER) AS flag, CASE WHEN threshold > q_low THEN least(greatest((score - q_low) / (threshold - q_low), 0), 1) END AS normalized FROM fs JOIN ft ON fs.panel_id = ft.panel_id WHERE ts <= (SELECT max(ts) - INTERVAL 2 HOUR FROM panel)"), "ts", "score threshold normalized")
add("live_versions", live_versions, select(Q.PANEL, "SELECT panel_id, channel, ts, CASE WHEN ts < TIMESTAMP '2024-01-20' THEN value ELSE value + 1 END AS value, (SELECT count(*) FROM panel WHERE ts < TIMESTAMP '2024-01-20') AS first_rows FROM panel"), "ts", "value")
add("upsert_live", upsert_live, select(Q.PANEL, "SELECT panel_id, channel, ts, CASE WHEN ts < TIMESTAMP '2024-01-20' AND observed = 1 THEN value ELSE value + 1 END AS value, observed FROM panel"), "ts", "value")
add("live_table", lambda s, d: _followed(s, Q.hourly(s, d)), select(Q.HOURLY, "SELECT * FROM hourly"), "ts", "value")
add("stream_freshness", lambda s, d: L.stream_freshness(_followed(s, Q.hourly(s, d)), F.expr(Q.NOW)))
Q.ORACLES["stream_freshness"] = Q.ORACLES["freshness"]
add("stream_alerts", lambda s, d: L.stream_alerts(Q.system_scores(s, d).where("anomaly_flag = 1"), Q.panel(s, d)).select("panel_id", "ts", "anomaly_score"), select(Q.SYSTEM, "SELECT panel_id, ts, anomaly_score FROM scores WHERE anomaly_flag = 1 QUALIFY ts = max(ts) OVER (PARTITION BY panel_id)"), "ts", "anomaly_score")
add("choose_live_base", lambda s, d: L.choose_live_base(Q.panel(s, d).where("panel_id = '0' OR ts < '2024-01-20'").select(*K, "ts", "value"), _raised(Q.panel(s, d)).select(*K, "ts", "value")), select(Q.PANEL, "SELECT panel_id, channel, ts, CASE WHEN panel_id = '0' THEN value ELSE value + 1 END AS value FROM panel"), "ts", "value")
GAP = "panel_id = '0' AND ts >= TIMESTAMP '2024-01-10 00:00:00' AND ts < TIMESTAMP '2024-01-10 06:00:00'"
add("repair_gaps", lambda s, d: L.repair_gaps(Q.panel(s, d).where(f"NOT ({GAP})").select(*K, "ts", "value"), _raised(Q.panel(s, d)).select(*K, "ts", "value")), select(Q.PANEL, f"SELECT panel_id, channel, ts, CASE WHEN panel_id IN (SELECT panel_id FROM panel WHERE {GAP}) THEN value + 1 ELSE value END AS value FROM panel"), "ts", "value")
add("ensure_min_history", lambda s, d: L.ensure_min_history(Q.panel(s, d).where("panel_id = '0' OR ts >= '2024-01-28'").select(*K, "ts", "value"), _raised(Q.panel(s, d)).select(*K, "ts", "value"), 200), select(Q.PANEL + ", few AS (SELECT panel_id FROM panel GROUP BY panel_id HAVING count(DISTINCT ts) FILTER (panel_id = '0' OR ts >= TIMESTAMP '2024-01-28') < 200)", "SELECT panel_id, channel, ts, value + 1 AS value FROM panel WHERE panel_id IN (SELECT panel_id FROM few) UNION ALL SELECT panel_id, channel, ts, value FROM panel WHERE panel_id NOT IN (SELECT panel_id FROM few) AND (panel_id = '0' OR ts >= TIMESTAMP '2024-01-28')"), "ts", "value")
add("source_status", lambda s, d: L.source_status(Q.hourly(s, d), "panel").unionByName(L.source_status(Q.hourly(s, d).where("value IS NULL"), "holes")).select("source", "status"), select(Q.HOURLY, "SELECT 'panel' AS source, CASE WHEN count(value) = 0 THEN 'degraded' ELSE 'ok' END AS status FROM hourly UNION ALL SELECT 'holes', CASE WHEN count(value) FILTER (value IS NULL) = 0 THEN 'degraded' ELSE 'ok' END FROM hourly"))


# ------------------------------------------------------------------ round trips
def models_stored(s: SparkSession, d: str) -> DataFrame:
    path = _path(s, "models")
    T.save_models(Q.fixed_models(s, d), path, "20240101_000000")
    T.save_models(Q.fixed_models(s, d).where("panel_id = '0'"), path, "20240301_000000")
    return T.latest_model(s.read.parquet(path)).select(*K, "model", F.col("version").cast("string").alias("version"), F.get("coef", F.lit(0)).alias("first_coef"), "intercept")


def results_stored(s: SparkSession, d: str) -> DataFrame:
    path, told = _path(s, "results"), Q.system_scores(s, d)
    scores = told.select("panel_id", "ts", "anomaly_score", "anomaly_score_normalized", "anomaly_threshold", "anomaly_flag")
    T.save_results(scores, Q.contributed(s, d), path, "live")
    return T.read_results(s, path).drop("run")


def eval_stored(s: SparkSession, d: str) -> DataFrame:
    path = _path(s, "eval")
    T.save_eval(_metric(s, d).select(*K, "metric"), path)
    return s.read.schema("panel_id string, channel string, metric double").option("header", True).csv(path)


def exog_stored(s: SparkSession, d: str) -> DataFrame:
    path = _path(s, "exog")
    T.write_exog(Q.views(s, d), path)
    return T.read_exog(s, path)


def tuning_stored(s: SparkSession, d: str) -> DataFrame:
    path = _path(s, "tuning")
    T.save_tuning(_metric(s, d).select(*K, "metric"), path)
    return s.read.schema("channel string, metric double, panel_id string").json(path)


def status_stored(s: SparkSession, d: str) -> DataFrame:
    path = _path(s, "status")
    T.save_status(A.freshness(Q.hourly(s, d), F.expr(Q.NOW)).select("panel_id", "status", "trailing_missing"), path)
    return s.read.schema("panel_id string, status string, trailing_missing long").json(path)


MAE = "SELECT panel_id, channel, avg(abs(value - pred)) AS metric FROM whole GROUP BY ALL"
add("save_models", models_stored, select(Q.RAW, "SELECT panel_id, channel, 'fixed' AS model, CASE WHEN panel_id = '0' THEN '20240301_000000' ELSE '20240101_000000' END AS version, 0.5 AS first_coef, 10.0 AS intercept FROM (SELECT DISTINCT panel_id, channel FROM raw WHERE channel <> 'error')"), "", "first_coef intercept")
add("save_results", results_stored, select(Q.SYSTEM, "SELECT panel_id, ts, anomaly_score, anomaly_score_normalized, anomaly_threshold, anomaly_flag FROM scores"), "ts", "anomaly_score anomaly_score_normalized anomaly_threshold")
add("save_eval", eval_stored, select(Q.NAIVE, MAE), "", "metric")
add("write_exog", exog_stored, select(Q.RAW + Q.VIEWS, "SELECT * FROM views"), "ts", "load")
add("save_tuning", tuning_stored, select(Q.NAIVE, MAE), "", "metric")
add("save_status", status_stored, "SELECT panel_id, status, trailing_missing FROM (" + Q.ORACLES["freshness"] + ") f")
