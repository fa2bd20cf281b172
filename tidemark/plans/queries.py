"""The registered queries: every operator over the given tables, with its SQL.

The panel: events as panel_id = user_id modulo 2, channel = event_type, hourly means. Timestamps come
out as text and doubles rounded to six places, on both sides, so that results compare by value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import aggregates as A
from ..operators import filters as B
from ..operators import imputation as I
from ..operators import joins as J
from ..operators import models as M
from ..operators import ranking as R
from ..operators import scoring as C
from ..operators import windows as W
from ..operators.panel import K, settled, wide
from ..sources import tables as T
from . import detect as D
from . import process as P
from . import tune as U

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Moves decimal ties off the half, so that both engines round them alike.
NUDGE = 1.7e-8
TIME = "%Y-%m-%d %H:%M:%S"


def shown(df: DataFrame) -> DataFrame:
    """Timestamps as text, doubles to six places (-0 as 0)."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind.startswith("timestamp"):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif kind == "double":
            c = F.round(c + F.lit(NUDGE), 6) + F.lit(0.0)
        out.append(c.alias(name))
    return df.select(*out)


def add(name: str, f: Callable[[SparkSession, str], DataFrame], sql: str | None = None, ts: str = "", num: str = "") -> None:
    """Registers a query and its SQL; ``ts`` and ``num`` name the SQL's time and double columns."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        _settled.clear()  # each query computes its own inputs
        return shown(f(spark, folder))

    QUERIES[name] = run
    if sql:
        replace = [f"strftime({c}, '{TIME}') AS {c}" for c in ts.split()] + [f"round({c} + {NUDGE}, 6) + 0.0 AS {c}" for c in num.split()]
        with_, _, body = sql.rpartition("--main")
        ORACLES[name] = f"{with_}SELECT * {'REPLACE (' + ', '.join(replace) + ')' if replace else ''} FROM ({body}) q"


#: Settled inputs of the query that is being built.
_settled: dict[tuple[str, str], DataFrame] = {}


def once(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """An input that a query computes once and settles, however often it names it."""

    def run(s: SparkSession, d: str) -> DataFrame:
        if (f.__name__, d) not in _settled:
            _settled[f.__name__, d] = settled(f(s, d), f.__name__)
        return _settled[f.__name__, d]

    return run


# ------------------------------------------------------------------ inputs, Spark
def raw(s: SparkSession, d: str) -> DataFrame:
    return T.events_panel(s, d)


def hourly(s: SparkSession, d: str) -> DataFrame:
    return W.resample_mean(raw(s, d), 3600)


@once
def panel(s: SparkSession, d: str) -> DataFrame:
    return I.impute(hourly(s, d))


def intervals(s: SparkSession) -> DataFrame:
    return s.sql("SELECT 0 AS window_id, timestamp'2024-01-10 00:00:00' AS start_ts, timestamp'2024-01-10 23:00:00' AS end_ts UNION ALL SELECT 1, timestamp'2024-01-20 06:00:00', timestamp'2024-01-20 18:00:00' UNION ALL SELECT 2, timestamp'2024-01-25 00:00:00', timestamp'2024-01-24 00:00:00'")


def bounds(s: SparkSession) -> DataFrame:
    return s.sql("SELECT * FROM VALUES ('0', 'click', 10.0D, 90.0D), ('1', 'click', 5.0D, NULL), ('0', 'view', NULL, 60.0D), ('1', 'error', 8.0D, 70.0D) t(panel_id, channel, lower, upper)")


def groups(s: SparkSession) -> DataFrame:
    return s.sql("SELECT * FROM VALUES ('0', 'web', 'click', CAST(NULL AS DOUBLE)), ('0', 'web', 'view', NULL), ('0', 'money', 'purchase', 0.95D), ('0', 'money', 'signup', 0.95D), ('0', 'money', 'absent', 0.95D), ('9', 'none', 'click', NULL) t(panel_id, `group`, channel, quantile)")


def views(s: SparkSession, d: str) -> DataFrame:
    """The external series: hourly mean of all views."""
    r = raw(s, d).where("channel = 'view'")
    return r.groupBy(S.ceil_to(F.col("ts"), 3600).alias("ts")).agg(F.avg("value").alias("load"))


@once
def naive(s: SparkSession, d: str) -> DataFrame:
    return M.predict_naive(panel(s, d))


def whole(s: SparkSession, d: str) -> DataFrame:
    """Naive predictions where there is one."""
    return naive(s, d).where("pred is not null")


@once
def system_scores(s: SparkSession, d: str) -> DataFrame:
    """Scores of every row, thresholds on all of them."""
    return C.combine_groups(D.score_told(naive(s, d)))


def group_scores(s: SparkSession, d: str) -> DataFrame:
    return D.score_told(naive(s, d), groups(s))


@once
def regions(s: SparkSession, d: str) -> DataFrame:
    return W.anomaly_regions(system_scores(s, d))


def contributed(s: SparkSession, d: str) -> DataFrame:
    return C.contributions(whole(s, d), system_scores(s, d))


def scored_rows(s: SparkSession, d: str) -> DataFrame:
    return whole(s, d).join(system_scores(s, d), ["panel_id", "ts"])


# ------------------------------------------------------------------ inputs, SQL
RAW = """WITH RECURSIVE raw AS (SELECT CAST(user_id % 2 AS VARCHAR) AS panel_id, event_type AS channel, CAST(ts AS TIMESTAMP) AS ts, value FROM events)"""
HOURLY = RAW + """, lab AS (SELECT panel_id, channel, CASE WHEN ts = date_trunc('hour', ts) THEN ts ELSE date_trunc('hour', ts) + INTERVAL 1 HOUR END AS ts, value FROM raw),
means AS (SELECT panel_id, channel, ts, avg(value) AS value FROM lab GROUP BY ALL),
span AS (SELECT panel_id, min(ts) AS lo, max(ts) AS hi FROM lab GROUP BY panel_id),
grid AS (SELECT panel_id, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS ts FROM span),
chan AS (SELECT DISTINCT panel_id, channel FROM raw),
hourly AS (SELECT g.panel_id, c.channel, g.ts, m.value FROM grid g JOIN chan c ON g.panel_id = c.panel_id LEFT JOIN means m ON m.panel_id = g.panel_id AND m.channel = c.channel AND m.ts = g.ts)"""
CARRIED = HOURLY + """, carried AS (SELECT *, max(CASE WHEN value IS NOT NULL THEN ts END) OVER b AS pt, last_value(value IGNORE NULLS) OVER b AS pv,
 min(CASE WHEN value IS NOT NULL THEN ts END) OVER f AS nt, first_value(value IGNORE NULLS) OVER f AS nv FROM hourly
 WINDOW b AS (PARTITION BY panel_id, channel ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY panel_id, channel ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""
PANEL = CARRIED + """, panel AS (SELECT panel_id, channel, ts, coalesce(value, pv + (nv - pv) * (epoch_us(ts) - epoch_us(pt)) / nullif(epoch_us(nt) - epoch_us(pt), 0), pv, nv) AS value, CAST(value IS NOT NULL AS INTEGER) AS observed FROM carried)"""
NAIVE = PANEL + """, naive AS (SELECT *, lag(value) OVER (PARTITION BY panel_id, channel ORDER BY ts) AS pred FROM panel), whole AS (SELECT * FROM naive WHERE pred IS NOT NULL)"""
KNOWN = """, known AS (SELECT * FROM (VALUES (0, TIMESTAMP '2024-01-10 00:00:00', TIMESTAMP '2024-01-10 23:00:00'), (1, TIMESTAMP '2024-01-20 06:00:00', TIMESTAMP '2024-01-20 18:00:00')) t(window_id, start_ts, end_ts))"""
BOUNDS = """, bounds AS (SELECT * FROM (VALUES ('0', 'click', 10.0, 90.0), ('1', 'click', 5.0, NULL), ('0', 'view', NULL, 60.0), ('1', 'error', 8.0, 70.0)) t(panel_id, channel, lower, upper))"""
GROUPS = """, groups AS (SELECT * FROM (VALUES ('0', 'web', 'click', NULL), ('0', 'web', 'view', NULL), ('0', 'money', 'purchase', 0.95), ('0', 'money', 'signup', 0.95), ('0', 'money', 'absent', 0.95), ('9', 'none', 'click', NULL)) t(panel_id, grp, channel, quantile))"""
VIEWS = """, views AS (SELECT CASE WHEN ts = date_trunc('hour', ts) THEN ts ELSE date_trunc('hour', ts) + INTERVAL 1 HOUR END AS ts, avg(value) AS load FROM raw WHERE channel = 'view' GROUP BY 1)"""
SCORED = """, sc AS (SELECT panel_id, ts, pow(sum(pow(abs(value - pred), 4)), 0.25) AS score FROM whole GROUP BY panel_id, ts),
th AS (SELECT panel_id, quantile_cont(score, 0.99) AS threshold, quantile_cont(score, 0.01) AS q_low FROM sc GROUP BY panel_id),
scores AS (SELECT sc.panel_id, sc.ts, score AS anomaly_score, CASE WHEN threshold > q_low THEN least(greatest((score - q_low) / (threshold - q_low), 0), 1) END AS anomaly_score_normalized, threshold AS anomaly_threshold, CAST(score >= threshold AS INTEGER) AS anomaly_flag, 'system' AS winner FROM sc JOIN th ON sc.panel_id = th.panel_id)"""
SYSTEM = NAIVE + SCORED
GROUPED = NAIVE + GROUPS + """, mem AS (SELECT w.*, g.grp FROM whole w JOIN groups g ON w.panel_id = g.panel_id AND w.channel = g.channel UNION ALL SELECT w.*, 'system' FROM whole w WHERE w.panel_id NOT IN (SELECT g.panel_id FROM groups g JOIN chan c ON g.panel_id = c.panel_id AND g.channel = c.channel)),
gq AS (SELECT panel_id, grp, coalesce(max(quantile), CASE WHEN count(*) OVER (PARTITION BY panel_id) > 1 THEN 1 - (1 - 0.99) / count(*) OVER (PARTITION BY panel_id) ELSE 0.99 END) AS q FROM groups GROUP BY panel_id, grp),
gs AS (SELECT panel_id, grp, ts, pow(sum(pow(abs(value - pred), 4)), 0.25) AS score FROM mem GROUP BY ALL),
gr AS (SELECT s.*, coalesce(q.q, 0.99) AS q, row_number() OVER (PARTITION BY s.panel_id, s.grp ORDER BY score) - 1 AS rn, count(*) OVER (PARTITION BY s.panel_id, s.grp) AS n FROM gs s LEFT JOIN gq q ON s.panel_id = q.panel_id AND s.grp = q.grp),
gt AS (SELECT panel_id, grp, min(score) + (max(score) - min(score)) * (max(q) * (max(n) - 1) - floor(max(q) * (max(n) - 1))) AS threshold FROM gr WHERE rn = floor(q * (n - 1)) OR rn = ceil(q * (n - 1)) GROUP BY ALL),
gl AS (SELECT panel_id, grp, quantile_cont(score, 0.01) AS q_low FROM gs GROUP BY ALL),
gf AS (SELECT s.panel_id, s.grp, s.ts, score, threshold, CAST(score >= threshold AS INTEGER) AS flag, CASE WHEN threshold > q_low THEN least(greatest((score - q_low) / (threshold - q_low), 0), 1) END AS normalized FROM gs s JOIN gt t ON s.panel_id = t.panel_id AND s.grp = t.grp JOIN gl l ON s.panel_id = l.panel_id AND s.grp = l.grp)"""
REGIONS = SYSTEM + """, hits AS (SELECT panel_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY panel_id ORDER BY ts) <= INTERVAL 1 HOUR THEN 0 ELSE 1 END AS new FROM scores WHERE anomaly_flag = 1),
runs AS (SELECT panel_id, ts, sum(new) OVER (PARTITION BY panel_id ORDER BY ts) AS region_id FROM hits),
ends AS (SELECT panel_id, min(ts) AS lo, max(ts) AS hi FROM scores GROUP BY panel_id),
regions AS (SELECT r.panel_id, CAST(region_id AS BIGINT) AS region_id, greatest(min(r.ts) - INTERVAL 10 MINUTE, any_value(lo)) AS start_ts, least(max(r.ts) + INTERVAL 10 MINUTE, any_value(hi)) AS end_ts, count(*) AS points FROM runs r JOIN ends e ON r.panel_id = e.panel_id GROUP BY r.panel_id, region_id)"""
SHARES = """, st AS (SELECT panel_id, channel, coalesce(nullif(stddev_samp(value), 0), 1) AS sd FROM whole GROUP BY ALL),
dv AS (SELECT w.panel_id, w.channel, w.ts, pow((value - pred) / sd, 2) AS d FROM whole w JOIN st ON w.panel_id = st.panel_id AND w.channel = st.channel),
contributions AS (SELECT d.panel_id, d.channel, d.ts, d / nullif(sum(d) OVER (PARTITION BY d.panel_id, d.ts), 0) * s.anomaly_score AS contribution FROM dv d JOIN scores s ON d.panel_id = s.panel_id AND d.ts = s.ts)"""
SPLIT = PANEL + """, stamps AS (SELECT panel_id, ts, row_number() OVER (PARTITION BY panel_id ORDER BY ts) AS rn, count(*) OVER (PARTITION BY panel_id) AS n FROM (SELECT DISTINCT panel_id, ts FROM panel)),
split AS (SELECT panel_id, ts, rn, n, CASE WHEN rn <= floor(n * 80 / 100.0) THEN 'train' WHEN rn <= floor(n * 80 / 100.0) + floor(n * 10 / 100.0) THEN 'val' ELSE 'test' END AS split FROM stamps)"""
MAIN = " --main "
NOW = "timestamp'2024-02-01 00:00:00'"
HERE = "TIMESTAMP '2024-02-01 00:00:00'"


def select(cte: str, body: str) -> str:
    return cte + MAIN + body


# ------------------------------------------------------------------ windows
add("resample_mean", hourly, select(HOURLY, "SELECT * FROM hourly"), "ts", "value")
add("resample_ffill", lambda s, d: W.resample_ffill(hourly(s, d), 1800), select(CARRIED, "SELECT g.panel_id, c.channel, g.ts, c.pv AS value FROM (SELECT panel_id, unnest(generate_series(lo, hi, INTERVAL 30 MINUTE)) AS ts FROM span) g JOIN carried c ON c.panel_id = g.panel_id AND c.ts = date_trunc('hour', g.ts)"), "ts", "value")
add("difference", lambda s, d: W.difference(panel(s, d), 2).select(*K, "ts", "delta"), select(PANEL, "SELECT panel_id, channel, ts, value - 2 * lag(value) OVER w + lag(value, 2) OVER w AS delta FROM panel QUALIFY lag(ts, 2) OVER w IS NOT NULL WINDOW w AS (PARTITION BY panel_id, channel ORDER BY ts)".replace("QUALIFY lag(ts, 2) OVER w IS NOT NULL WINDOW w AS (PARTITION BY panel_id, channel ORDER BY ts)", "WINDOW w AS (PARTITION BY panel_id, channel ORDER BY ts) QUALIFY lag(ts, 2) OVER w IS NOT NULL")), "ts", "delta")
add("integrate", lambda s, d: W.integrate(panel(s, d).withColumn("pred", F.lit(0.5))).select(*K, "ts", "pred"), select(NAIVE, "SELECT panel_id, channel, ts, 0.5 + pred AS pred FROM naive"), "ts", "pred")
add("lag_features", lambda s, d: W.lag_features(panel(s, d), [1, 3, 24]).select(*K, "ts", *[F.col("lags")[i].alias(f"lag{k}") for i, k in enumerate((1, 3, 24))]), select(PANEL, "SELECT * FROM (SELECT panel_id, channel, ts, lag(value) OVER w AS lag1, lag(value, 3) OVER w AS lag3, lag(value, 24) OVER w AS lag24 FROM panel WINDOW w AS (PARTITION BY panel_id, channel ORDER BY ts)) WHERE lag24 IS NOT NULL"), "ts", "lag1 lag3 lag24")
add("strict_mask", lambda s, d: W.strict_mask(panel(s, d), 3).select(*K, "ts", "usable"), select(PANEL, "SELECT panel_id, channel, ts, min(observed) OVER w = 1 AND count(*) OVER w = 4 AS usable FROM panel WINDOW w AS (PARTITION BY panel_id, channel ORDER BY ts ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)"), "ts")
add("rolling_baseline", lambda s, d: W.rolling_baseline(hourly(s, d), 2).select(*K, "ts", "baseline"), select(HOURLY, "SELECT panel_id, channel, ts, coalesce(avg(value) OVER (PARTITION BY panel_id, channel ORDER BY ts RANGE BETWEEN INTERVAL '47 hours 59 minutes 59.999999 seconds' PRECEDING AND CURRENT ROW), avg(value) OVER (PARTITION BY panel_id, channel)) AS baseline FROM hourly"), "ts", "baseline")
add("ffill", lambda s, d: W.ffill(hourly(s, d)), select(CARRIED, "SELECT panel_id, channel, ts, pv AS value FROM carried"), "ts", "value")
add("bfill", lambda s, d: W.bfill(hourly(s, d)), select(CARRIED, "SELECT panel_id, channel, ts, nv AS value FROM carried"), "ts", "value")
add("interpolate_time", lambda s, d: W.interpolate_time(hourly(s, d)), select(PANEL, "SELECT panel_id, channel, ts, value FROM panel"), "ts", "value")
GAPS = ", gaps AS (SELECT panel_id, channel, min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS length FROM carried WHERE value IS NULL GROUP BY panel_id, channel, pt, nt)"
add("missing_gaps", lambda s, d: W.missing_gaps(hourly(s, d)), select(CARRIED + GAPS, "SELECT * FROM gaps"), "start_ts end_ts")
TIMEGAPS = ", tg AS (SELECT panel_id, lag(ts) OVER (PARTITION BY panel_id ORDER BY ts) AS start_ts, ts AS end_ts FROM (SELECT DISTINCT panel_id, ts FROM raw)), timegaps AS (SELECT * FROM tg WHERE end_ts - start_ts > INTERVAL 10 MINUTE)"
add("time_gaps", lambda s, d: W.time_gaps(raw(s, d), 600), select(RAW + TIMEGAPS, "SELECT * FROM timegaps"), "start_ts end_ts")
add("anomaly_regions", regions, select(REGIONS, "SELECT * FROM regions"), "start_ts end_ts")
add("median_filter", lambda s, d: W.median_filter(panel(s, d).select(*K, "ts", "value"), 3, "click"), select(PANEL, "SELECT panel_id, channel, ts, CASE WHEN contains(channel, 'click') THEN list_sort([lag(value, 1, 0.0) OVER w, value, lead(value, 1, 0.0) OVER w])[2] ELSE value END AS value FROM panel WINDOW w AS (PARTITION BY panel_id, channel ORDER BY ts)"), "ts", "value")
add("dilate", lambda s, d: W.dilate(hourly(s, d).withColumn("flag", F.coalesce(F.col("value") > 80, F.lit(False)).cast("int")), 2).select(*K, "ts", "flag"), select(HOURLY, "SELECT panel_id, channel, ts, max(CAST(coalesce(value > 80, false) AS INTEGER)) OVER (PARTITION BY panel_id, channel ORDER BY ts ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS flag FROM hourly"), "ts")
add("observed_flag", lambda s, d: W.observed_flag(hourly(s, d)).select(*K, "ts", "observed"), select(PANEL, "SELECT panel_id, channel, ts, observed FROM panel"), "ts")
add("subsequence_distance", lambda s, d: W.subsequence_distance(panel(s, d), [10.0, 20.0, 30.0]), select(PANEL, "SELECT panel_id, channel, ts, sqrt(pow(value - 10, 2) + pow(b - 20, 2) + pow(c - 30, 2)) AS distance FROM (SELECT *, lead(value) OVER w AS b, lead(value, 2) OVER w AS c FROM panel WINDOW w AS (PARTITION BY panel_id, channel ORDER BY ts)) WHERE c IS NOT NULL"), "ts", "distance")
add("chronological_split", lambda s, d: W.chronological_split(panel(s, d)).select(*K, "ts", "rn", "n", "split"), select(SPLIT, "SELECT p.panel_id, p.channel, p.ts, rn, n, split FROM panel p JOIN split s ON p.panel_id = s.panel_id AND p.ts = s.ts"), "ts")
add("eval_window", lambda s, d: W.eval_window(panel(s, d), 50, "2024-01-20 12:00:00").select(*K, "ts"), select(PANEL, "SELECT p.panel_id, p.channel, p.ts FROM panel p JOIN (SELECT panel_id, ts FROM (SELECT DISTINCT panel_id, ts FROM panel WHERE ts <= TIMESTAMP '2024-01-20 12:00:00') QUALIFY row_number() OVER (PARTITION BY panel_id ORDER BY ts DESC) <= 50) e ON p.panel_id = e.panel_id AND p.ts = e.ts"), "ts")
WINDOW = PANEL + ", b AS (SELECT panel_id, count(DISTINCT ts) AS n, count(DISTINCT ts) - 60 AS start, count(DISTINCT ts) AS \"end\" FROM panel GROUP BY panel_id)"
add("adjust_window", lambda s, d: W.adjust_window(panel(s, d).groupBy("panel_id").agg(F.count_distinct("ts").alias("n")).selectExpr("panel_id", "n", "n - 60 AS start", "n AS end"), 400), select(WINDOW, "SELECT *, CASE WHEN problem IS NULL THEN a END AS window_start, CASE WHEN problem IS NULL THEN n END AS window_end FROM (SELECT *, CASE WHEN n < 801 AND n < 200 THEN 'too short' END AS problem, greatest(100, n - greatest(100, n - greatest(100, CAST(floor(n * 0.6) AS BIGINT)))) AS a FROM b)").replace("SELECT *, CASE WHEN problem IS NULL THEN a", "SELECT panel_id, n, start, \"end\", problem, CASE WHEN problem IS NULL THEN a"))
add("unseen_split", lambda s, d: W.unseen_split(panel(s, d), D.no_bounds(panel(s, d)).withColumn("train_end", F.when(F.col("panel_id") == "0", F.lit("2024-01-21 00:00:00").cast("timestamp")))).select(*K, "ts", "unseen"), select(SPLIT, "SELECT p.panel_id, p.channel, p.ts, CASE WHEN p.panel_id = '0' THEN p.ts > TIMESTAMP '2024-01-21 00:00:00' ELSE split = 'test' END AS unseen FROM panel p JOIN split s ON p.panel_id = s.panel_id AND p.ts = s.ts"), "ts")
add("residual_windows", lambda s, d: W.residual_windows(B.residuals(whole(s, d)), 3).select("panel_id", "ts", "channels", F.aggregate("vector", F.lit(0.0), lambda a, x: a + x).alias("total")), select(NAIVE, "SELECT panel_id, ts, CAST(count(*) AS INTEGER) AS channels, sum(r + a + b) AS total FROM (SELECT panel_id, ts, value - pred AS r, lag(value - pred) OVER w AS a, lag(value - pred, 2) OVER w AS b FROM whole WINDOW w AS (PARTITION BY panel_id, channel ORDER BY ts)) WHERE b IS NOT NULL GROUP BY panel_id, ts"), "ts", "total")
add("recent_points", lambda s, d: W.recent_points(system_scores(s, d)).select("panel_id", "ts", "anomaly_score", "anomaly_flag"), select(SYSTEM, "SELECT panel_id, ts, anomaly_score, anomaly_flag FROM scores QUALIFY row_number() OVER (PARTITION BY panel_id ORDER BY ts DESC) <= 12"), "ts", "anomaly_score")


# ------------------------------------------------------------------ filters
HIT = "EXISTS (SELECT 1 FROM known k WHERE p.ts BETWEEN k.start_ts - INTERVAL {0} SECOND AND k.end_ts + INTERVAL {0} SECOND)"
add("classify_channels", lambda s, d: B.classify_channels(J.asof_join(hourly(s, d), views(s, d), ["load"]).withColumn("channel", F.concat(F.when(F.col("channel") == "view", "exogenous_").otherwise(""), "channel", F.when(F.col("channel") == "error", "__weight").otherwise(""))), ["click"], multipliers=["sign"]), select(RAW, "SELECT panel_id, CASE channel WHEN 'view' THEN 'exogenous_view' WHEN 'error' THEN 'error__weight' ELSE channel END AS channel, CASE channel WHEN 'error' THEN 'weight' WHEN 'signup' THEN 'multiplier' WHEN 'purchase' THEN 'target' ELSE 'exog' END AS role, CASE channel WHEN 'click' THEN 0 ELSE 1 END AS ordinal FROM (SELECT DISTINCT panel_id, channel FROM raw)"))
add("multiplier_channel", lambda s, d: B.multiplier_channel(raw(s, d), ["pur", "sign"]), select(RAW, "SELECT panel_id, min(channel) AS multiplier FROM raw WHERE starts_with(channel, 'pur') OR starts_with(channel, 'sign') GROUP BY panel_id"))
add("mask_bounds", lambda s, d: B.mask_bounds(raw(s, d), bounds(s)), select(RAW + BOUNDS, "SELECT r.panel_id, r.channel, ts, CASE WHEN value < lower OR value > upper THEN NULL ELSE value END AS value FROM raw r LEFT JOIN bounds b ON r.panel_id = b.panel_id AND r.channel = b.channel"), "ts", "value")
add("mask_maintenance", lambda s, d: B.mask_maintenance(hourly(s, d).withColumn("value", F.when(F.col("channel") == "error", (F.col("value") > 60).cast("double")).otherwise(F.col("value"))), "error"), select(HOURLY, "SELECT h.panel_id, h.channel, h.ts, CASE WHEN coalesce(f.value > 60, true) THEN NULL ELSE h.value END AS value FROM hourly h LEFT JOIN hourly f ON f.channel = 'error' AND f.panel_id = h.panel_id AND f.ts = h.ts WHERE h.channel <> 'error'"), "ts", "value")
add("mask_intervals", lambda s, d: B.mask_intervals(hourly(s, d), intervals(s), 3600, ["click", "view"]), select(HOURLY + KNOWN, f"SELECT panel_id, channel, ts, CASE WHEN channel IN ('click', 'view') AND {HIT.format(3600)} THEN NULL ELSE value END AS value FROM hourly p"), "ts", "value")
add("filter_intervals", lambda s, d: B.filter_intervals(raw(s, d), intervals(s), 1800), select(RAW + KNOWN, f"SELECT * FROM raw p WHERE {HIT.format(1800)}"), "ts", "value")
add("filter_intervals_per_window", lambda s, d: B.filter_intervals(raw(s, d), intervals(s).where("start_ts <= end_ts"), 1800, True).select(*K, "ts", "value", "start_ts"), select(RAW + KNOWN, "SELECT p.*, k.start_ts FROM raw p JOIN known k ON p.ts BETWEEN k.start_ts - INTERVAL 30 MINUTE AND k.end_ts + INTERVAL 30 MINUTE"), "ts start_ts", "value")
add("in_interval", lambda s, d: B.in_interval(hourly(s, d), intervals(s)).select(*K, "ts", "in_known"), select(HOURLY + KNOWN, f"SELECT panel_id, channel, ts, {HIT.format(0)} AS in_known FROM hourly p"), "ts")
add("drop_imputed_rows", lambda s, d: B.drop_imputed_rows(panel(s, d)), select(PANEL, "SELECT * FROM panel WHERE (panel_id, ts) IN (SELECT (panel_id, ts) FROM panel GROUP BY panel_id, ts HAVING min(observed) = 1)"), "ts", "value")
SPIKED = HOURLY + ", spiked AS (SELECT panel_id, channel, ts, CASE WHEN value > 97 THEN CAST('Infinity' AS DOUBLE) WHEN value < 2 THEN CAST('-Infinity' AS DOUBLE) ELSE value END AS value FROM hourly)"


def spiked(s: SparkSession, d: str) -> DataFrame:
    """The hourly means with the largest and smallest made infinite."""
    value = F.when(F.col("value") > 97, float("inf")).when(F.col("value") < 2, float("-inf")).otherwise(F.col("value"))
    return hourly(s, d).withColumn("value", value)


add("drop_invalid_fit_rows", lambda s, d: B.drop_invalid_fit_rows(M.predict_naive(spiked(s, d))).select(*K, "ts"), select(SPIKED, "SELECT panel_id, channel, ts FROM (SELECT *, min(CAST(coalesce(isfinite(value) AND isfinite(pred), false) AS INTEGER)) OVER (PARTITION BY panel_id, ts) AS good FROM (SELECT *, lag(value) OVER (PARTITION BY panel_id, channel ORDER BY ts) AS pred FROM spiked)) WHERE good = 1"), "ts")
add("validate_inputs", lambda s, d: B.validate_inputs(M.predict_naive(spiked(s, d))), select(SPIKED, "SELECT count(*) FILTER (value IS NULL) AS value_missing, count(*) FILTER (isinf(value)) AS value_infinite, count(*) FILTER (pred IS NULL) AS pred_missing, count(*) FILTER (isinf(pred)) AS pred_infinite FROM (SELECT *, lag(value) OVER (PARTITION BY panel_id, channel ORDER BY ts) AS pred FROM spiked)"))
add("lookback", lambda s, d: B.lookback(raw(s, d), 3), select(RAW, "SELECT r.* FROM raw r JOIN (SELECT panel_id, max(ts) AS m FROM raw GROUP BY panel_id) x ON r.panel_id = x.panel_id WHERE r.ts >= m - INTERVAL 3 DAY"), "ts", "value")
add("select_series", lambda s, d: B.select_series(raw(s, d), ["1"], ["click", "absent"]), select(RAW, "SELECT * FROM raw WHERE panel_id = '1' AND channel = 'click'"), "ts", "value")
add("unknown_channels", lambda s, d: B.unknown_channels(raw(s, d), ["click", "absent"]), select(RAW, "SELECT c AS channel FROM (VALUES ('click'), ('absent')) t(c) WHERE c NOT IN (SELECT channel FROM raw)"))
add("to_zone", lambda s, d: B.to_zone(raw(s, d), "Asia/Tokyo"), select(RAW, "SELECT panel_id, channel, ts + INTERVAL 9 HOUR AS ts, value FROM raw"), "ts", "value")
add("adjust_by_baseline", lambda s, d: B.adjust_by_baseline(hourly(s, d), "click", "view"), select(HOURLY, "SELECT h.panel_id, h.channel, h.ts, CASE WHEN h.channel = 'click' THEN h.value - v.value ELSE h.value END AS value FROM hourly h LEFT JOIN hourly v ON v.channel = 'view' AND v.panel_id = h.panel_id AND v.ts = h.ts WHERE h.channel <> 'view'"), "ts", "value")
add("average_channels", lambda s, d: B.average_channels(hourly(s, d), "i", "temperature"), select(HOURLY, "SELECT panel_id, 'temperature' AS channel, ts, avg(value) AS value FROM hourly WHERE contains(channel, 'i') GROUP BY panel_id, ts UNION ALL SELECT * FROM hourly WHERE NOT contains(channel, 'i')"), "ts", "value")
add("residuals", lambda s, d: B.residuals(whole(s, d)).select(*K, "ts", "residual", "abs_residual", "squared_residual"), select(NAIVE, "SELECT panel_id, channel, ts, value - pred AS residual, abs(value - pred) AS abs_residual, pow(value - pred, 2) AS squared_residual FROM whole"), "ts", "residual abs_residual squared_residual")
add("apply_multiplier", lambda s, d: B.apply_multiplier(whole(s, d), views(s, d).crossJoin(F.broadcast(raw(s, d).select("panel_id").distinct())).withColumnRenamed("load", "multiplier")).select(*K, "ts", "value", "pred"), select(NAIVE + VIEWS, "SELECT panel_id, channel, w.ts, value * load AS value, pred * load AS pred FROM whole w JOIN views v ON w.ts = v.ts"), "ts", "value pred")
add("shift_time", lambda s, d: B.shift_time(raw(s, d), 86400 * 7), select(RAW, "SELECT panel_id, channel, ts + INTERVAL 7 DAY AS ts, value FROM raw"), "ts", "value")
add("prediction_range", lambda s, d: B.prediction_range(naive(s, d), 12), select(NAIVE, "SELECT panel_id, min(ts) - INTERVAL 12 HOUR AS start_ts, max(ts) + INTERVAL 12 HOUR AS end_ts FROM whole GROUP BY panel_id"), "start_ts end_ts")
add("label_channels", lambda s, d: B.label_channels(raw(s, d), s.sql("SELECT * FROM VALUES ('view', 'n/h'), ('i', 'x'), ('click', 'c/h') t(pattern, unit)")), select(RAW, "SELECT panel_id, channel, channel AS source, CASE channel WHEN 'view' THEN 'n/h' WHEN 'click' THEN 'c/h' WHEN 'signup' THEN 'x' ELSE '' END AS unit FROM (SELECT DISTINCT panel_id, channel FROM raw)"))
add("nan_only_panels", lambda s, d: B.nan_only_panels(hourly(s, d).withColumn("value", F.when(F.col("panel_id") == "0", F.col("value")))), select(RAW, "SELECT DISTINCT panel_id FROM raw WHERE panel_id <> '0'"))
add("no_data_intervals", lambda s, d: B.no_data_intervals(A.freshness(hourly(s, d), F.expr(NOW)).select("panel_id", "latest_ts"), F.expr(NOW)), select(HOURLY, f"SELECT panel_id, hi AS start_ts, {HERE} AS end_ts, CASE WHEN h >= 24 THEN (h // 24) || ' d ' || (h % 24) || ' h' ELSE h || ' h' END AS gap FROM (SELECT *, date_diff('hour', hi, {HERE}) AS h FROM span) WHERE h > 1"), "start_ts end_ts")
add("sanitize", lambda s, d: s.read.parquet(f"{d}/nation.parquet").select("n_nationkey", S.sanitize(F.concat(F.lit("(a) "), "n_name", F.lit(" %"))).alias("name")), "--main SELECT n_nationkey, 'a_' || regexp_replace(n_name, '[^A-Za-z0-9_]+', '_', 'g') AS name FROM nation")

# ------------------------------------------------------------------ joins
add("asof_join", lambda s, d: J.asof_join(raw(s, d), views(s, d), ["load"]), select(RAW + VIEWS, "SELECT r.*, v.load FROM raw r ASOF LEFT JOIN views v ON r.ts >= v.ts"), "ts", "value load")
add("join_sources", lambda s, d: J.join_sources(hourly(s, d), {"grid": views(s, d), "off": None, "bad": views(s, d).drop("ts")})[0], select(HOURLY + VIEWS, "SELECT r.*, v.load AS exogenous_grid_load FROM hourly r ASOF LEFT JOIN views v ON r.ts >= v.ts"), "ts", "value exogenous_grid_load")
add("align", lambda s, d: J.align(system_scores(s, d).select("panel_id", "ts", "anomaly_score"), whole(s, d).where("channel = 'click'").select("panel_id", "ts", "pred"), hourly(s, d).where("channel = 'click' and value is not null").select("panel_id", "ts", "value")), select(SYSTEM, "SELECT s.panel_id, s.ts, s.anomaly_score, w.pred, h.value FROM scores s JOIN whole w ON s.panel_id = w.panel_id AND s.ts = w.ts AND w.channel = 'click' JOIN hourly h ON h.panel_id = s.panel_id AND h.ts = s.ts AND h.channel = 'click' AND h.value IS NOT NULL"), "ts", "anomaly_score pred value")
add("merge_results", lambda s, d: J.merge_results(panel(s, d).select(*K, "ts", "value"), system_scores(s, d).select("panel_id", "ts", "anomaly_flag"), system_scores(s, d).select("panel_id", "ts", "anomaly_score"), whole(s, d).select(*K, "ts", "pred")).withColumn("anomaly_flag", F.coalesce("anomaly_flag", F.lit(-1))), select(SYSTEM, "SELECT p.panel_id, p.channel, p.ts, p.value, coalesce(s.anomaly_flag, -1) AS anomaly_flag, s.anomaly_score, w.pred FROM panel p LEFT JOIN scores s ON p.panel_id = s.panel_id AND p.ts = s.ts LEFT JOIN whole w ON w.panel_id = p.panel_id AND w.channel = p.channel AND w.ts = p.ts"), "ts", "value anomaly_score pred")
add("combine_first", lambda s, d: J.combine_first(hourly(s, d).where("ts < '2024-01-20'"), panel(s, d).where("ts > '2024-01-10'"), [*K, "ts"]).withColumn("observed", F.coalesce("observed", F.lit(-1))), select(PANEL, "SELECT coalesce(o.panel_id, n.panel_id) AS panel_id, coalesce(o.channel, n.channel) AS channel, coalesce(o.ts, n.ts) AS ts, coalesce(o.value, n.value) AS value, coalesce(n.observed, -1) AS observed FROM (SELECT * FROM hourly WHERE ts < TIMESTAMP '2024-01-20') o FULL JOIN (SELECT * FROM panel WHERE ts > TIMESTAMP '2024-01-10') n ON o.panel_id = n.panel_id AND o.channel = n.channel AND o.ts = n.ts"), "ts", "value")
add("stitch_history", lambda s, d: J.stitch_history(hourly(s, d).where("ts < '2024-01-20'"), panel(s, d).where("ts > '2024-01-18'").select(*K, "ts", "value")), select(PANEL, "SELECT panel_id, channel, ts, value, false AS recent FROM hourly WHERE ts <= TIMESTAMP '2024-01-18' UNION ALL SELECT panel_id, channel, ts, value, true FROM panel WHERE ts > TIMESTAMP '2024-01-18'"), "ts", "value")
add("join_regions", lambda s, d: J.join_regions(whole(s, d), regions(s, d)).select(*K, "ts", "region_id"), select(REGIONS, "SELECT w.panel_id, w.channel, w.ts, r.region_id FROM whole w JOIN regions r ON w.panel_id = r.panel_id AND w.ts BETWEEN r.start_ts AND r.end_ts"), "ts")
add("classify_gaps", lambda s, d: J.classify_gaps(W.time_gaps(raw(s, d), 600), W.time_gaps(raw(s, d).where("channel <> 'error'"), 1200)), select(RAW + TIMEGAPS + ", ref AS (SELECT * FROM (SELECT panel_id, lag(ts) OVER (PARTITION BY panel_id ORDER BY ts) AS start_ts, ts AS end_ts FROM (SELECT DISTINCT panel_id, ts FROM raw WHERE channel <> 'error')) WHERE end_ts - start_ts > INTERVAL 20 MINUTE)", "SELECT g.*, CASE WHEN EXISTS (SELECT 1 FROM ref r WHERE r.panel_id = g.panel_id AND abs(epoch_us(r.start_ts) - epoch_us(g.start_ts)) < 3600000000 AND abs(epoch_us(r.end_ts) - epoch_us(g.end_ts)) < 3600000000) THEN 'natural' ELSE 'fixable' END AS kind FROM timegaps g"), "start_ts end_ts")
PROFILE = ", prof AS (SELECT channel, CAST(hour(ts) AS INTEGER) AS hour, avg(value) AS mean FROM hourly GROUP BY ALL)"
add("join_profile", lambda s, d: J.join_profile(hourly(s, d), A.hourly_profile(hourly(s, d)).where("hour < 20")).select(*K, "ts", "expected"), select(HOURLY + PROFILE, "SELECT h.panel_id, h.channel, h.ts, coalesce(p.mean, a.mean) AS expected FROM hourly h LEFT JOIN prof p ON p.hour < 20 AND p.channel = h.channel AND p.hour = hour(h.ts) LEFT JOIN (SELECT channel, avg(mean) AS mean FROM prof WHERE hour < 20 GROUP BY channel) a ON a.channel = h.channel"), "ts", "expected")
add("values_at_flags", lambda s, d: J.values_at_flags(panel(s, d), whole(s, d), system_scores(s, d)), select(SYSTEM, "SELECT p.panel_id, p.channel, p.ts, p.value, w.pred FROM panel p JOIN scores s ON s.panel_id = p.panel_id AND s.ts = p.ts AND s.anomaly_flag = 1 LEFT JOIN whole w ON w.panel_id = p.panel_id AND w.channel = p.channel AND w.ts = p.ts"), "ts", "value pred")
add("strategy_grid", lambda s, d: J.strategy_grid(raw(s, d).select("panel_id").distinct(), s.sql("SELECT explode(array(2, 3)) AS k"), s.sql("SELECT explode(array(1, 6)) AS w")), select(RAW, "SELECT panel_id, k, w FROM (SELECT DISTINCT panel_id FROM raw), (VALUES (2), (3)) a(k), (VALUES (1), (6)) b(w)"))
add("assign_groups", lambda s, d: J.assign_groups(whole(s, d), groups(s)).select(*K, "ts", F.col("group").alias("grp")), select(GROUPED, "SELECT panel_id, channel, ts, grp FROM mem"), "ts")
add("missing_group_channels", lambda s, d: J.missing_group_channels(raw(s, d), groups(s)).withColumnRenamed("group", "grp"), select(RAW + GROUPS, "SELECT g.panel_id, g.grp, g.channel FROM groups g WHERE NOT EXISTS (SELECT 1 FROM raw r WHERE r.panel_id = g.panel_id AND r.channel = g.channel)"))
add("compare_overlap", lambda s, d: J.compare_overlap(raw(s, d).where("channel <> 'error'"), hourly(s, d)), select(HOURLY, "SELECT x.* FROM (SELECT panel_id, channel, ts, value, 'raw' AS stage FROM raw UNION ALL SELECT *, 'processed' FROM hourly) x JOIN (SELECT s.panel_id, greatest(lo, a) AS a, least(hi, b) AS b FROM span s JOIN (SELECT panel_id, min(ts) AS a, max(ts) AS b FROM raw WHERE channel <> 'error' GROUP BY panel_id) r ON s.panel_id = r.panel_id) l ON l.panel_id = x.panel_id AND x.ts BETWEEN l.a AND l.b WHERE channel <> 'error'"), "ts", "value")

# ------------------------------------------------------------------ aggregates
add("eval_metrics", lambda s, d: A.eval_metrics(whole(s, d)), select(NAIVE, "SELECT panel_id, channel, sqrt(avg(CASE WHEN observed = 1 THEN pow(value - pred, 2) END)) AS rmse, avg(CASE WHEN observed = 1 THEN abs(value - pred) END) AS mae, count(CASE WHEN observed = 1 THEN 1 END) AS n FROM whole GROUP BY ALL"), "", "rmse mae")
add("forecast_metrics", lambda s, d: A.forecast_metrics(naive(s, d)), select(NAIVE, "SELECT panel_id, channel, avg(abs(value - pred)) AS mae, sqrt(avg(pow(value - pred, 2))) AS rmse, avg(abs((value - pred) / (value + 1e-10))) * 100 AS mape, count(*) AS n FROM whole GROUP BY ALL"), "", "mae rmse mape")
ERRORS = "SELECT panel_id, channel, '{0}' AS span, avg(abs(value - pred)) AS mae, sqrt(avg(pow(value - pred, 2))) AS rmse, count(value - pred) AS n, count(*) - count(value - pred) AS n_nan FROM rows {1} GROUP BY ALL"
add("channel_errors", lambda s, d: A.channel_errors(W.chronological_split(M.predict_naive(hourly(s, d)), 80, 10, 10)), select(SPLIT + ", hn AS (SELECT *, lag(value) OVER (PARTITION BY panel_id, channel ORDER BY ts) AS pred FROM hourly), rows AS (SELECT h.*, split FROM hn h JOIN split s ON h.panel_id = s.panel_id AND h.ts = s.ts)", ERRORS.format("full", "") + " UNION ALL " + ERRORS.format("test", "WHERE split = 'test'")), "", "mae rmse")
add("score_summary", lambda s, d: A.score_summary(system_scores(s, d)), select(SYSTEM, "SELECT panel_id, count(*) AS n, CAST(sum(anomaly_flag) AS BIGINT) AS flags, avg(anomaly_flag) AS rate, " + ", ".join(f"min({c}) AS {n}_min, max({c}) AS {n}_max, avg({c}) AS {n}_mean, stddev_samp({c}) AS {n}_std, quantile_cont({c}, 0.25) AS {n}_p25, quantile_cont({c}, 0.5) AS {n}_median, quantile_cont({c}, 0.75) AS {n}_p75, quantile_cont({c}, 0.95) AS {n}_p95, quantile_cont({c}, 0.99) AS {n}_p99" for c, n in (("anomaly_score", "score"), ("anomaly_score_normalized", "normalized"))) + " FROM scores GROUP BY panel_id"), "", "rate " + " ".join(f"{n}_{k}" for n in ("score", "normalized") for k in ("min", "max", "mean", "std", "p25", "median", "p75", "p95", "p99")))
add("feature_errors", lambda s, d: A.feature_errors(whole(s, d)), select(NAIVE, "SELECT *, row_number() OVER (PARTITION BY panel_id ORDER BY mean_abs_residual DESC, channel) AS place FROM (SELECT panel_id, channel, avg(abs(value - pred)) AS mean_abs_residual, sqrt(avg(pow(value - pred, 2))) AS rmse FROM whole GROUP BY ALL)"), "", "mean_abs_residual rmse")
SR = SYSTEM + ", sr AS (SELECT w.*, s.anomaly_score FROM whole w JOIN scores s ON w.panel_id = s.panel_id AND w.ts = s.ts)"
add("residual_score_corr", lambda s, d: A.residual_score_corr(scored_rows(s, d)), select(SR, "SELECT panel_id, channel, corr(abs(value - pred), anomaly_score) AS corr FROM sr GROUP BY ALL"), "", "corr")
add("high_score_contrast", lambda s, d: A.high_score_contrast(scored_rows(s, d)), select(SR + ", cut AS (SELECT panel_id, quantile_cont(anomaly_score, 0.95) AS c FROM scores GROUP BY panel_id)", "SELECT *, high - normal AS contrast FROM (SELECT sr.panel_id, channel, avg(CASE WHEN anomaly_score > c THEN abs(value - pred) END) AS high, avg(CASE WHEN NOT anomaly_score > c THEN abs(value - pred) END) AS normal FROM sr JOIN cut ON sr.panel_id = cut.panel_id GROUP BY sr.panel_id, channel)"), "", "high normal contrast")
add("score_attribution", lambda s, d: A.score_attribution(scored_rows(s, d)), select(SR, "SELECT panel_id, channel, avg(share * anomaly_score) AS attribution FROM (SELECT *, pow(value - pred, 2) / nullif(sum(pow(value - pred, 2)) OVER (PARTITION BY panel_id, ts), 0) AS share FROM sr) GROUP BY ALL"), "", "attribution")
add("group_flag_summary", lambda s, d: A.group_flag_summary(group_scores(s, d)).withColumnRenamed("group", "grp"), select(GROUPED, "SELECT panel_id, grp, count(*) AS rows, CAST(sum(flag) AS BIGINT) AS flags, avg(flag) AS rate, max(threshold) AS threshold FROM gf GROUP BY ALL"), "", "rate threshold")
add("known_window_eval", lambda s, d: A.known_window_eval(system_scores(s, d), intervals(s)), select(SYSTEM + KNOWN, f"SELECT *, flags_in / nullif(flags_in + flags_out, 0) AS precision FROM (SELECT panel_id, count(*) FILTER (anomaly_flag = 1 AND k) AS flags_in, count(*) FILTER (anomaly_flag = 1 AND NOT k) AS flags_out, count(*) FILTER (k) AS known_points FROM (SELECT *, {HIT.format(0)} AS k FROM scores p) GROUP BY panel_id)"), "", "precision")
add("outlier_summary", lambda s, d: A.outlier_summary(raw(s, d), bounds(s)), select(RAW + BOUNDS, "SELECT *, removed / nullif(total, 0) * 100 AS pct FROM (SELECT r.panel_id, r.channel, lower, upper, count(value) AS total, count(*) FILTER (value < lower OR value > upper) AS removed, min(value) FILTER (value < lower OR value > upper) AS min_removed, max(value) FILTER (value < lower OR value > upper) AS max_removed FROM raw r JOIN bounds b ON r.panel_id = b.panel_id AND r.channel = b.channel GROUP BY ALL)"), "", "lower upper min_removed max_removed pct")


def board(s: SparkSession, d: str) -> DataFrame:
    """(channel, model, score): mean absolute errors of three predictions."""
    w = Window.partitionBy(*K).orderBy("ts")
    rows = whole(s, d).withColumns({"two": F.lag("value", 2).over(w), "zero": F.lit(0.0)})
    return rows.groupBy("channel").agg(*[F.avg(F.abs(F.col("value") - F.col(c))).alias(n) for c, n in (("pred", "last"), ("two", "older"), ("zero", "none"))]).unpivot("channel", ["last", "older", "none"], "model", "score")


BOARD = NAIVE + ", bw AS (SELECT *, lag(value, 2) OVER (PARTITION BY panel_id, channel ORDER BY ts) AS two FROM whole), bd AS (SELECT channel, avg(abs(value - pred)) AS last, avg(abs(value - two)) AS older, avg(abs(value)) AS none FROM bw GROUP BY channel), board AS (SELECT channel, 'last' AS model, last AS score FROM bd UNION ALL SELECT channel, 'older', older FROM bd UNION ALL SELECT channel, 'none', none FROM bd), won AS (SELECT *, least(last, older, none) AS winner_score FROM bd), led AS (SELECT *, CASE WHEN winner_score = last THEN 'last' WHEN winner_score = none THEN 'none' ELSE 'older' END AS winner FROM won)"
add("leaderboard", lambda s, d: A.leaderboard(board(s, d), ["last", "older", "none"]), select(BOARD, "SELECT * FROM led"), "", "last older none winner_score")
add("leaderboard_z", lambda s, d: A.leaderboard_z(board(s, d)), select(BOARD, "SELECT channel, model, (score - avg(score) OVER w) / nullif(stddev_samp(score) OVER w, 0) AS z FROM board WINDOW w AS (PARTITION BY channel)"), "", "z")
add("winner_share", lambda s, d: A.winner_share(A.leaderboard(board(s, d), ["last", "older", "none"])), select(BOARD, "SELECT winner, count(*) AS n, count(*) / sum(count(*)) OVER () AS share FROM led GROUP BY winner"), "", "share")
add("hourly_profile", lambda s, d: A.hourly_profile(hourly(s, d)), select(HOURLY + PROFILE, "SELECT * FROM prof"), "", "mean")
MAD = ", md AS (SELECT panel_id, channel, median(value) AS median FROM hourly GROUP BY ALL)"
add("median_mad", lambda s, d: A.median_mad(hourly(s, d)), select(HOURLY + MAD, "SELECT h.panel_id, h.channel, any_value(median) AS median, CASE WHEN median(abs(value - median)) = 0 THEN 1e-12 ELSE median(abs(value - median)) END AS mad FROM hourly h JOIN md ON h.panel_id = md.panel_id AND h.channel = md.channel GROUP BY ALL"), "", "median mad")
add("freshness", lambda s, d: A.freshness(hourly(s, d), F.expr(NOW)), select(HOURLY + ", seen AS (SELECT panel_id, ts, count(value) AS k FROM hourly GROUP BY ALL), ends AS (SELECT panel_id, max(ts) AS latest_ts, max(ts) FILTER (k > 0) AS last_valid_ts FROM seen GROUP BY panel_id)", f"SELECT *, CASE WHEN age_seconds > 3600 OR trailing_missing >= 12 THEN 'degraded' ELSE 'ok' END AS status FROM (SELECT e.panel_id, latest_ts, last_valid_ts, count(*) FILTER (s.ts > last_valid_ts) AS trailing_missing, (epoch_us({HERE}) - epoch_us(last_valid_ts)) / 1000000.0 AS age_seconds, count(*) FILTER (s.ts > last_valid_ts) * 3600 AS trailing_seconds FROM seen s JOIN ends e ON s.panel_id = e.panel_id GROUP BY ALL)"), "latest_ts last_valid_ts", "age_seconds")


def model_versions(s: SparkSession, d: str) -> DataFrame:
    return raw(s, d).select("panel_id", "channel").distinct().crossJoin(s.sql("SELECT explode(array('20240110_000000', '20240125_120000', '20240130_000000')) AS version")).where("panel_id = '0' OR version < '20240130'")


VERSIONS = ", mv AS (SELECT panel_id, channel, version FROM (SELECT DISTINCT panel_id, channel FROM raw), (VALUES ('20240110_000000'), ('20240125_120000'), ('20240130_000000')) v(version) WHERE panel_id = '0' OR version < '20240130')"
add("readiness", lambda s, d: A.readiness(raw(s, d).select("panel_id").distinct(), raw(s, d), model_versions(s, d), F.expr(NOW), 5), select(RAW + VERSIONS, f"SELECT data_ready, models_ready, data_ready AND models_ready AS ready FROM (SELECT bool_and(m > {HERE} - INTERVAL 5 DAY) AS data_ready, bool_and(coalesce(strptime(v, '%Y%m%d_%H%M%S') > {HERE} - INTERVAL 5 DAY, false)) AS models_ready FROM (SELECT panel_id, max(ts) AS m FROM raw GROUP BY panel_id) a LEFT JOIN (SELECT panel_id, max(version) AS v FROM mv GROUP BY panel_id) b USING (panel_id))"))


def strategies(s: SparkSession, d: str) -> DataFrame:
    told = naive(s, d)
    return C.combine_groups(D.score_told(told)).withColumn("strategy", F.lit("norm4")).unionByName(C.combine_groups(D.score_told(told, q=0.95, order=2.0)).withColumn("strategy", F.lit("norm2")))


STRAT = SYSTEM + """, sc2 AS (SELECT panel_id, ts, sqrt(sum(pow(value - pred, 2))) AS score FROM whole GROUP BY panel_id, ts),
th2 AS (SELECT panel_id, quantile_cont(score, 0.95) AS threshold, quantile_cont(score, 0.01) AS q_low FROM sc2 GROUP BY panel_id),
strat AS (SELECT panel_id, ts, 'norm4' AS strategy, anomaly_score, anomaly_score_normalized, anomaly_flag FROM scores UNION ALL
SELECT s.panel_id, ts, 'norm2', score, CASE WHEN threshold > q_low THEN least(greatest((score - q_low) / (threshold - q_low), 0), 1) END, CAST(score >= threshold AS INTEGER) FROM sc2 s JOIN th2 t ON s.panel_id = t.panel_id)"""
add("strategy_table", lambda s, d: A.strategy_table(strategies(s, d)), select(STRAT, "SELECT panel_id, strategy, count(*) AS rows, CAST(sum(anomaly_flag) AS BIGINT) AS flags, avg(anomaly_flag) AS rate, avg(anomaly_score) AS score_mean, quantile_cont(anomaly_score, 0.95) AS score_q95, quantile_cont(anomaly_score, 0.99) AS score_q99, avg(anomaly_score_normalized) AS normalized_mean FROM strat GROUP BY ALL"), "", "rate score_mean score_q95 score_q99 normalized_mean")
add("split_bounds", lambda s, d: A.split_bounds(W.chronological_split(panel(s, d))), select(SPLIT, "SELECT panel_id, count(*) AS n, count(*) FILTER (split = 'train') AS n_train, count(*) FILTER (split = 'val') AS n_val, count(*) FILTER (split = 'test') AS n_test, max(ts) FILTER (split = 'train') AS train_end, max(ts) FILTER (split = 'val') AS val_end, min(ts) FILTER (split = 'test') AS test_start FROM split GROUP BY panel_id"), "train_end val_end test_start")
add("r2", lambda s, d: A.r2(whole(s, d)), select(NAIVE, "SELECT panel_id, channel, 1 - sum(pow(value - pred, 2)) / nullif(var_pop(value) * count(*), 0) AS r2 FROM whole GROUP BY ALL"), "", "r2")
CONTRIB = REGIONS + SHARES
add("contributions", lambda s, d: contributed(s, d), select(SYSTEM + SHARES, "SELECT * FROM contributions"), "ts", "contribution")
add("region_contributions", lambda s, d: A.region_contributions(contributed(s, d), regions(s, d)), select(CONTRIB, "SELECT c.panel_id, region_id, channel, avg(contribution) AS contribution FROM contributions c JOIN regions r ON c.panel_id = r.panel_id AND c.ts BETWEEN start_ts AND end_ts GROUP BY ALL"), "", "contribution")
add("suspicious_channels", lambda s, d: A.suspicious_channels(W.chronological_split(panel(s, d)).withColumn("value", F.when(F.col("channel") == "click", F.col("rn") - 1.0).otherwise(F.col("value")))), select(SPLIT, "SELECT p.panel_id, channel, 0.0 AS low, max(rn) - 1.0 AS high, count(*) AS n FROM panel p JOIN split s ON p.panel_id = s.panel_id AND p.ts = s.ts WHERE channel = 'click' GROUP BY ALL"), "", "low high")
add("snapshot_metadata", lambda s, d: A.snapshot_metadata(raw(s, d)), select(RAW, "SELECT panel_id, count(DISTINCT ts) AS rows, min(ts) AS start_ts, max(ts) AS end_ts FROM raw GROUP BY panel_id"), "start_ts end_ts")

# ------------------------------------------------------------------ ranking and sets
add("top_anomalies", lambda s, d: R.top_anomalies(system_scores(s, d)).select("panel_id", "ts", "anomaly_score", "place"), select(SYSTEM, "SELECT * FROM (SELECT panel_id, ts, anomaly_score, row_number() OVER (PARTITION BY panel_id ORDER BY anomaly_score DESC, ts) AS place FROM scores) WHERE place <= 5"), "ts", "anomaly_score")
add("top_features", lambda s, d: R.top_features(contributed(s, d)), select(SYSTEM + SHARES, "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY panel_id, ts ORDER BY contribution DESC NULLS LAST, channel) AS place FROM contributions) WHERE place <= 3"), "ts", "contribution")
add("event_contributions", lambda s, d: R.event_contributions(contributed(s, d), regions(s, d)).select("panel_id", "region_id", "start_ts", "end_ts", F.array_join(F.transform("features", lambda x: x["feature"]), ",").alias("channels"), F.get("features", F.lit(0))["contribution"].alias("largest")), select(CONTRIB + ", rc AS (SELECT c.panel_id, region_id, channel, avg(contribution) AS c FROM contributions c JOIN regions r ON c.panel_id = r.panel_id AND c.ts BETWEEN start_ts AND end_ts GROUP BY ALL)", "SELECT r.panel_id, r.region_id, r.start_ts, r.end_ts, string_agg(channel, ',' ORDER BY c DESC, channel) AS channels, max(c) AS largest FROM regions r LEFT JOIN rc ON rc.panel_id = r.panel_id AND rc.region_id = r.region_id GROUP BY ALL"), "start_ts end_ts", "largest")
add("current_status", lambda s, d: R.current_status(system_scores(s, d), panel(s, d)).withColumn("channels", F.array_join("channels", ",")), select(SYSTEM, "SELECT s.panel_id, s.ts, s.anomaly_flag, s.anomaly_score, (SELECT string_agg(channel, ',' ORDER BY value DESC NULLS FIRST, channel) FROM panel p WHERE p.panel_id = s.panel_id AND p.ts = s.ts) AS channels FROM scores s JOIN (SELECT panel_id, max(ts) AS m FROM scores GROUP BY panel_id) x ON s.panel_id = x.panel_id AND s.ts = x.m"), "ts", "anomaly_score")
add("best_model", lambda s, d: R.best_model(board(s, d).withColumns({"metric": F.col("score"), "trial": F.when(F.col("model") == "last", 0).when(F.col("model") == "none", 1).otherwise(2)})), select(BOARD, "SELECT channel, winner AS model, winner_score AS metric FROM led"), "", "metric")
add("common_timestamps", lambda s, d: R.common_timestamps(hourly(s, d).where("channel = 'click' and value is not null"), hourly(s, d).where("channel = 'view' and value is not null")), select(HOURLY, "SELECT panel_id, ts FROM hourly WHERE channel = 'click' AND value IS NOT NULL INTERSECT SELECT panel_id, ts FROM hourly WHERE channel = 'view' AND value IS NOT NULL"), "ts")
add("schema_diff", lambda s, d: R.schema_diff(raw(s, d).where("channel <> 'error'"), raw(s, d).where("channel <> 'view' or panel_id = '0'")), select(RAW, "SELECT * FROM ((SELECT DISTINCT panel_id, channel, 'live' AS side FROM raw WHERE channel <> 'error' EXCEPT SELECT panel_id, channel, 'live' FROM raw WHERE channel <> 'view' OR panel_id = '0') UNION ALL (SELECT DISTINCT panel_id, channel, 'baseline' FROM raw WHERE channel <> 'view' OR panel_id = '0' EXCEPT SELECT panel_id, channel, 'baseline' FROM raw WHERE channel <> 'error'))"))
add("union_first", lambda s, d: R.union_first(hourly(s, d).where("value > 50"), panel(s, d).select(*K, "ts", "value"), keys=[*K, "ts"]), select(PANEL, "SELECT panel_id, channel, ts, value FROM panel"), "ts", "value")

# ------------------------------------------------------------------ imputation
FILL = {
    "mean": "coalesce(value, CASE WHEN lag(value) OVER w IS NOT NULL AND lead(value) OVER w IS NOT NULL THEN (lag(value) OVER w + lead(value) OVER w) / 2 END)",
    "forward_fill": "coalesce(pv, nv)",
    "backward_fill": "coalesce(nv, pv)",
    "iterative": "coalesce(value, avg(value) OVER (PARTITION BY panel_id, channel))",
    "knn_sklearn": "coalesce(value, avg(value) OVER (PARTITION BY panel_id, channel))",
}
for name, expr in FILL.items():
    body = f"SELECT panel_id, channel, ts, {expr} AS value, CAST(value IS NOT NULL AS INTEGER) AS observed FROM carried WINDOW w AS (PARTITION BY panel_id, channel ORDER BY ts)"
    if name == "mean":
        body = f"SELECT panel_id, channel, ts, coalesce(value, avg(value) OVER (PARTITION BY panel_id, channel)) AS value, observed FROM ({body})"
    add(f"impute_{name}", lambda s, d, name=name: I.impute(hourly(s, d), name), select(CARRIED, body), "ts", "value")
add("impute_linear_interpolation", panel, select(PANEL, "SELECT * FROM panel"), "ts", "value")
# from left to right: a value may use those filled before it
SEASONAL = HOURLY + """, ser AS (SELECT panel_id, channel, list(value ORDER BY ts) AS v, list(ts ORDER BY ts) AS t, avg(value) AS mean FROM hourly GROUP BY panel_id, channel),
rec AS (SELECT panel_id, channel, 0 AS i, CAST([] AS DOUBLE[]) AS o, v FROM ser UNION ALL
 SELECT panel_id, channel, i + 1, list_append(o, coalesce(v[i + 1], (far + v[i + 25]) / 2, far, v[i + 25], (near + v[i + 2]) / 2, near, v[i + 2])), v FROM (SELECT *, CASE WHEN i >= 24 THEN o[i - 23] END AS far, CASE WHEN i >= 1 THEN o[i] END AS near FROM rec WHERE i < len(v)))"""
add("impute_seasonal", lambda s, d: I.impute(hourly(s, d), "seasonal", period=24), select(SEASONAL, "SELECT panel_id, channel, unnest(s.t) AS ts, coalesce(unnest(r.o), mean) AS value, CAST(unnest(s.v) IS NOT NULL AS INTEGER) AS observed FROM ser s JOIN rec r USING (panel_id, channel) WHERE r.i = len(s.v)"), "ts", "value")
for name, params in (("spline_interpolation", {}), ("knn_temporal", {"n_neighbors": 3}), ("rolling_mean", {"window": 5}), ("psm", {})):
    add(f"impute_{name}", lambda s, d, name=name, params=params: I.impute(hourly(s, d), name, **params))
add("impute_channels", lambda s, d: I.impute_channels(hourly(s, d), {"click": {"method": "forward_fill"}}), select(PANEL, "SELECT p.panel_id, p.channel, p.ts, CASE WHEN p.channel = 'click' THEN coalesce(pv, nv) ELSE p.value END AS value, observed FROM panel p JOIN carried c ON c.panel_id = p.panel_id AND c.channel = p.channel AND c.ts = p.ts"), "ts", "value")
add("impute_frame", lambda s, d: I.impute_frame(hourly(s, d), "backward_fill", ["view"]), select(CARRIED, "SELECT panel_id, channel, ts, CASE WHEN channel = 'view' THEN coalesce(nv, pv) ELSE value END AS value, CAST(value IS NOT NULL AS INTEGER) AS observed FROM carried"), "ts", "value")
BLANK = PANEL + KNOWN + f", blank AS (SELECT panel_id, channel, ts, CASE WHEN {HIT.format(3600)} THEN NULL ELSE value END AS value, observed FROM panel p)"
AGAIN = select(BLANK + ", bc AS (SELECT *, max(CASE WHEN value IS NOT NULL THEN ts END) OVER b AS pt, last_value(value IGNORE NULLS) OVER b AS pv, min(CASE WHEN value IS NOT NULL THEN ts END) OVER f AS nt, first_value(value IGNORE NULLS) OVER f AS nv FROM blank WINDOW b AS (PARTITION BY panel_id, channel ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY panel_id, channel ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))", "SELECT panel_id, channel, ts, coalesce(value, pv + (nv - pv) * (epoch_us(ts) - epoch_us(pt)) / nullif(epoch_us(nt) - epoch_us(pt), 0), pv, nv) AS value, CASE WHEN value IS NULL THEN 0 ELSE observed END AS observed FROM bc")
add("reimpute_known", lambda s, d: I.reimpute_known(panel(s, d), intervals(s), 3600), AGAIN, "ts", "value")


def filled(s: SparkSession, d: str) -> DataFrame:
    """Values of hour 5 blanked and filled by two methods, beside what they were."""
    told = hourly(s, d).where("value is not null").select(*K, "ts", F.col("value").alias("original"), (F.hour("ts") == 5).alias("injected"))
    holes = told.select(*K, "ts", F.when(~F.col("injected"), F.col("original")).alias("value"))
    one = lambda name: I.impute(holes, name).join(told, [*K, "ts"]).withColumn("method", F.lit(name))
    return one("iterative").unionByName(one("backward_fill"))


FILLED = HOURLY + """, hol AS (SELECT panel_id, channel, ts, value AS original, hour(ts) = 5 AS injected, CASE WHEN hour(ts) <> 5 THEN value END AS v FROM hourly WHERE value IS NOT NULL),
fl AS (SELECT *, avg(v) OVER (PARTITION BY panel_id, channel) AS m, first_value(v IGNORE NULLS) OVER (PARTITION BY panel_id, channel ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nv,
 last_value(v IGNORE NULLS) OVER (PARTITION BY panel_id, channel ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pv FROM hol),
al AS (SELECT 'iterative' AS method, *, coalesce(v, m) AS f FROM fl UNION ALL SELECT 'backward_fill', *, coalesce(v, nv, pv) FROM fl),
im AS (SELECT method, panel_id, channel, avg(abs(f - original)) AS mae, sqrt(avg(pow(f - original, 2))) AS rmse, avg(CASE WHEN abs(original) > 1e-10 THEN abs((f - original) / original) * 100 END) AS mape, count(*) AS n FROM al WHERE injected GROUP BY ALL)"""
add("imputation_metrics", lambda s, d: A.imputation_metrics(filled(s, d)), select(FILLED, "SELECT * FROM im"), "", "mae rmse mape")
add("summarize_methods", lambda s, d: A.summarize_methods(A.imputation_metrics(filled(s, d))), select(FILLED, "SELECT *, method = (SELECT method FROM im GROUP BY method ORDER BY avg(mae), method LIMIT 1) AS best FROM (SELECT method, avg(mae) AS mae_mean, stddev_samp(mae) AS mae_std, avg(rmse) AS rmse_mean, stddev_samp(rmse) AS rmse_std, avg(mape) AS mape_mean, stddev_samp(mape) AS mape_std, count(*) AS runs FROM im GROUP BY method)"), "", "mae_mean mae_std rmse_mean rmse_std mape_mean mape_std")
add("inject_gaps", lambda s, d: I.inject_gaps(hourly(s, d), 5, 10))
add("benchmark_imputation", lambda s, d: A.summarize_methods(I.benchmark_imputation(hourly(s, d), ["mean", "forward_fill", "linear_interpolation"])))

# ------------------------------------------------------------------ models
add("sample_weight", lambda s, d: M.sample_weight(panel(s, d), 3).select(*K, "ts", "weight"), select(PANEL, "SELECT panel_id, channel, ts, CAST(min(observed) OVER w = 1 AND count(*) OVER w = 4 AS DOUBLE) AS weight FROM panel WINDOW w AS (PARTITION BY panel_id, channel ORDER BY ts ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)"), "ts", "weight")
add("standardize", lambda s, d: M.standardize(panel(s, d)).select(*K, "ts", "z", "mu", "sigma"), select(PANEL, "SELECT panel_id, channel, ts, (value - avg(value) OVER w) / coalesce(nullif(stddev_pop(value) OVER w, 0), 1) AS z, avg(value) OVER w AS mu, coalesce(nullif(stddev_pop(value) OVER w, 0), 1) AS sigma FROM panel WINDOW w AS (PARTITION BY panel_id, channel)"), "ts", "z mu sigma")
add("fit_linear", lambda s, d: M.fit_linear(panel(s, d), "linear", 1).select(*K, F.col("coef")[0].alias("slope"), "intercept", "n"), select(NAIVE, "SELECT panel_id, channel, regr_slope(value, pred) AS slope, regr_intercept(value, pred) AS intercept, count(*) AS n FROM whole GROUP BY ALL"), "", "slope intercept")
add("fit_ridge", lambda s, d: M.fit_linear(panel(s, d), "ridge", 1, alpha=10.0).select(*K, F.col("coef")[0].alias("slope"), "intercept", "n"), select(NAIVE, "SELECT panel_id, channel, b AS slope, my - b * mx AS intercept, n FROM (SELECT panel_id, channel, covar_pop(value, pred) * count(*) / (var_pop(pred) * count(*) + 10 * var_pop(value)) AS b, avg(value) AS my, avg(pred) AS mx, count(*) AS n FROM whole GROUP BY ALL)"), "", "slope intercept")
for kind in ("lasso", "elasticnet", "bayesianridge"):
    add(f"fit_{kind}", lambda s, d, kind=kind: M.fit_linear(panel(s, d), kind, 3, alpha=0.01).select(*K, "model", "intercept", F.array_join(F.transform("coef", lambda c: F.round(c, 4).cast("string")), ",").alias("coef")))
add("train_trees", lambda s, d: M.train(panel(s, d), "trees", 6)[1])
add("train_kernel", lambda s, d: M.train(panel(s, d), "nystroem", 6)[1])
add("fit_huber", lambda s, d: M.fit_huber(panel(s, d), 2, rounds=2).select(*K, "model", "intercept"))
add("fit_trees", lambda s, d: A.forecast_metrics(M.fit_trees(panel(s, d))))
add("fit_nystroem", lambda s, d: A.forecast_metrics(M.fit_nystroem(panel(s, d), 3, 16)))
add("auto_clean", lambda s, d: M.auto_clean(panel(s, d), 3).select(*K, "ts", "cleaned"))
add("prepare_channels", lambda s, d: M.prepare_channels(panel(s, d), 6).select(*K).distinct(), select(PANEL, "SELECT panel_id, channel FROM panel GROUP BY ALL HAVING count(value) >= 16"))


def specs(s: SparkSession) -> DataFrame:
    return s.sql("SELECT * FROM VALUES (CAST(NULL AS STRING), CAST(NULL AS STRING), 'ridge', map('alpha', 1.0D), 6), ('0', NULL, 'lasso', map('alpha', 0.1D), CAST(NULL AS INT)), ('0', 'click', 'lasso', CAST(NULL AS MAP<STRING, DOUBLE>), 12), ('1', 'view', 'ridge', map('alpha', 5.0D), NULL) t(panel_id, channel, model, params, lags)")


SPECS = """, specs AS (SELECT * FROM (VALUES (NULL, NULL, 'ridge', 1.0, 6), ('0', NULL, 'lasso', 0.1, NULL), ('0', 'click', 'lasso', NULL, 12), ('1', 'view', 'ridge', 5.0, NULL)) t(panel_id, channel, model, alpha, lags)),
met AS (SELECT c.panel_id, c.channel, s.model, s.alpha, s.lags, CASE WHEN s.channel IS NOT NULL THEN 2 WHEN s.panel_id IS NOT NULL THEN 1 ELSE 0 END AS level FROM (SELECT DISTINCT panel_id, channel FROM raw) c JOIN specs s ON (s.panel_id IS NULL OR s.panel_id = c.panel_id) AND (s.channel IS NULL OR s.channel = c.channel)),
named AS (SELECT panel_id, channel, arg_max(model, level) AS model, arg_max(lags, level) FILTER (lags IS NOT NULL) AS lags FROM met GROUP BY panel_id, channel)"""
add("resolve_specs", lambda s, d: M.resolve_specs(raw(s, d), specs(s)).select(*K, "model", F.col("params")["alpha"].alias("alpha"), "lags"), select(RAW + SPECS, "SELECT n.panel_id, n.channel, n.model, arg_max(m.alpha, level) FILTER (m.model = n.model AND m.alpha IS NOT NULL) AS alpha, n.lags FROM named n JOIN met m ON m.panel_id = n.panel_id AND m.channel = n.channel GROUP BY n.panel_id, n.channel, n.model, n.lags"), "", "alpha")


def fixed_models(s: SparkSession, d: str) -> DataFrame:
    return raw(s, d).select(*K).distinct().where("channel <> 'error'").selectExpr("panel_id", "channel", "'fixed' AS model", "array(1, 3) AS lags", "array(0.5D, 0.25D) AS coef", "10.0D AS intercept")


FIXED = PANEL + ", fx AS (SELECT *, CASE WHEN channel <> 'error' THEN 10 + 0.5 * lag(value) OVER w + 0.25 * lag(value, 3) OVER w END AS pred FROM panel WINDOW w AS (PARTITION BY panel_id, channel ORDER BY ts))"
add("predict", lambda s, d: M.predict(panel(s, d), fixed_models(s, d)).select(*K, "ts", "pred"), select(FIXED, "SELECT panel_id, channel, ts, pred FROM fx"), "ts", "pred")
add("predict_naive", lambda s, d: naive(s, d).select(*K, "ts", "pred"), select(NAIVE, "SELECT panel_id, channel, ts, pred FROM naive"), "ts", "pred")
add("train", lambda s, d: M.train(panel(s, d), "ridge", 3)[1])

# ------------------------------------------------------------------ scoring and detection
add("score_norm", lambda s, d: C.score_norm(J.assign_groups(whole(s, d), groups(s))).withColumnRenamed("group", "grp"), select(GROUPED, "SELECT panel_id, grp, ts, score FROM gs"), "ts", "score")
add("group_quantiles", lambda s, d: C.group_quantiles(groups(s)).withColumnRenamed("group", "grp").join(raw(s, d).select("panel_id").distinct(), "panel_id"), select(RAW + GROUPS, "SELECT g.panel_id, g.grp, coalesce(max(quantile), 0.995) AS q FROM groups g WHERE g.panel_id IN (SELECT panel_id FROM raw) GROUP BY ALL"), "", "q")
add("fit_threshold", lambda s, d: C.fit_threshold(C.score_norm(J.assign_groups(whole(s, d), C.system_groups(raw(s, d))))).drop("group"), select(SYSTEM, "SELECT * FROM th"), "", "threshold q_low")
add("score_grouped", lambda s, d: group_scores(s, d).withColumnRenamed("group", "grp"), select(GROUPED, "SELECT * FROM gf"), "ts", "score threshold normalized")
add("combine_groups", lambda s, d: C.combine_groups(group_scores(s, d)), select(GROUPED, "SELECT panel_id, ts, first(score ORDER BY normalized DESC NULLS LAST, grp) AS anomaly_score, first(normalized ORDER BY normalized DESC NULLS LAST, grp) AS anomaly_score_normalized, first(threshold ORDER BY normalized DESC NULLS LAST, grp) AS anomaly_threshold, max(flag) AS anomaly_flag, first(grp ORDER BY normalized DESC NULLS LAST, grp) AS winner FROM gf GROUP BY panel_id, ts"), "ts", "anomaly_score anomaly_score_normalized anomaly_threshold")
add("group_details", lambda s, d: C.group_details(group_scores(s, d).where("panel_id = '0'"), ["money", "web"]).select("panel_id", "ts", "group_money_raw", "group_web_normalized", "group_web_flag"), select(GROUPED, "SELECT panel_id, ts, max(score) FILTER (grp = 'money') AS group_money_raw, max(normalized) FILTER (grp = 'web') AS group_web_normalized, max(flag) FILTER (grp = 'web') AS group_web_flag FROM gf WHERE panel_id = '0' GROUP BY panel_id, ts"), "ts", "group_money_raw group_web_normalized")
TRIM = NAIVE + ", te AS (SELECT panel_id, ts, avg(abs(value - pred)) AS e FROM whole GROUP BY ALL), tc AS (SELECT panel_id, quantile_cont(e, 0.9) AS c FROM te GROUP BY panel_id)"
add("trim_fit", lambda s, d: C.trim_fit(whole(s, d), 0.9).select(*K, "ts"), select(TRIM, "SELECT w.panel_id, w.channel, w.ts FROM whole w JOIN te ON te.panel_id = w.panel_id AND te.ts = w.ts JOIN tc ON tc.panel_id = w.panel_id WHERE e <= c"), "ts")
add("flag_overlap", lambda s, d: J.flag_overlap(*[C.combine_groups(D.score_told(naive(s, d), q=q, order=o)) for q, o in ((0.99, 4.0), (0.95, 2.0))]), select(STRAT + ", fo AS (SELECT a.panel_id, a.anomaly_flag AS x, b.anomaly_flag AS y, a.anomaly_score AS p, b.anomaly_score AS q FROM strat a JOIN strat b ON a.strategy = 'norm4' AND b.strategy = 'norm2' AND a.panel_id = b.panel_id AND a.ts = b.ts)", "SELECT panel_id, count(*) AS rows, CAST(sum(x) AS BIGINT) AS flags_a, CAST(sum(y) AS BIGINT) AS flags_b, CAST(sum(CAST(x = 1 AND y = 0 AS INTEGER)) AS BIGINT) AS only_a, CAST(sum(CAST(x = 0 AND y = 1 AS INTEGER)) AS BIGINT) AS only_b, CAST(sum(x * y) AS BIGINT) AS both, median(p) AS median_a, median(q) AS median_b, avg(x) AS rate_a, avg(y) AS rate_b, sum(x * y) / nullif(sum(greatest(x, y)), 0) AS jaccard FROM fo GROUP BY panel_id"), "", "median_a median_b rate_a rate_b jaccard")
DETECT = SPLIT + """, dn AS (SELECT *, lag(value) OVER (PARTITION BY panel_id, channel ORDER BY ts) AS pred FROM panel), un AS (SELECT d.* FROM dn d JOIN split s ON s.panel_id = d.panel_id AND s.ts = d.ts WHERE split = 'test'),
ew AS (SELECT panel_id, ts, row_number() OVER (PARTITION BY panel_id ORDER BY ts DESC) <= 24 AS ev FROM (SELECT DISTINCT panel_id, ts FROM un)),
ds AS (SELECT u.panel_id, u.ts, any_value(ev) AS ev, min(observed) AS o, pow(sum(pow(abs(value - pred), 4)), 0.25) AS score FROM un u JOIN ew e ON e.panel_id = u.panel_id AND e.ts = u.ts GROUP BY u.panel_id, u.ts),
dt AS (SELECT panel_id, quantile_cont(score, 0.9) AS threshold, quantile_cont(score, 0.01) AS q_low FROM ds WHERE NOT ev AND o = 1 GROUP BY panel_id)"""
add("detect", lambda s, d: C.combine_groups(D.detect(panel(s, d), None, D.no_bounds(raw(s, d)), hist=24, q=0.9)).drop("winner"), select(DETECT, "SELECT ds.panel_id, ts, score AS anomaly_score, CASE WHEN threshold > q_low THEN least(greatest((score - q_low) / (threshold - q_low), 0), 1) END AS anomaly_score_normalized, threshold AS anomaly_threshold, CAST(coalesce(score >= threshold, false) AS INTEGER) AS anomaly_flag FROM ds LEFT JOIN dt ON ds.panel_id = dt.panel_id WHERE ev"), "ts", "anomaly_score anomaly_score_normalized anomaly_threshold")
add("score_all", system_scores, select(SYSTEM, "SELECT * FROM scores"), "ts", "anomaly_score anomaly_score_normalized anomaly_threshold")
SCOPES = DETECT + ", whole AS (SELECT * FROM dn WHERE pred IS NOT NULL)" + SCORED
add("compare_scopes", lambda s, d: D.compare_scopes(D.detect(panel(s, d), None, D.no_bounds(raw(s, d)), hist=24, q=0.9), D.score_told(naive(s, d)))[1].withColumnRenamed("group", "grp"), select(SCOPES, "SELECT panel_id, 'system' AS grp, count(*) AS rows, CAST(sum(f) AS BIGINT) AS flags, avg(f) AS rate, max(threshold) AS threshold, 'unseen' AS scope FROM (SELECT ds.panel_id, CAST(coalesce(score >= threshold, false) AS INTEGER) AS f, threshold FROM ds LEFT JOIN dt ON ds.panel_id = dt.panel_id WHERE ev) GROUP BY panel_id UNION ALL SELECT panel_id, 'system', count(*), CAST(sum(anomaly_flag) AS BIGINT), avg(anomaly_flag), max(anomaly_threshold), 'all' FROM scores GROUP BY panel_id"), "", "rate threshold")
add("detect_observed", lambda s, d: C.combine_groups(D.detect(panel(s, d), None, D.no_bounds(raw(s, d)), hist=24, q=0.9, observed_only=True)).select("panel_id", "ts", "anomaly_score", "anomaly_flag"), select(DETECT, "SELECT ds.panel_id, ts, score AS anomaly_score, CAST(coalesce(score >= threshold, false) AS INTEGER) AS anomaly_flag FROM ds LEFT JOIN dt ON ds.panel_id = dt.panel_id WHERE ev AND o = 1"), "ts", "anomaly_score")
add("replay_known", lambda s, d: D.replay_known(panel(s, d), None, intervals(s).where("start_ts <= end_ts"), D.no_bounds(raw(s, d)), hist=24, q=0.9).select("panel_id", "window_id", "ts", "anomaly_score", "anomaly_flag"))


def vectors(s: SparkSession, d: str) -> DataFrame:
    rows = B.residuals(whole(s, d)).groupBy("panel_id", "ts").agg(F.sort_array(F.collect_list(F.struct("channel", "residual"))).alias("a"))
    return rows.select("panel_id", "ts", F.col("a.residual").alias("vector"))


def _learned(name: str, **options) -> Callable[[SparkSession, str], DataFrame]:
    def run(s: SparkSession, d: str) -> DataFrame:
        from ..operators import ml_scorers

        v = vectors(s, d)
        return getattr(ml_scorers, name)(v, v, **options)

    return run


add("score_kmeans", _learned("score_kmeans", k=3))
add("score_gmm", _learned("score_gmm", most=2))
add("score_iforest", _learned("score_iforest", trees=20))

# ------------------------------------------------------------------ search
SPACE = {"ridge": {"alpha": [0.01, 10.0, "log10"], "lags": [1, 3]}, "lasso": {"alpha": [0.001, 0.1, "log10"], "lags": [3]}}
BUDGETS = ", budgets AS (SELECT * FROM (VALUES (NULL, NULL, 10), ('0', NULL, 20), ('0', 'click', 30)) t(panel_id, channel, trials))"
add("trial_budget", lambda s, d: U.trial_budget(raw(s, d), s.sql("SELECT * FROM VALUES (CAST(NULL AS STRING), CAST(NULL AS STRING), 10), ('0', NULL, 20), ('0', 'click', 30) t(panel_id, channel, trials)")), select(RAW + BUDGETS, "SELECT c.panel_id, c.channel, arg_max(b.trials, CAST(b.panel_id IS NOT NULL AS INTEGER) + CAST(b.channel IS NOT NULL AS INTEGER)) AS trials FROM (SELECT DISTINCT panel_id, channel FROM raw) c JOIN budgets b ON (b.panel_id IS NULL OR b.panel_id = c.panel_id) AND (b.channel IS NULL OR b.channel = c.channel) GROUP BY c.panel_id, c.channel"))
add("one_step_fold", lambda s, d: U.one_step_fold(panel(s, d)).select(*K, "ts", "split"), select(PANEL + ", st AS (SELECT panel_id, ts, row_number() OVER (PARTITION BY panel_id ORDER BY ts) AS rn, count(*) OVER (PARTITION BY panel_id) AS n FROM (SELECT DISTINCT panel_id, ts FROM panel))", "SELECT p.panel_id, p.channel, p.ts, CASE WHEN rn <= floor(n * 60 / 100.0) THEN 'train' ELSE 'val' END AS split FROM panel p JOIN st ON st.panel_id = p.panel_id AND st.ts = p.ts WHERE rn <= floor(n * 60 / 100.0) + floor(n * 20 / 100.0)"), "ts")
for name, expr in (("mae", "avg(abs(value - pred))"), ("mse", "avg(pow(value - pred, 2))"), ("mape", "avg(abs((value - pred) / value))"), ("r2", "-(1 - sum(pow(value - pred, 2)) / nullif(var_pop(value) * count(*), 0))")):
    add(f"metric_{name}", lambda s, d, name=name: U.metric(whole(s, d), name), select(NAIVE, f"SELECT panel_id, channel, {expr} AS metric FROM whole GROUP BY ALL"), "", "metric")
add("tune", lambda s, d: U.tune(panel(s, d), U.expand_space(s, SPACE, 4)).select(*K, "model", "lags", "metric"))

# ------------------------------------------------------------------ sources
add("latest_model", lambda s, d: T.latest_model(model_versions(s, d)).select("panel_id", "channel", "version"), select(RAW + VERSIONS, "SELECT * FROM mv QUALIFY version = max(version) OVER (PARTITION BY panel_id)"))
add("latest_version", lambda s, d: T.latest_version(raw(s, d).withColumn("version", F.when(F.col("channel") == "click", "20240101_000000").when(F.col("channel") == "view", "20240301_120000").otherwise("notes"))), select(RAW, "SELECT *, '20240301_120000' AS version FROM raw WHERE channel = 'view'"), "ts", "value")
add("explode_hourly_json", lambda s, d: T.explode_hourly_json(_payloads(s, d), ["load", "absent"]).drop("absent"), select(RAW + VIEWS, "SELECT ts, load FROM views"), "ts", "load")


def _payloads(s: SparkSession, d: str) -> DataFrame:
    """One payload a day: {"hourly": {"time": [...], "load": [...]}}, and one that is an error."""
    rows = views(s, d).groupBy(F.date_trunc("day", "ts").alias("day")).agg(F.sort_array(F.collect_list(F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("t"), "load"))).alias("a"))
    return rows.select(F.to_json(F.struct(F.struct(F.col("a.t").alias("time"), F.col("a.load").alias("load")).alias("hourly"))).alias("payload")).unionByName(s.sql("SELECT '{\"error\": true, \"reason\": \"limit\"}' AS payload"))


add("shape_single_channel", lambda s, d: T.shape_single_channel(views(s, d).select("ts", F.lit("x").alias("Forecast"), F.col("load").cast("string").alias("Actual Load"))), select(RAW + VIEWS, "SELECT ts, load AS value FROM views"), "ts", "value")
add("upsert_channel_config", lambda s, d: T.upsert_channel_config(_config(s, d, "ridge").where("channel <> 'view'"), _config(s, d, "lasso").where("panel_id = '0'").withColumn("error", F.when(F.col("channel") == "click", "failed"))).select(*K, "model"), select(RAW, "SELECT panel_id, channel, CASE WHEN panel_id = '0' AND channel <> 'click' THEN 'lasso' ELSE 'ridge' END AS model FROM (SELECT DISTINCT panel_id, channel FROM raw) WHERE panel_id = '0' OR channel <> 'view'"))


def _config(s: SparkSession, d: str, model: str) -> DataFrame:
    return raw(s, d).select(*K).distinct().select(*K, F.lit(model).alias("model"), F.create_map(F.lit("alpha"), F.lit(1.0)).alias("params"))


add("detail_export", lambda s, d: T.detail_export(whole(s, d), strategies(s, d), ["click", "view"]).select("panel_id", "ts", "click_true", "view_abs_err", "mean_abs_err", "norm2_score", "norm4_flag"), select(STRAT, "SELECT w.panel_id, w.ts, max(value) FILTER (channel = 'click') AS click_true, max(abs(value - pred)) FILTER (channel = 'view') AS view_abs_err, avg(abs(value - pred)) AS mean_abs_err, any_value(a.anomaly_score) AS norm2_score, any_value(b.anomaly_flag) AS norm4_flag FROM whole w JOIN strat a ON a.strategy = 'norm2' AND a.panel_id = w.panel_id AND a.ts = w.ts JOIN strat b ON b.strategy = 'norm4' AND b.panel_id = w.panel_id AND b.ts = w.ts GROUP BY w.panel_id, w.ts"), "ts", "click_true view_abs_err mean_abs_err norm2_score")
START, END = "timestamp'2023-12-25 10:30:00'", "timestamp'2024-02-05 00:00:00'"
RANGES = ", rg AS (SELECT TIMESTAMP '2023-12-25 10:00:00' AS start_ts, min(ts) - INTERVAL 1 HOUR AS end_ts FROM views UNION ALL SELECT max(ts) + INTERVAL 1 HOUR, TIMESTAMP '2024-02-05 00:00:00' FROM views)"
add("missing_ranges", lambda s, d: T.missing_ranges(views(s, d), F.expr(START), F.expr(END)), select(RAW + VIEWS + RANGES, "SELECT * FROM rg"), "start_ts end_ts")
CUT = "timestamp'2024-02-02 00:00:00'"
add("split_range", lambda s, d: T.split_range(T.missing_ranges(views(s, d), F.expr(START), F.expr(END)), F.expr(CUT)), select(RAW + VIEWS + RANGES, "SELECT start_ts, least(end_ts, TIMESTAMP '2024-02-02') AS end_ts, 'archive' AS source FROM rg UNION ALL SELECT TIMESTAMP '2024-02-02 01:00:00', end_ts, 'forecast' FROM rg WHERE end_ts > TIMESTAMP '2024-02-02'"), "start_ts end_ts")
add("stitch", lambda s, d: T.stitch(views(s, d).where("ts < '2024-01-15'"), views(s, d).withColumn("load", F.col("load") + 1)), select(RAW + VIEWS, "SELECT ts, CASE WHEN ts < TIMESTAMP '2024-01-15' THEN load ELSE load + 1 END AS load FROM views"), "ts", "load")
add("cyclic_fallback", lambda s, d: T.cyclic_fallback(views(s, d).withColumnRenamed("load", "value"), F.expr("timestamp'2024-02-01 00:00:00'"), F.expr("timestamp'2024-02-03 00:00:00'")), select(RAW + VIEWS + ", tail AS (SELECT load, row_number() OVER (ORDER BY ts) - 1 AS i FROM (SELECT * FROM views ORDER BY ts DESC LIMIT 24))", "SELECT g.ts, load AS value, true AS synthetic FROM (SELECT unnest(generate_series(TIMESTAMP '2024-02-01', TIMESTAMP '2024-02-03', INTERVAL 1 HOUR)) AS ts) g JOIN tail ON i = date_diff('hour', TIMESTAMP '2024-02-01', g.ts) % 24"), "ts", "value")
add("fetch_window", lambda s, d: T.fetch_window(raw(s, d), F.expr(NOW)), select(RAW, "SELECT min(ts) AS start_ts, max(ts) AS end_ts FROM raw"), "start_ts end_ts")

# ------------------------------------------------------------------ composites
PROCESSED = (
    RAW
    + VIEWS
    + """, raw2 AS (SELECT * FROM raw UNION ALL SELECT e.panel_id, 'exogenous_load', e.ts, v.load FROM (SELECT DISTINCT panel_id, ts FROM raw) e ASOF LEFT JOIN views v ON e.ts >= v.ts)"""
    + HOURLY[len(RAW) :].replace("FROM raw)", "FROM raw2)")
    + BOUNDS
    + ", masked AS (SELECT h.panel_id, h.channel, ts, CASE WHEN value < lower OR value > upper THEN NULL ELSE value END AS value FROM hourly h LEFT JOIN bounds b ON h.panel_id = b.panel_id AND h.channel = b.channel)"
    + CARRIED[len(HOURLY) :].replace("FROM hourly", "FROM masked")
    + PANEL[len(CARRIED) :]
    + ", smooth AS (SELECT panel_id, channel, ts, CASE WHEN contains(channel, 'click') THEN list_sort([lag(value, 1, 0.0) OVER w, value, lead(value, 1, 0.0) OVER w])[2] ELSE value END AS value, observed FROM panel WINDOW w AS (PARTITION BY panel_id, channel ORDER BY ts))"
)
add("process", lambda s, d: P.process(raw(s, d), views(s, d), bounds=bounds(s), median="click", average="i"), select(PROCESSED, "SELECT panel_id, channel, ts, value, observed FROM smooth WHERE NOT contains(channel, 'i') UNION ALL SELECT panel_id, 'temperature', ts, avg(value), 1 FROM smooth WHERE contains(channel, 'i') GROUP BY panel_id, ts"), "ts", "value")
with_, _, body = AGAIN.rpartition(MAIN)
add("prepare_panel", lambda s, d: P.prepare_panel(panel(s, d), intervals(s), 3600).select(*K, "ts", "value", "observed", "role"), select(with_, f"SELECT *, CASE WHEN channel LIKE '%\\_\\_weight' ESCAPE '\\' THEN 'weight' WHEN channel LIKE 'exogenous\\_%' ESCAPE '\\' THEN 'exog' ELSE 'target' END AS role FROM ({body})"), "ts", "value")


# ------------------------------------------------------------------ scalar functions
def standardised(s: SparkSession, d: str) -> DataFrame:
    p = panel(s, d).withColumn("value", F.when(F.col("channel") == "view", 1.0).otherwise(F.col("value")))
    m = p.groupBy(*K).agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    return p.join(m, K).select(*K, "ts", S.zscore(F.col("value"), F.col("mean"), F.col("std")).alias("z"))


add("lp_norm", lambda s, d: wide(panel(s, d), ["click", "purchase"]).select("panel_id", "ts", S.lp_norm([F.col("click"), F.col("purchase")], 3.0).alias("norm")), select(PANEL, "SELECT panel_id, ts, pow(sum(pow(abs(value), 3)), 1 / 3.0) AS norm FROM panel WHERE channel IN ('click', 'purchase') GROUP BY panel_id, ts"), "ts", "norm")
add("zscore", standardised, select(PANEL, "SELECT panel_id, channel, ts, CASE WHEN sd = 0 THEN 0 ELSE (value - m) / sd END AS z FROM (SELECT *, avg(value) OVER w AS m, stddev_pop(value) OVER w AS sd FROM (SELECT panel_id, channel, ts, CASE WHEN channel = 'view' THEN 1.0 ELSE value END AS value FROM panel) WINDOW w AS (PARTITION BY panel_id, channel))"), "ts", "z")
add("argmax_group", lambda s, d: group_scores(s, d).groupBy("panel_id", "ts").agg(S.argmax_group(F.col("group"), F.col("normalized")).alias("winner")), select(GROUPED, "SELECT panel_id, ts, grp AS winner FROM gf QUALIFY row_number() OVER (PARTITION BY panel_id, ts ORDER BY normalized DESC NULLS LAST, grp) = 1"), "ts")
add("bonferroni", lambda s, d: C.group_quantiles(groups(s)).join(raw(s, d).groupBy("panel_id").count(), "panel_id").select("panel_id", F.col("group").alias("grp"), "q", "count"), select(GROUPED, "SELECT g.panel_id, g.grp, g.q, r.n AS count FROM gq g JOIN (SELECT panel_id, count(*) AS n FROM raw GROUP BY panel_id) r ON r.panel_id = g.panel_id"), "", "q")
add("format_times", lambda s, d: raw(s, d).groupBy(*K).agg(F.max("ts").alias("ts")).select(*K, S.fmt_version(F.col("ts")).alias("version"), S.iso(F.col("ts")).alias("iso")), select(RAW, "SELECT panel_id, channel, strftime(max(ts), '%Y%m%d_%H%M%S') AS version, strftime(max(ts), '%Y-%m-%dT%H:%M:%S') AS iso FROM raw GROUP BY panel_id, channel"))
add("mean_arrays", lambda s, d: W.lag_features(panel(s, d), [1, 3]).select(*K, "ts", F.get(S.mean_arrays(F.col("lags"), F.array("value", "value")), F.lit(1)).alias("mean")), select(PANEL, "SELECT panel_id, channel, ts, (value + l) / 2 AS mean FROM (SELECT *, lag(value, 3) OVER (PARTITION BY panel_id, channel ORDER BY ts) AS l FROM panel) WHERE l IS NOT NULL"), "ts", "mean")
add("to_json_record", lambda s, d: raw(s, d).groupBy(*K).count().select("panel_id", "channel", S.to_json_record(channel=F.col("channel"), n=F.col("count")).alias("record")), select(RAW, "SELECT panel_id, channel, CAST(json_object('channel', channel, 'n', count(*)) AS VARCHAR) AS record FROM raw GROUP BY panel_id, channel"))
