"""Hyper-parameter search: candidates and series scored in one job."""

from __future__ import annotations

import json
import math
import random

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import models, trees, windows
from ..operators.panel import K, settled, small

PENALTY = 1e12


def _drawn(rng: random.Random, values: list) -> float | str:
    """One value of a space: of [lo, hi] any between, whole ones for whole bounds; of [lo, hi, "log10"] any by its
    logarithm; of a list with a string, or of more than two values, one of these."""
    if len(values) == 3 and values[2] == "log10":
        drawn = 10 ** rng.uniform(math.log10(values[0]), math.log10(values[1]))
        return float(round(drawn)) if all(isinstance(v, int) for v in values[:2]) else float(drawn)
    if len(values) != 2 or any(isinstance(v, str) for v in values):
        return rng.choice(values)
    return float(rng.randint(*values)) if all(isinstance(v, int) for v in values) else float(rng.uniform(*values))


def _steps(lags: int | str | list[int]) -> list[int]:
    """The lags of ``6``, ``"6"`` (the last six), ``[1, 2, 24]`` or ``"[1, 2, 24]"``."""
    told = json.loads(lags) if isinstance(lags, str) else lags
    return sorted(told) if isinstance(told, list) else list(range(1, told + 1))


def expand_space(spark: SparkSession, spec: dict[str, dict], n: int = 10, seed: int = 42, lags: list | None = None) -> DataFrame:
    """(trial, model, params, lags, steps, choices): ``n`` seeded candidates of each model of {model: {name: values}}.

    Values as ``_drawn`` takes them; what is no number goes to choices. The name lags holds the lags to choose from, each as ``_steps``
    takes it; ``lags`` are those of models that name none. Column lags is the longest of steps.
    """
    rng, rows = random.Random(seed), []
    for model, space in spec.items():
        if lags is not None:
            space = space if "lags" in space else {**space, "lags": lags}
        for _ in range(n):
            params, choices, steps = {}, {}, _steps(6)
            for name, values in space.items():
                if name == "lags":
                    steps = _steps(rng.choice(values))
                    continue
                drawn = _drawn(rng, values)
                try:
                    params[name] = float(drawn)
                except ValueError:
                    choices[name] = drawn
            rows.append((len(rows), model, params, max(steps), steps, choices))
    return spark.createDataFrame(rows, "trial int, model string, params map<string,double>, lags int, steps array<int>, choices map<string,string>")


def trial_budget(series: DataFrame, budgets: DataFrame) -> DataFrame:
    """(panel_id, channel, trials): the channel's budget, else its panel's, else the global one."""
    own = budgets.where("panel_id is not null and channel is not null").select(*K, F.col("trials").alias("a"))
    panel = budgets.where("panel_id is not null and channel is null").select("panel_id", F.col("trials").alias("b"))
    every = budgets.where("panel_id is null").agg(F.max("trials").alias("c"))
    return series.select(*K).distinct().join(small(own), K, "left").join(small(panel), "panel_id", "left").crossJoin(F.broadcast(every)).select(*K, F.coalesce("a", "b", "c").alias("trials"))


def one_step_fold(df: DataFrame, train: int = 60, val: int = 20, test: int = 20) -> DataFrame:
    """Rows of the train and val parts; the test part is cut off."""
    return windows.chronological_split(df, train, val, test).where("split <> 'test'")


def metric(df: DataFrame, name: str) -> DataFrame:
    """(panel_id, channel, metric) to be minimised, over finite pairs: mae, mse, rmse, mape, r2 (negated); what is not finite is PENALTY."""
    rows = F.when(F.col("pred").isNotNull() & ~F.isnan("pred") & F.col("value").isNotNull() & ~F.isnan("value"), F.lit(1.0))
    y, p = F.col("value") * rows, F.col("pred") * rows
    sse = F.sum((y - p) * (y - p))
    of = {
        "mae": F.avg(F.abs(y - p)),
        "mse": F.avg((y - p) * (y - p)),
        "rmse": F.sqrt(F.avg((y - p) * (y - p))),
        "mape": F.avg(F.when(F.abs(y) > 1e-10, F.abs((y - p) / y))),
        "r2": -(1 - sse / F.nullif(F.var_pop(y) * F.count(rows), F.lit(0.0))),
    }[name]
    value = F.nanvl(of, F.lit(PENALTY))
    return df.groupBy(*K).agg(F.when(F.abs(value) == float("inf"), PENALTY).otherwise(F.coalesce(value, F.lit(PENALTY))).alias("metric"))


#: Metrics of linear candidates that their sums give exactly.
FROM_SUMS = {
    "rmse": lambda sse, n, sst: np.sqrt(max(sse, 0) / n),
    "mse": lambda sse, n, sst: sse / n,
    "r2": lambda sse, n, sst: -(1 - sse / sst) if sst > 0 else np.nan,
}
TRIALS = "panel_id string, channel string, trial int, metric double"
#: Parts a series' name from a trial's number, where a trial is fitted as a series of its own.
MARK = "\u0001"


def tune(df: DataFrame, candidates: DataFrame, train: int = 60, val: int = 20, test: int = 20, every: int = 3600, by: str = "rmse", budgets: DataFrame | None = None) -> DataFrame:
    """(panel_id, channel, model, params, lags, metric, error): the best candidate of each series by validation error.

    ``candidates``: see ``expand_space``; ``by``: a metric of ``metric``; ``budgets``: see ``trial_budget``: a series tries the
    first so many candidates of each model. Candidates of any kind that ``models.fit_specs`` takes are compared on the same rows:

    * Linear ones, by a metric of FROM_SUMS: two Gram passes with the longest lags, over train and val rows; each is
      solved from parts of these sums, so the data are read once whatever the number of candidates.
    * Boosted trees: those of equal inputs share one binned data set and grow side by side.
    * The others: fitted and predicted for each trial as if it were a series of its own.
    """
    if "steps" not in candidates.columns:
        candidates = candidates.withColumn("steps", F.sequence(F.lit(1), F.col("lags")))
    tried = sorted(candidates.collect(), key=lambda r: r["trial"])  # the search space, as given
    place: dict[int, int] = {}
    for c in tried:
        place[c["trial"]] = sum(1 for t in tried if t["model"] == c["model"] and t["trial"] < c["trial"])
    kinds = {*models.SOLVERS, *models.TREE_KINDS, *models.KERNEL_KINDS, "huber"}
    p = max(r["lags"] for r in tried)
    fold = settled(one_step_fold(df, train, val, test).select(*K, "ts", "value", "split"), "fold")
    lagged = settled(windows.lag_features(fold, p, every).where("value is not null").select(*K, "ts", "value", "split", "lags"), "lags")
    everyone = lagged.select(*K).distinct()
    allowed = everyone.withColumn("trials", F.lit(len(tried))) if budgets is None else trial_budget(everyone, budgets).withColumn("trials", F.coalesce("trials", F.lit(len(tried))))
    allowed = settled(allowed, "budgets")
    listed = df.sparkSession.createDataFrame([(c["trial"], c["model"], c["params"], c["lags"], list(c["steps"]), place[c["trial"]]) for c in tried], "trial int, model string, params map<string,double>, lags int, steps array<int>, place int")
    asked = settled(allowed.join(F.broadcast(listed), F.col("place") < F.col("trials")).drop("place", "trials"), "asked")  # the search space is small
    from_sums = [c for c in tried if c["model"].lower() in models.SOLVERS and by in FROM_SUMS]
    others = [c for c in tried if c["model"].lower() in kinds and c not in from_sums]
    told = df.sparkSession.createDataFrame([], TRIALS)
    if from_sums:
        told = told.unionByName(_linear_trials(lagged, p, from_sums, by))
    if others:
        told = told.unionByName(_fitted_trials(fold, lagged, asked, others, every, by))
    scored = asked.join(small(told.withColumnRenamed("metric", "m")), [*K, "trial"], "left").withColumn("metric", F.coalesce(F.nanvl("m", F.lit(PENALTY)), F.lit(PENALTY)))
    best = scored.groupBy(*K).agg(F.min_by(F.struct("model", "params", "lags", "steps", "metric"), F.struct("metric", "trial")).alias("b")).select(*K, "b.*")
    return best.withColumn("error", F.when(F.col("metric") >= PENALTY, "all trials failed"))


def _linear_trials(lagged: DataFrame, p: int, tried: list, by: str) -> DataFrame:
    """TRIALS of linear candidates from a series' sums over its train and its val rows."""
    of = lambda s, n: models.gram(lagged.where(F.col("split") == s), p).select(*K, F.col("sums").alias(n))
    both = of("train", "a").join(of("val", "b"), K)

    def run(batches):
        for rows in batches:
            out = []
            for r in rows.itertuples(index=False):
                whole = np.zeros((p + 2, p + 2))
                whole[np.triu_indices(p + 2)] = np.asarray(r.b, dtype=float)
                whole = whole + np.triu(whole, 1).T
                count = whole[0, 0]
                spread = whole[-1, -1] - whole[0, -1] ** 2 / count
                n, mx, xx, xy, my, yy = models._moments(np.asarray(r.a, dtype=float), p)
                for c in tried:
                    at = [k - 1 for k in c["steps"]]
                    if n < len(at) + 2:
                        out.append((r.panel_id, r.channel, c["trial"], PENALTY))
                        continue
                    s2 = max(yy / n, 1e-300)
                    b = models.SOLVERS[c["model"].lower()](xx[np.ix_(at, at)] / s2, xy[at] / s2, yy / s2, n, c["params"].get("alpha", 1.0), c["params"].get("l1_ratio", 0.5))
                    w = np.zeros(p + 2)
                    w[0], w[-1] = my - b @ mx[at], -1.0
                    w[np.asarray(at) + 1] = b
                    error = FROM_SUMS[by](w @ whole @ w, count, spread)
                    out.append((r.panel_id, r.channel, c["trial"], float(error) if np.isfinite(error) else PENALTY))
            yield pd.DataFrame(out, columns=["panel_id", "channel", "trial", "metric"])

    return both.mapInPandas(run, TRIALS)


def _fitted_trials(fold: DataFrame, lagged: DataFrame, asked: DataFrame, tried: list, every: int, by: str) -> DataFrame:
    """TRIALS of candidates that are fitted on train rows and predict the val rows."""
    named = F.concat_ws(MARK, "channel", F.col("trial").cast("string"))
    told: DataFrame | None = None
    for steps in sorted({tuple(c["steps"]) for c in tried}):
        here = [c for c in tried if tuple(c["steps"]) == steps]
        of = lambda names: asked.where(F.col("trial").isin(*[c["trial"] for c in here if c["model"].lower() in names]))  # noqa: B023, E731
        parts = []
        if any(c["model"].lower() in models.TREE_KINDS for c in here):
            chosen = F.array(*[F.col("lags")[k - 1] for k in steps])
            rows = lagged.where("split = 'train'").select(*K, "value", chosen.alias("lags"))
            grown = trees.fit(rows, of(models.TREE_KINDS).select(*K, "trial", "params"), len(steps))
            parts.append(grown.select("panel_id", named.alias("channel"), F.array(*[F.lit(k) for k in steps]).alias("lags"), F.array_repeat(F.lit(0.0), len(steps)).alias("coef"), "intercept", "trees"))
        for names, fit in ((tuple(models.SOLVERS), models._fit_linear_specs), (models.KERNEL_KINDS, models._fit_kernel_specs), (("huber",), models._fit_huber_specs)):
            if any(c["model"].lower() in names for c in here):
                own = settled(of(names).select("panel_id", "channel", "trial", "model", "params", F.lower("model").alias("kind")), "trials")
                copies = fold.where("split = 'train'").join(small(own.select(*K, "trial")), K).select("panel_id", named.alias("channel"), "ts", "value")
                fitted = fit(copies, own.select("panel_id", named.alias("channel"), "model", "params", "kind"), list(steps), every, 0)
                parts.append(fitted.select("panel_id", "channel", "lags", "coef", "intercept", *[c for c in ("kernel",) if c in fitted.columns]))
        for part in parts:
            told = part if told is None else told.unionByName(part, allowMissingColumns=True)
    told = settled(told, "trials")
    rows = lagged.where("split = 'val'").join(small(asked.where(F.col("trial").isin(*[c["trial"] for c in tried])).select(*K, "trial")), K)
    rows = rows.select("panel_id", named.alias("channel"), "ts", "value", F.col("lags").alias("__past"))
    scored = metric(models.predict_from_past(rows, told), by)
    return scored.select("panel_id", F.split_part("channel", F.lit(MARK), F.lit(1)).alias("channel"), F.split_part("channel", F.lit(MARK), F.lit(2)).cast("int").alias("trial"), "metric")
