"""Autoregressive one-step models: every series is fitted in one job.

Linear models need only sums of products of the lagged values (the Gram matrix): one partial and
final aggregate keyed by series, then a small solve for each series. A model is a row: model, lags,
coef, intercept, n, mu, sigma. Boosted trees and kernel models are rows too, with a column trees or kernel
beside these; what they add is evaluated on the inputs that the coefficients (then zeros) would meet.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from . import trees, windows
from .aggregates import median_mad
from .panel import K, bounded, exact_quantiles, settled, small

#: Kinds that grow boosted trees (the names of the libraries whose role they take, too) and that map inputs by a kernel.
TREE_KINDS = ("trees", "lightgbm", "xgboost", "catboost")
KERNEL_KINDS = ("nystroem", "kernelridgeapprox")
#: A kernel model: intercept + sum of weights * exp(-gamma * squared distance of the standardised inputs to each mark).
KERNEL = "struct<marks:array<array<double>>,weights:array<double>,gamma:double,center:array<double>,scale:array<double>>"
MODEL = "panel_id string, channel string, model string, lags array<int>, coef array<double>, intercept double, n long, mu double, sigma double"


def sample_weight(df: DataFrame, lags: int, every: int = 3600) -> DataFrame:
    """``df`` with weight: 1 where the row and its lags are observed and none was cleaned away (column cleaned, if there)."""
    out = windows.strict_mask(df, lags, every)
    usable = F.col("usable") & (~F.coalesce("cleaned", F.lit(False)) if "cleaned" in df.columns else F.lit(True))
    return out.withColumn("weight", usable.cast("double")).drop("usable")


def standardize(df: DataFrame) -> DataFrame:
    """``df`` with z, and mu and sigma (population) of its series; sigma 0 counts as 1."""
    m = df.groupBy(*K).agg(F.avg("value").alias("mu"), S.guard_zero(F.stddev_pop("value"), 1.0).alias("sigma"))
    return df.join(m, K).withColumn("z", (F.col("value") - F.col("mu")) / F.col("sigma"))


def gram(lagged: DataFrame, p: int, weight: Column | None = None) -> DataFrame:
    """Sums over each series of ``lagged`` (lags, value): n, of products of the lags and the value (row-wise upper triangle)."""
    w = F.lit(1.0) if weight is None else weight
    x = [F.lit(1.0), *[F.col("lags")[i] for i in range(p)], F.col("value")]
    sums = [F.sum(w * x[i] * x[j]).alias(f"s{i}_{j}") for i in range(p + 2) for j in range(i, p + 2)]
    out = lagged.where("value is not null").groupBy(*K).agg(F.count("*").alias("n"), *sums)
    return out.select(*K, "n", F.array(*[F.col(f"s{i}_{j}") for i in range(p + 2) for j in range(i, p + 2)]).alias("sums"))


def _moments(sums: np.ndarray, p: int) -> tuple[float, np.ndarray, np.ndarray, np.ndarray, float, float]:
    """n, means of the lags, centred XX and Xy, mean of y, centred yy."""
    m = np.zeros((p + 2, p + 2))
    m[np.triu_indices(p + 2)] = sums
    m = m + np.triu(m, 1).T
    n = m[0, 0]
    mean = m[0, 1:] / n
    c = m[1:, 1:] - n * np.outer(mean, mean)
    return n, mean[:p], c[:p, :p], c[:p, p], mean[p], c[p, p]


def _ridge(xx: np.ndarray, xy: np.ndarray, yy: float, n: float, alpha: float, l1: float) -> np.ndarray:
    return np.linalg.solve(xx + alpha * np.eye(len(xy)), xy) if alpha else np.linalg.lstsq(xx, xy, rcond=None)[0]


def _elastic(xx: np.ndarray, xy: np.ndarray, yy: float, n: float, alpha: float, l1: float) -> np.ndarray:
    """Coordinate descent on |y - Xb|^2 / 2n + alpha (l1 |b|_1 + (1 - l1) |b|^2 / 2)."""
    b = np.zeros(len(xy))
    for _ in range(1000):
        before = b.copy()
        for i in range(len(b)):
            rest = xy[i] - xx[i] @ b + xx[i, i] * b[i]
            b[i] = np.sign(rest) * max(abs(rest) - n * alpha * l1, 0) / (xx[i, i] + n * alpha * (1 - l1)) if xx[i, i] > 0 else 0.0
        if np.abs(b - before).max() <= 1e-9 * max(1.0, np.abs(b).max()):
            break
    return b


def _bayes(xx: np.ndarray, xy: np.ndarray, yy: float, n: float, alpha: float, l1: float) -> np.ndarray:
    """Evidence iteration for noise precision and weight precision."""
    values, vectors = np.linalg.eigh(xx)
    values = np.maximum(values, 0)
    noise, prior = n / max(yy, 1e-12), 1.0
    b = np.zeros(len(xy))
    for _ in range(300):
        before = b
        b = vectors @ ((vectors.T @ xy) / (values + prior / noise))
        left = max(yy - 2 * b @ xy + b @ xx @ b, 1e-12)
        used = (noise * values / (prior + noise * values)).sum()
        prior, noise = (used + 2e-6) / (b @ b + 2e-6), (n - used + 2e-6) / (left + 2e-6)
        if np.abs(b - before).max() < 1e-3 / 1e3:
            break
    return b


SOLVERS: dict[str, Callable] = {"ridge": _ridge, "linear": lambda *a: _ridge(*a[:4], 0.0, 0.0), "lasso": lambda *a: _elastic(*a[:5], 1.0), "elasticnet": _elastic, "bayesianridge": _bayes}


def _solve(grams: DataFrame, steps: list[int], kind: str | None, alpha: float, l1: float) -> DataFrame:
    """Models from sums; ``kind`` None: each row has model, alpha, l1_ratio and size (of its own inputs) columns."""
    p = len(steps)
    inputs = grams if kind is None else grams.withColumns({"model": F.lit(kind), "alpha": F.lit(float(alpha)), "l1_ratio": F.lit(float(l1))})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for r in rows.itertuples(index=False):
                width = int(np.sqrt(2 * len(r.sums))) - 2  # lags, then external inputs
                n, mx, xx, xy, my, yy = _moments(np.asarray(r.sums, dtype=float), width)
                if n < width + 1:
                    continue
                sigma = np.sqrt(max(yy / n, 0)) or 1.0
                # standardised by the target's spread; the coefficients stay those of raw units
                b = SOLVERS[r.model](xx / sigma**2, xy / sigma**2, yy / sigma**2, n, r.alpha, r.l1_ratio)
                out.append((r.panel_id, r.channel, r.model, steps, b.tolist(), float(my - b @ mx), int(r.n), float(my), float(sigma)))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in MODEL.split(", ")])

    return inputs.mapInPandas(run, MODEL)


def with_exog(df: DataFrame, channels: list[str]) -> DataFrame:
    """The rows of other channels with exog: the values of ``channels`` at their timestamp, in that
    order; a missing one takes the last before it, else the first after it, else 0."""
    side = windows.interpolate_with(df.where(F.col("channel").isin(*channels)).select(*K, "ts", "value"), lambda: F.coalesce("value", "prev_value", "next_value", F.lit(0.0)))
    at = side.groupBy("panel_id", "ts").agg(*[F.max(F.when(F.col("channel") == c, F.col("value"))).alias(f"__e{i}") for i, c in enumerate(channels)])
    out = df.where(~F.col("channel").isin(*channels)).join(at, ["panel_id", "ts"], "left")
    return out.withColumn("exog", F.array(*[F.coalesce(f"__e{i}", F.lit(0.0)) for i in range(len(channels))])).drop(*[f"__e{i}" for i in range(len(channels))])


def fit_linear(df: DataFrame, kind: str = "ridge", lags: int | list[int] = 6, alpha: float = 1.0, l1_ratio: float = 0.5, every: int = 3600, n_exog: int = 0) -> DataFrame:
    """One row a series: the linear model of its next value from its lags, and from the ``n_exog`` external
    values of its row (column exog). Rows with weight 0 (column weight, if there) do not count."""
    steps = list(range(1, lags + 1)) if isinstance(lags, int) else sorted(lags)
    return _solve(gram(_inputs(df, steps, every), len(steps) + n_exog), steps, kind, alpha, l1_ratio)


def _inputs(df: DataFrame, steps: list[int], every: int) -> DataFrame:
    lagged = windows.lag_features(df, steps, every)
    if "exog" in df.columns:
        lagged = lagged.withColumn("lags", F.concat("lags", "exog"))
    return lagged.where("weight > 0") if "weight" in df.columns else lagged


def fit_specs(df: DataFrame, specs: DataFrame, every: int = 3600, n_exog: int = 0) -> DataFrame:
    """Models by ``specs`` (panel_id, channel, model, params, lags; see ``resolve_specs``): each series its own
    kind, parameters and lags. Linear kinds take one pass of sums for each number of lags in the configuration."""
    specs = settled(specs.withColumn("kind", F.lower("model")), "specs")
    kinds = specs.select("kind", "lags").distinct().collect()  # a configuration's
    if unknown := sorted({r["kind"] for r in kinds} - SOLVERS.keys() - {*TREE_KINDS, *KERNEL_KINDS, "huber"}):
        raise ValueError(f"unknown models {unknown}; known: {sorted([*SOLVERS, *TREE_KINDS, *KERNEL_KINDS, 'huber'])}")
    out = None
    for lags in sorted({r["lags"] for r in kinds}):
        steps, here = list(range(1, lags + 1)), {r["kind"] for r in kinds if r["lags"] == lags}
        families = [(tuple(SOLVERS), _fit_linear_specs), (TREE_KINDS, _fit_tree_specs), (KERNEL_KINDS, _fit_kernel_specs), (("huber",), _fit_huber_specs)]
        for names, f in families:
            if not here.isdisjoint(names):
                own = specs.where((F.col("lags") == lags) & F.col("kind").isin(*names))
                part = f(df.join(small(own.select(*K)), K, "left_semi"), own, steps, every, n_exog)
                out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out if out is not None else df.sparkSession.createDataFrame([], MODEL)


def _fit_linear_specs(df: DataFrame, own: DataFrame, steps: list[int], every: int, n_exog: int) -> DataFrame:
    told = own.select(*K, F.col("kind").alias("model"), F.coalesce(F.col("params")["alpha"], F.lit(1.0)).alias("alpha"), F.coalesce(F.col("params")["l1_ratio"], F.lit(0.5)).alias("l1_ratio"))
    return _solve(gram(_inputs(df, steps, every), len(steps) + n_exog).join(small(told), K), steps, None, 0.0, 0.0)


def _fit_tree_specs(df: DataFrame, own: DataFrame, steps: list[int], every: int, n_exog: int, in_task: int = trees.IN_TASK) -> DataFrame:
    """Boosted trees; the coefficients are zeros, one for each input."""
    p = len(steps) + n_exog
    grown = trees.fit(_inputs(df, steps, every), own.select(*K, F.lit(0).alias("trial"), "params"), p, in_task)
    told = grown.join(small(own.select(*K, "model")), K)
    base = F.col("intercept")
    return told.select(*K, "model", F.array(*[F.lit(k) for k in steps]).alias("lags"), F.array_repeat(F.lit(0.0), p).alias("coef"), "intercept", "n", base.alias("mu"), F.lit(1.0).alias("sigma"), "trees")


def _fit_huber_specs(df: DataFrame, own: DataFrame, steps: list[int], every: int, n_exog: int) -> DataFrame:
    """Series of equal parameters together: as many fits as the configuration has."""
    own = settled(own, "specs")
    told = own.select(*K, F.coalesce(F.col("params")["epsilon"], F.lit(1.35)).alias("epsilon"), F.coalesce(F.col("params")["alpha"], F.lit(1e-4)).alias("alpha"))
    out = None
    for r in told.select("epsilon", "alpha").distinct().collect():
        mine = told.where((F.col("epsilon") == r["epsilon"]) & (F.col("alpha") == r["alpha"])).select(*K)
        part = fit_huber(df.join(small(mine), K, "left_semi"), steps, r["epsilon"], r["alpha"], every=every, n_exog=n_exog)
        out = part if out is None else out.unionByName(part)
    return out


def fit_huber(df: DataFrame, lags: int | list[int] = 6, epsilon: float = 1.35, alpha: float = 1e-4, rounds: int = 6, every: int = 3600, n_exog: int = 0) -> DataFrame:
    """Huber regression by reweighting: a Gram pass a round; residuals over epsilon scales weigh less.
    Rows with weight 0 (column weight, if there) do not count."""
    steps = list(range(1, lags + 1)) if isinstance(lags, int) else sorted(lags)
    p = len(steps) + n_exog
    lagged = settled(_inputs(df, steps, every).where("value is not null").select(*K, "ts", "value", "lags"), "lags")
    models = settled(_solve(gram(lagged, p), steps, "ridge", alpha, 0.0), "models")
    for _ in range(rounds):
        told = lagged.join(small(models.select(*K, "coef", "intercept")), K).withColumn("r", F.abs(F.col("value") - F.col("intercept") - dot("lags", "coef")))
        told = settled(told.drop("coef", "intercept"), "residuals")
        scale = exact_quantiles(told, K, "r", {"scale": 0.5})
        limit = F.lit(epsilon) * F.greatest(F.col("scale") / F.lit(0.6745), F.lit(1e-12))
        weighted = told.join(small(scale), K).withColumn("w", F.when(F.col("r") <= limit, 1.0).otherwise(limit / F.col("r")))
        models = settled(_solve(gram(weighted, p, F.col("w")), steps, "ridge", alpha, 0.0), "models")
    return models.withColumn("model", F.lit("huber"))


#: Rows of a series that one task maps by its kernel at once.
KERNEL_ROWS = 50_000


def _fit_kernel_specs(df: DataFrame, own: DataFrame, steps: list[int], every: int, n_exog: int) -> DataFrame:
    """Ridge on an approximate RBF map (Nystroem). Parameters: n_components, gamma, alpha.

    A series' marks are its n_components rows of the smallest hashes, standardised. Each time bucket gives the
    products of its rows' kernel values (components squared numbers, whatever its rows), which are
    summed in two steps and solved a series; the model is one row.
    """
    p = len(steps) + n_exog
    rows = settled(_inputs(df, steps, every).where("value is not null").select(*K, "ts", "value", "lags"), "inputs")
    spread = lambda c: S.guard_zero(F.stddev_pop(c), 1.0)
    told = rows.groupBy(*K).agg(F.count("*").alias("n"), F.avg("value").alias("mu"), spread("value").alias("sigma"), F.array(*[F.avg(F.col("lags")[i]) for i in range(p)]).alias("center"), F.array(*[spread(F.col("lags")[i]) for i in range(p)]).alias("scale"))
    told = settled(told.join(small(own.select(*K, "model", *[F.coalesce(F.col("params")[c], F.lit(x)).alias(c) for c, x in (("n_components", 48.0), ("gamma", 0.1), ("alpha", 1.0))])), K), "told")
    over = F.zip_with(F.zip_with("lags", "center", lambda a, b: a - b), "scale", lambda a, b: a / b)
    bucket = F.floor(S.micros(F.col("ts")) / F.lit(KERNEL_ROWS * every * S.MICROS))
    ready = settled(rows.join(small(told), K).select(*K, "ts", bucket.alias("bucket"), over.alias("x"), ((F.col("value") - F.col("mu")) / F.col("sigma")).alias("z"), "n_components"), "standardised")
    first = Window.partitionBy(*K).orderBy("h", "ts")  # limited before the shuffle
    ranked = ready.select(*K, "ts", "x", "n_components", F.xxhash64(*K, "ts").alias("h")).withColumn("r", F.row_number().over(first)).where(F.col("r") <= 1 << 16).where(F.col("r") <= F.col("n_components"))
    marks = ranked.groupBy(*K).agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "x"))), lambda e: e["x"]).alias("marks"))
    told = settled(told.join(marks, K), "marks")

    def near(x: np.ndarray, m: np.ndarray, gamma: float) -> np.ndarray:
        return np.exp(-gamma * ((x**2).sum(axis=1)[:, None] + (m**2).sum(axis=1)[None] - 2 * x @ m.T).clip(0))

    def matrix(lists) -> np.ndarray:
        return np.array([list(v) for v in lists], dtype=float).reshape(len(lists), p)

    def products(key: tuple, rows_: pd.DataFrame, told_: pd.DataFrame) -> pd.DataFrame:
        t = told_.iloc[0]
        m, z = matrix(t["marks"]), rows_["z"].to_numpy()
        a = np.zeros((len(m) + 2, len(m) + 2))
        for i in range(0, len(z), 4096):
            f = np.column_stack([np.ones(len(z[i : i + 4096])), near(matrix(rows_["x"].iloc[i : i + 4096].tolist()), m, t["gamma"]), z[i : i + 4096]])
            a += f.T @ f
        return pd.DataFrame([(*key, a.ravel().tolist())], columns=[*K, "bucket", "a"])

    def added(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(*key, np.sum([np.asarray(v) for v in parts["a"]], axis=0).tolist())], columns=[*K, "bucket", "a"])

    def solved(key: tuple, parts: pd.DataFrame, told_: pd.DataFrame) -> pd.DataFrame:
        t = told_.iloc[0]
        m = matrix(t["marks"])
        a = np.sum([np.asarray(v) for v in parts["a"]], axis=0).reshape(len(m) + 2, len(m) + 2)
        values, vectors = np.linalg.eigh(near(m, m, t["gamma"]))
        root = vectors / np.sqrt(np.maximum(values, 1e-12))
        lift = np.zeros((len(m) + 1, len(m) + 1))
        lift[0, 0], lift[1:, 1:] = 1.0, root
        ff, fz = lift.T @ a[:-1, :-1] @ lift, lift.T @ a[:-1, -1]
        b = np.linalg.solve(ff + np.diag([1e-12] + [t["alpha"]] * len(m)), fz)
        return pd.DataFrame([(*key, float(b[0]), (root @ b[1:]).tolist())], columns=[*K, "b", "weights"])

    parted = "panel_id string, channel string, bucket long, a array<double>"
    each = ready.select(*K, "bucket").distinct().join(small(told.select(*K, "marks", "gamma")), K)
    each = each.select(*[F.col(c).alias(c) for c in each.columns])  # columns of its own, beside those of the rows
    sums = ready.select(*K, "bucket", "x", "z").groupBy(*K, "bucket").cogroup(each.groupBy(*K, "bucket")).applyInPandas(products, parted)
    sums = sums.withColumn("bucket", F.floor(F.col("bucket") / 64)).groupBy(*K, "bucket").applyInPandas(added, parted)
    weights = settled(sums.groupBy(*K).cogroup(told.select(*K, "marks", "gamma", "alpha").groupBy(*K)).applyInPandas(solved, "panel_id string, channel string, b double, weights array<double>"), "weights")
    kernel = F.struct("marks", F.transform("weights", lambda w: w * F.col("sigma")).alias("weights"), "gamma", "center", "scale").cast(KERNEL)
    intercept = F.col("mu") + F.col("sigma") * F.col("b")
    return told.join(weights, K).select(*K, "model", F.array(*[F.lit(k) for k in steps]).alias("lags"), F.array_repeat(F.lit(0.0), p).alias("coef"), intercept.alias("intercept"), "n", "mu", "sigma", kernel.alias("kernel"))


def kernel_value(kernel: str, x: str) -> Column:
    """What a kernel model adds to its intercept at ``x``; 0 without one."""
    k = F.col(kernel)
    z = F.zip_with(F.zip_with(F.col(x), k["center"], lambda a, b: a - b), k["scale"], lambda a, b: a / b)
    far = lambda m: F.aggregate(F.zip_with(z, m, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
    each = F.zip_with(k["marks"], k["weights"], lambda m, w: w * F.exp(-k["gamma"] * far(m)))
    return F.coalesce(F.aggregate(each, F.lit(0.0), lambda s, v: s + v), F.lit(0.0))


def dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def predict(df: DataFrame, models: DataFrame, every: int = 3600, reach: int | None = None) -> DataFrame:
    """``df`` with pred: one step ahead from observed lags (and exog, where the model has more coefficients
    than lags); null without model or input. A dot product without user code, and what trees and kernels add.

    ``reach``: the longest lag, where it is known; else the model table is read for it.
    """
    if reach is None:
        reach = models.agg(F.max(F.array_max("lags"))).first()[0] or 1
    out = bounded(df, {"__past": lambda w: F.array(*[F.lag("value", k).over(w) for k in range(1, reach + 1)])}, reach * every, 0)
    return predict_from_past(out, models)


def predict_from_past(out: DataFrame, models: DataFrame) -> DataFrame:
    """``out`` with pred instead of __past, the values before each row, the last one first."""
    more = [c for c in ("trees", "kernel") if c in models.columns]
    grown = trees.added(models) if "trees" in more else None
    if grown is not None:
        more.remove("trees")
    m = models.select(*K, F.col("lags").alias("__k"), "coef", "intercept", *[F.col(c).alias(f"__{c}") for c in more])
    chosen = F.transform("__k", lambda k: F.get("__past", k - 1))
    if "exog" in out.columns:
        chosen = F.when(F.size("coef") > F.size("__k"), F.concat(chosen, "exog")).otherwise(chosen)
    out = out.join(small(m), K, "left").withColumn("__x", chosen)
    whole = F.col("coef").isNotNull() & (F.size("__x") == F.size("coef")) & ~F.exists("__x", lambda v: v.isNull())
    pred = F.col("intercept") + dot("__x", "coef")
    if grown is not None:
        pred = pred + grown("panel_id", "channel", "__x")
    elif "trees" in more:
        pred = pred + trees.evaluated("__trees", "__x")
    if "kernel" in more:
        pred = pred + kernel_value("__kernel", "__x")
    return out.withColumn("pred", F.when(whole, pred)).drop("__past", "__k", "coef", "intercept", "__x", *[f"__{c}" for c in more])


def differenced(df: DataFrame, every: int = 3600) -> DataFrame:
    """``df`` with the change since the row before as value; the first row of a series falls away."""
    return windows.difference(df, 1, every).withColumn("value", F.col("delta")).drop("delta")


def predict_differenced(df: DataFrame, models: DataFrame, every: int = 3600, reach: int | None = None) -> DataFrame:
    """``df`` with pred of ``models`` of the changes, added to the value before."""
    changes = predict(differenced(df, every), models, every, reach).select(*K, "ts", "pred")
    return windows.integrate(df.join(changes, [*K, "ts"], "left"), every)


def predict_naive(df: DataFrame, every: int = 3600) -> DataFrame:
    """``df`` with pred: the value before."""
    return bounded(df, {"pred": lambda w: F.lag("value").over(w)}, every, 0)


def auto_clean(df: DataFrame, lags: int = 24, factor: float = 4.0, spread: int = 3, every: int = 3600) -> DataFrame:
    """``df`` with cleaned: residuals of a ridge pass above median + ``factor`` MAD, spread by ``spread`` rows."""
    told = predict(df, fit_linear(df, "ridge", lags, 1.0, every=every), every, lags)
    told = settled(told.withColumn("__r", F.abs(F.col("value") - F.col("pred"))), "residuals")
    limits = small(median_mad(told.select(*K, F.col("__r").alias("value"))))
    hit = F.coalesce(F.col("__r") > F.col("median") + factor * F.col("mad"), F.lit(False))
    out = windows.dilate(told.join(limits, K, "left").withColumn("cleaned", hit.cast("int")), spread, "cleaned", every)
    return out.withColumn("cleaned", F.col("cleaned") == 1).drop("pred", "__r", "median", "mad")


def prepare_channels(df: DataFrame, lags: int) -> DataFrame:
    """Series with at least lags + 10 rows and a usable one (weight > 0, if there)."""
    usable = F.max("weight") > 0 if "weight" in df.columns else F.lit(True)
    good = df.groupBy(*K).agg(F.count("value").alias("n"), usable.alias("ok")).where((F.col("n") >= lags + 10) & F.col("ok"))
    return df.join(good.select(*K), K, "left_semi")


def resolve_specs(channels: DataFrame, specs: DataFrame) -> DataFrame:
    """(panel_id, channel, model, params, lags) from specs (panel_id, channel, model, params, lags).

    The channel's own row wins, then its panel's (channel null), then the global one (both null);
    params of a broader row count only for the same model; lags are the most specific ones.
    """
    level = lambda where, p: specs.where(where).select(*[c for c in ("panel_id", "channel") if c in p], *[F.col(c).alias(f"{c}_{len(p)}") for c in ("model", "params", "lags")])
    own, panel, every = level("panel_id is not null and channel is not null", K), level("panel_id is not null and channel is null", ["panel_id"]), level("panel_id is null", [])
    out = channels.select(*K).distinct().join(small(own), K, "left").join(small(panel), "panel_id", "left").join(small(every), F.lit(True), "left")
    model = F.coalesce("model_2", "model_1", "model_0")
    none = F.create_map().cast("map<string,double>")
    of = lambda i: F.when(F.col(f"model_{i}") == model, F.coalesce(f"params_{i}", none)).otherwise(none)
    merged = F.map_zip_with(F.map_zip_with(of(2), of(1), lambda k, a, b: F.coalesce(a, b)), of(0), lambda k, a, b: F.coalesce(a, b))
    return out.select(*K, model.alias("model"), merged.alias("params"), F.coalesce("lags_2", "lags_1", "lags_0").alias("lags"))


def train(df: DataFrame, kind: str = "ridge", lags: int = 6, alpha: float = 1.0, split: tuple[int, int, int] = (80, 10, 10), every: int = 3600, specs: DataFrame | None = None, exog: list[str] = (), difference: bool = False, params: dict[str, float] | None = None) -> tuple[DataFrame, DataFrame]:
    """(models, evaluation): fitted on train rows; rmse and mae on val and test rows with real lags.

    ``kind``: of SOLVERS, TREE_KINDS, KERNEL_KINDS or huber; ``params``: its parameters beside ``alpha``.

    ``specs``: configured models (see ``resolve_specs``), each series by its own; else all by ``kind``,
    ``lags`` and ``alpha``. ``exog``: channels that are inputs at their timestamp, not targets.
    ``difference``: models of the changes, predictions in raw units. The split frame and the models are settled.
    """
    from .aggregates import eval_metrics

    if exog:
        df = with_exog(df, list(exog))
    parts = settled(windows.chronological_split(df, *split), "split")
    learn = parts.where("split = 'train'").drop("rn", "n", "split")
    if specs is not None:
        specs = settled(resolve_specs(learn, specs), "specs")
        lags = specs.agg(F.max("lags")).first()[0] or lags
    learn = prepare_channels(sample_weight(learn, lags, every), lags)
    if difference:
        learn = differenced(learn, every)
    if specs is None and kind in SOLVERS:
        models = fit_linear(learn, kind, lags, alpha, every=every, n_exog=len(exog))
    else:
        if specs is None:
            specs = _alike(learn, kind, lags, ({} if kind.lower() == "huber" else {"alpha": alpha}) | (params or {}))
        models = fit_specs(learn, specs, every, len(exog))
    models = settled(models, "models")
    told = (predict_differenced if difference else predict)(parts, models, every, lags)
    told = told.where("split <> 'train'")
    scores = eval_metrics(told.withColumn("channel", F.concat_ws("\u0001", "channel", "split")))
    scores = scores.select("panel_id", F.split_part("channel", F.lit("\u0001"), F.lit(1)).alias("channel"), F.split_part("channel", F.lit("\u0001"), F.lit(2)).alias("split"), "rmse", "mae")
    of = lambda s, c: F.max(F.when(F.col("split") == s, F.col(c))).alias(f"{s}_{c}")
    return models, scores.groupBy(*K).agg(*[of(s, c) for s in ("val", "test") for c in ("rmse", "mae")])


def _alike(df: DataFrame, kind: str, lags: int, params: dict[str, float]) -> DataFrame:
    """One specification for all series of ``df``."""
    told = F.create_map(*[F.lit(x) for k, v in params.items() for x in (k, float(v))])
    return settled(df.select(*K).distinct().select(*K, F.lit(kind).alias("model"), told.alias("params"), F.lit(lags).alias("lags")), "specs")


def fit_trees(df: DataFrame, lags: int = 6, depth: int = 4, rounds: int = 10, every: int = 3600, **params: float) -> DataFrame:
    """``df`` rows that have lags with pred of boosted trees fitted on them, a model a series (see ``trees``)."""
    steps, specs = list(range(1, lags + 1)), _alike(df, "trees", lags, {"max_depth": depth, "n_estimators": rounds} | params)
    return _fitted(df, _fit_tree_specs(df, specs, steps, every, 0), lags, every)


def fit_nystroem(df: DataFrame, lags: int = 6, m: int = 48, gamma: float = 0.1, alpha: float = 1.0, every: int = 3600) -> DataFrame:
    """``df`` rows that have lags with pred of ridge on an approximate RBF map of their standardised lags, fitted on them."""
    steps, specs = list(range(1, lags + 1)), _alike(df, "nystroem", lags, {"n_components": m, "gamma": gamma, "alpha": alpha})
    return _fitted(df, _fit_kernel_specs(df, specs, steps, every, 0), lags, every)


def _fitted(df: DataFrame, models: DataFrame, lags: int, every: int) -> DataFrame:
    return predict(df, models, every, lags).where("pred is not null and value is not null").select(*K, "ts", "value", "pred")
