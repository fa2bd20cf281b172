"""Learned scorers on residual vectors: k-means, Gaussian mixture, isolation forest.

Each key (a panel, or a panel and group) has a model of its own, and all are fitted side by side.
Models are small tables that are settled from round to round and joined to the rows, never
collected. ``scorer`` makes one usable in detection (see ``scoring.score_rows``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalar as S
from .panel import BUCKET, bounded, settled, small
from .scoring import Scorer

PANEL = ["panel_id"]


# --------------------------------------------------------------- vectors
def residual_vectors(rows: DataFrame, extra: list[str] = (), window: int = 1, every: int = 3600) -> DataFrame:
    """(panel_id, group, ts, extra, vector): the residuals of a group's channels, by channel name, over
    ``window`` consecutive timestamps, the newest first; null where one is missing."""
    r = F.col("value") - F.col("pred")
    out = rows.groupBy("panel_id", "group", "ts", *extra).agg(F.sort_array(F.collect_list(F.struct("channel", r.alias("r")))).alias("a"), F.count(r).alias("k"), F.count("*").alias("n"))  # a group's channels
    out = out.select("panel_id", "group", "ts", *extra, F.when(F.col("k") == F.col("n"), F.transform("a", lambda x: x["r"])).alias("vector"))
    if window == 1:
        return out
    past = {f"__v{i}": (lambda w, i=i: F.lag("vector", i).over(w)) for i in range(1, window)}
    wide = bounded(out.withColumnRenamed("group", "channel"), past, (window - 1) * every, 0).withColumnRenamed("channel", "group")
    return wide.withColumn("vector", F.concat("vector", *past)).drop(*past)


def scorer(name: str, window: int = 1, component_wise: bool = False, **options) -> Scorer:
    """``kmeans``, ``gmm`` or ``iforest`` as the scorer of a detection. ``window``: consecutive timestamps
    that a vector spans. ``component_wise``: a model for each component; the largest score counts."""
    of = {"kmeans": score_kmeans, "gmm": score_gmm, "iforest": score_iforest}
    if name not in of:
        raise ValueError(f"unknown scorer {name}; known: norm, {', '.join(sorted(of))}")
    keys, flags = ["panel_id", "group"], ["fit", "evaluated"]

    def run(rows: DataFrame) -> DataFrame:
        v = settled(residual_vectors(rows, flags, window), "vectors")
        told, by = v.where("vector is not null"), keys
        if component_wise:
            told = told.select(*keys, "ts", *flags, F.posexplode("vector").alias("component", "x")).withColumn("vector", F.array("x")).drop("x")
            by = [*keys, "component"]
        scores = of[name](told.where("fit"), told, keys=by, **options)
        scores = scores.groupBy(*keys, "ts").agg(F.max("score").alias("score"))
        return v.drop("vector").join(scores, [*keys, "ts"], "left").select(*keys, "ts", *flags, "score")

    return run


# --------------------------------------------------------------- k-means
def _distances(vector: str, centres: str | Column) -> Column:
    return F.transform(centres, lambda c: F.sqrt(F.aggregate(F.zip_with(vector, c, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)))


def _farthest_first(fit: DataFrame, k: int, keys: list[str]) -> DataFrame:
    """(keys, centres): the vector of the smallest hash, then always the one farthest from those before."""
    first = fit.groupBy(*keys).agg(F.min(F.struct(F.xxhash64("vector").alias("h"), "vector")).alias("m"))
    centres = settled(first.select(*keys, F.array("m.vector").alias("centres")), "centres")
    for _ in range(k - 1):
        far = fit.join(small(centres), keys).withColumn("d", F.array_min(_distances("vector", "centres")))
        best = far.groupBy(*keys, "centres").agg(F.max_by("vector", F.struct("d", "vector")).alias("v"))
        centres = settled(best.select(*keys, F.concat("centres", F.array("v")).alias("centres")), "centres")
    return centres


def fit_kmeans(fit: DataFrame, ks: list[int], rounds: int = 10, keys: list[str] = PANEL) -> DataFrame:
    """(keys, k, centres): k-means of every key and every k of ``ks`` at once, ``rounds`` rounds."""
    starts = _farthest_first(fit, max(ks), keys)
    centres = settled(starts.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks]))).withColumn("centres", F.slice("centres", 1, F.col("k"))), "centres")
    by = [*keys, "k"]
    for _ in range(rounds):
        told = fit.join(small(centres), keys).withColumn("d", _distances("vector", "centres"))
        told = told.withColumn("c", F.array_position("d", F.array_min("d"))).select(*by, "c", F.posexplode("vector").alias("i", "x"))
        means = told.groupBy(*by, "c", "i").agg(F.avg("x").alias("x")).groupBy(*by, "c").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("v"))
        means = means.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("c", F.col("v.x").alias("v")))).alias("a"))
        centres = settled(means.select(*by, F.col("a.v").alias("centres")), "centres")
    return centres


def choose_k(fit: DataFrame, centres: DataFrame, elbow: str = "silhouette", keys: list[str] = PANEL) -> DataFrame:
    """(keys, centres): the chosen k of each key.

    ``silhouette``: the largest mean of (b - a) / max(a, b), a and b the distances to the own and to
    the next centre (0 for k = 1). ``second_derivative``: where the fall of the within-cluster sum
    bends most. ``kneedle``: where it is farthest below the line between its ends.
    """
    told = fit.join(small(centres), keys).withColumn("d", F.array_sort(_distances("vector", "centres")))
    a, b = F.col("d")[0], F.get("d", F.lit(1))
    sums = settled(told.groupBy(*keys, "k").agg(F.sum(a * a).alias("w"), F.avg(F.coalesce(F.try_divide(b - a, F.greatest(a, b)), F.lit(0.0))).alias("s")), "elbow")
    w = Window.partitionBy(*keys).orderBy("k")  # as many rows as ks
    if elbow == "silhouette":
        worth = F.col("s")
    elif elbow == "second_derivative":
        worth = F.coalesce(F.lag("w").over(w) - 2 * F.col("w") + F.lead("w").over(w), F.lit(float("-inf")))
    elif elbow == "kneedle":
        every = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        part = lambda c: F.coalesce(F.try_divide(F.col(c) - F.min(c).over(every), (F.max(c).over(every) - F.min(c).over(every)).cast("double")), F.lit(0.0))
        worth = 1 - part("k") - part("w")
    else:
        raise ValueError("elbow: silhouette, second_derivative or kneedle")
    best = sums.withColumn("worth", worth).groupBy(*keys).agg(F.min_by("k", F.struct(-F.col("worth"), F.col("k"))).alias("k"))
    return centres.join(small(best), [*keys, "k"]).select(*keys, "centres")


def score_kmeans(fit: DataFrame, rows: DataFrame, k: int | str = 3, keys: list[str] = PANEL, k_min: int = 1, k_max: int = 6, elbow: str = "silhouette", rounds: int = 10) -> DataFrame:
    """(keys, ts, score): the distance to the nearest centre of the key. ``k``: a number, or ``auto``: of
    ``k_min`` to ``k_max`` by ``elbow``, for each key."""
    if k == "auto":
        centres = choose_k(fit, fit_kmeans(fit, list(range(k_min, k_max + 1)), rounds, keys), elbow, keys)
    else:
        centres = fit_kmeans(fit, [int(k)], rounds, keys)
    return rows.join(small(centres.select(*keys, "centres")), keys).select(*keys, "ts", F.array_min(_distances("vector", "centres")).alias("score"))


# --------------------------------------------------------------- Gaussian mixture
def _schema(df: DataFrame, keys: list[str], rest: str) -> T.StructType:
    return T.StructType([*(df.schema[c] for c in keys), *T.StructType.fromDDL(rest).fields])


def _densities(x: np.ndarray, k: int, model: np.ndarray) -> np.ndarray:
    """log(weight * density) of each row of ``x`` and each of ``k`` components; ``model``: weights, means, covariances."""
    d = x.shape[1]
    weight, mean, cov = model[:k], model[k : k + k * d].reshape(k, d), model[k + k * d :].reshape(k, d, d)
    out = np.empty((len(x), k))
    for i in range(k):
        root = np.linalg.cholesky(cov[i])
        z = np.linalg.solve(root, (x - mean[i]).T)
        out[:, i] = np.log(max(weight[i], 1e-300)) - 0.5 * ((z * z).sum(axis=0) + d * np.log(2 * np.pi)) - np.log(np.diag(root)).sum()
    return out


def _log_sum(logs: np.ndarray) -> np.ndarray:
    top = logs.max(axis=1, keepdims=True)
    return top[:, 0] + np.log(np.exp(logs - top).sum(axis=1))


def fit_gmm(fit: DataFrame, most: int = 3, rounds: int = 15, keys: list[str] = PANEL) -> DataFrame:
    """(keys, k, model): a Gaussian mixture of full covariances for each key, its size from 1 to ``most`` by BIC.

    Expectation maximisation of all keys and sizes at once: each round, a batch gives sums for each
    of its keys, which are added up and solved. Components start along the spread of their key
    (mean and covariance are exact for one component); 1e-6 of the mean variance is added to the diagonal.
    """
    sums = _schema(fit, keys, "k int, n double, likelihood double, sums array<double>")
    model = _schema(fit, keys, "k int, n double, likelihood double, model array<double>")

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for (*key, k), g in batch.groupby([*keys, "k"]):
                x = np.array(list(g["vector"]), dtype=float)
                now = g["model"].iloc[0]
                logs = np.zeros((len(x), k)) if now is None else _densities(x, k, np.asarray(now, dtype=float))
                total = _log_sum(logs)
                r = np.exp(logs - total[:, None])
                if now is None:  # the first round: all rows in each component, spread apart when solved
                    r = np.full((len(x), k), 1.0)
                second = np.einsum("nk,ni,nj->kij", r, x, x)
                out.append((*key, k, float(len(x)), float(total.sum()), np.concatenate([r.sum(axis=0), (r.T @ x).ravel(), second.ravel()]).tolist()))
            yield pd.DataFrame(out, columns=sums.names)

    def solve(parts: pd.DataFrame) -> pd.DataFrame:
        k, n = int(parts["k"].iloc[0]), parts["n"].sum()
        s = np.sum([np.asarray(x) for x in parts["sums"]], axis=0)
        d = int(round((np.sqrt(1 + 4 * (len(s) / k - 1)) - 1) / 2))
        r, first, second = s[:k], s[k : k + k * d].reshape(k, d), s[k + k * d :].reshape(k, d, d)
        mean = first / np.maximum(r, 1e-12)[:, None]
        cov = second / np.maximum(r, 1e-12)[:, None, None] - np.einsum("ki,kj->kij", mean, mean)
        floor = 1e-6 * max(float(np.trace(cov.mean(axis=0))) / d, 1e-9)
        cov = (cov + cov.transpose(0, 2, 1)) / 2 + floor * np.eye(d)
        for i in range(k):  # what rounding may take below zero
            values, vectors = np.linalg.eigh(cov[i])
            cov[i] = (vectors * np.maximum(values, floor)) @ vectors.T
        if starting:
            mean = mean + np.sqrt(np.diag(cov[0])) * np.linspace(-1, 1, k)[:, None] * (k > 1)
            r = np.full(k, n / k)
        return pd.DataFrame([(*[parts[c].iloc[0] for c in keys], k, n, parts["likelihood"].sum(), np.concatenate([r / r.sum(), mean.ravel(), cov.ravel()]).tolist())], columns=model.names)

    starting = True
    vectors = fit.select(*keys, "vector")
    sizes = F.explode(F.array(*[F.lit(k) for k in range(1, most + 1)]))
    first = vectors.withColumn("k", sizes).withColumn("model", F.lit(None).cast("array<double>"))
    now = settled(first.mapInPandas(partial, sums).groupBy(*keys, "k").applyInPandas(solve, model), "mixture")
    starting = False
    for _ in range(rounds + 1):  # the likelihood of a model is told by the round after it
        last = now
        told = vectors.join(small(last.select(*keys, "k", "model")), keys)
        now = settled(told.mapInPandas(partial, sums).groupBy(*keys, "k").applyInPandas(solve, model), "mixture")
    d = (F.sqrt(1 + 4 * (F.size("model") / F.col("k") - 1)) - 1) / 2
    free = F.col("k") - 1 + F.col("k") * d + F.col("k") * d * (d + 1) / 2
    told = last.select(*keys, "k", "model").join(now.select(*keys, "k", "n", "likelihood"), [*keys, "k"])
    told = told.withColumn("bic", free * F.log("n") - 2 * F.col("likelihood"))
    return told.groupBy(*keys).agg(F.min_by(F.struct("k", "model"), F.struct("bic", "k")).alias("b")).select(*keys, "b.*")


def score_gmm(fit: DataFrame, rows: DataFrame, most: int = 3, rounds: int = 15, keys: list[str] = PANEL) -> DataFrame:
    """(keys, ts, score): minus the log-likelihood under the key's Gaussian mixture, its size by BIC."""
    models = settled(fit_gmm(fit, most, rounds, keys), "mixture")
    out = _schema(rows, [*keys, "ts"], "score double")

    def told(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, g in batch.groupby(keys):
                logs = _densities(np.array(list(g["vector"]), dtype=float), int(g["k"].iloc[0]), np.asarray(g["model"].iloc[0], dtype=float))
                yield g[[*keys, "ts"]].assign(score=-_log_sum(logs))

    return rows.select(*keys, "ts", "vector").join(small(models), keys).mapInPandas(told, out)


# --------------------------------------------------------------- isolation forest
def score_iforest(fit: DataFrame, rows: DataFrame, trees: int = 50, sample: int = 256, seed: int = 42, keys: list[str] = PANEL) -> DataFrame:
    """(keys, ts, score): isolation-forest score in (0, 1).

    Each tree has its own hash sample of each key, ``sample`` rows in expectation (the method's own
    subsampling); trees are built side by side. Rows meet their key's trees in time buckets, so that no
    task holds a key's rows.
    """
    sizes = fit.groupBy(*keys).agg(F.count("*").alias("n"))
    drawn = fit.select(*keys, "ts", "vector").join(small(sizes), keys).withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
    drawn = drawn.where(F.pmod(F.xxhash64(*keys, "ts", "tree", F.lit(seed)), F.lit(1 << 30)) <= F.lit(sample) / F.col("n") * (1 << 30))
    grown = _schema(fit, keys, "tree int, size int, nodes array<double>")

    def grow(g: pd.DataFrame) -> pd.DataFrame:
        x = np.array(list(g.sort_values("ts")["vector"]), dtype=float)
        rng = np.random.default_rng([seed, int(g["tree"].iloc[0])])
        depth = int(np.ceil(np.log2(max(len(x), 2))))
        nodes: list[list[float]] = []  # feature (-1: leaf), cut or path length, left, right

        def build(at: np.ndarray, level: int) -> int:
            here = len(nodes)
            nodes.append([-1.0, level + _mean_path(len(at)), 0.0, 0.0])
            spread = np.flatnonzero(np.ptp(x[at], axis=0) > 0) if len(at) > 1 else np.zeros(0, dtype=int)
            if level < depth and len(spread):
                f = int(rng.choice(spread))
                cut = rng.uniform(x[at, f].min(), x[at, f].max())
                left = x[at, f] < cut
                nodes[here] = [f, cut, build(at[left], level + 1), build(at[~left], level + 1)]
            return here

        build(np.arange(len(x)), 0)
        return pd.DataFrame([(*[g[c].iloc[0] for c in keys], int(g["tree"].iloc[0]), len(x), np.array(nodes).ravel().tolist())], columns=grown.names)

    forest = settled(drawn.groupBy(*keys, "tree").applyInPandas(grow, grown), "forest")
    placed = rows.select(*keys, "ts", "vector").withColumn("bucket", F.floor(S.micros(F.col("ts")) / F.lit(BUCKET * S.MICROS)))
    by = [*keys, "bucket"]
    met = placed.select(*by).distinct().join(small(forest), keys).select(*[F.col(c).alias(f"__{c}") for c in by], "size", "nodes")
    out = _schema(rows, [*keys, "ts"], "score double")

    def told(g: pd.DataFrame, trees_: pd.DataFrame) -> pd.DataFrame:
        if not len(g):
            return pd.DataFrame({c: [] for c in out.names})
        x, total, norm = np.array(list(g["vector"]), dtype=float), np.zeros(len(g)), 0.0
        for size, flat in zip(trees_["size"], trees_["nodes"], strict=True):
            nodes, at = np.asarray(flat, dtype=float).reshape(-1, 4), np.zeros(len(x), dtype=int)
            while (go := nodes[at, 0] >= 0).any():
                f, n = nodes[at, 0].astype(int), nodes[at]
                at = np.where(go, np.where(x[np.arange(len(x)), f] < n[:, 1], n[:, 2], n[:, 3]), at).astype(int)
            total += nodes[at, 1]
            norm += _mean_path(size)
        return g[[*keys, "ts"]].assign(score=2.0 ** (-total / norm) if norm else np.nan)

    return placed.groupBy(*by).cogroup(met.groupBy(*[f"__{c}" for c in by])).applyInPandas(told, out)


def _mean_path(n: int) -> float:
    """The mean depth of an unsuccessful search among ``n`` rows."""
    return 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else float(n == 2)
