"""Gradient-boosted regression trees on binned inputs, one model a series (and trial), as table rows.

Inputs are cut into bins at quantiles of their series. A tree grows by levels: the gradients of all rows are
summed by (series, trial, node, input, bin) in one aggregate, the best cut of each node is read off the
running sums of its bins, and the nodes of all series and trials split at once. Series of up to
IN_TASK rows grow all their trees in one task each from the same bins by the same rule instead, which
saves a job a level. Trees are arrays by heap position: the children of node i are 2i + 1 and 2i + 2.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .panel import K, settled, small

#: Rows of a series up to which one task grows its trees (about 100 bytes each).
IN_TASK = 500_000
#: Parameters and their defaults; others of a specification are left aside.
DEFAULTS = {"n_estimators": 50.0, "max_depth": 4.0, "learning_rate": 0.1, "reg_lambda": 1.0, "min_child_samples": 20.0, "max_bin": 64.0}
TREES = "array<struct<depth:int,feature:array<int>,threshold:array<double>,value:array<double>>>"
J = [*K, "trial"]


def jobs(specs: DataFrame) -> DataFrame:
    """(panel_id, channel, trial, one column for each of DEFAULTS) from ``specs`` (panel_id, channel, trial, params)."""
    return specs.select(*J, *[F.coalesce(F.col("params")[name], F.lit(x)).alias(name) for name, x in DEFAULTS.items()])


def binned(rows: DataFrame, p: int, max_bin: int) -> tuple[DataFrame, DataFrame]:
    """((panel_id, channel, y, w, x), (panel_id, channel, cuts, rows)) of ``rows`` (value, lags, weight if there); both settled.

    ``x``: for each of the ``p`` inputs the number of the series' cuts below it.
    """
    weight = F.col("weight") if "weight" in rows.columns else F.lit(1.0)
    usable = rows.where("value is not null").select(*K, F.col("value").alias("y"), weight.alias("w"), "lags").where("w > 0")
    usable = settled(usable, "inputs")
    at = [i / max_bin for i in range(1, max_bin)]
    cuts = usable.groupBy(*K).agg(F.count("*").alias("rows"), F.array(*[F.array_distinct(F.percentile_approx(F.col("lags")[i], at, 10_000)) for i in range(p)]).alias("cuts"))
    cuts = settled(cuts, "cuts")
    # the last argument of filter is the input of the same place
    x = F.zip_with("cuts", "lags", lambda c, v: F.size(F.filter(c, lambda e: e < v)))
    return settled(usable.join(small(cuts.select(*K, "cuts")), K).select(*K, "y", "w", x.alias("x")), "bins"), cuts


# ------------------------------------------------------------------ in one task
def best_splits(h: np.ndarray, g: np.ndarray, n: np.ndarray, l2: float, least: float) -> list[tuple[int, int] | None]:
    """(input, bin) of the best cut of each node from its sums (nodes, inputs, bins) of weights, gradients and rows;
    the lowest input, then bin among equals; None where no cut gains."""
    lh, lg, ln = h.cumsum(axis=2), g.cumsum(axis=2), n.cumsum(axis=2)
    th, tg, tn = lh[:, :, -1:], lg[:, :, -1:], ln[:, :, -1:]
    gain = lg**2 / (lh + l2 + 1e-300) + (tg - lg) ** 2 / (th - lh + l2 + 1e-300) - tg**2 / (th + l2 + 1e-300)
    gain = np.where((ln >= least) & (tn - ln >= least), gain, -np.inf).reshape(len(h), -1)
    at = gain.argmax(axis=1)
    found = gain[np.arange(len(h)), at] > 1e-9
    return [divmod(int(a), h.shape[2]) if ok else None for a, ok in zip(at, found)]


def grow(x: np.ndarray, y: np.ndarray, w: np.ndarray, told: dict[str, float]) -> tuple[float, list[tuple[list[int], list[int], list[float]]]]:
    """(base, trees as (input or -1, bin, value) by node) of one series."""
    rounds, depth, rate, l2 = int(told["n_estimators"]), int(told["max_depth"]), told["learning_rate"], told["reg_lambda"]
    least, size, bins = max(told["min_child_samples"], 1.0), 2 ** (depth + 1) - 1, int(x.max(initial=0)) + 1
    base = float((w * y).sum() / w.sum())
    score, out = np.full(len(y), base), []
    for _ in range(rounds):
        g = w * (y - score)
        feature, cut, value = np.full(size, -1), np.zeros(size, dtype=int), np.zeros(size)
        value[0] = rate * g.sum() / (w.sum() + l2)
        node, active = np.zeros(len(y), dtype=np.int64), [0]
        for _level in range(depth):
            place = np.full(size, -1)
            place[active] = np.arange(len(active))
            here = np.flatnonzero(place[node] >= 0)
            of = place[node[here]]
            sums = lambda v: np.stack([np.bincount(of * bins + x[here, j], v, len(active) * bins).reshape(len(active), bins) for j in range(x.shape[1])], axis=1)  # noqa: E731,B023
            h, gs, n = sums(w[here]), sums(g[here]), sums(None)
            split = best_splits(h, gs, n, l2, least)
            for i, (at, found) in enumerate(zip(active, split)):
                if found is None:
                    continue
                feature[at], cut[at] = found
                lh, lg = h[i, found[0], : found[1] + 1].sum(), gs[i, found[0], : found[1] + 1].sum()
                value[2 * at + 1] = rate * lg / (lh + l2)
                value[2 * at + 2] = rate * (gs[i, found[0]].sum() - lg) / (h[i, found[0]].sum() - lh + l2)
            moved = feature[node] >= 0
            node = np.where(moved, 2 * node + 1 + (x[np.arange(len(x)), np.maximum(feature[node], 0)] > cut[node]), node)
            active = [c for at, found in zip(active, split) if found for c in (2 * at + 1, 2 * at + 2)]
            if not active:
                break
        score = score + value[node]
        out.append((feature.tolist(), cut.tolist(), value.tolist()))
    return base, out


GROWN = f"panel_id string, channel string, trial int, intercept double, n long, trees {TREES}"


def _in_tasks(bins: DataFrame, cuts: DataFrame, asked: DataFrame) -> DataFrame:
    """GROWN of the series of ``asked``: a group a series and trial, of at most IN_TASK rows."""

    def run(key: tuple, rows: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        if rows.empty or told.empty:
            return pd.DataFrame(columns=["panel_id", "channel", "trial", "intercept", "n", "trees"])
        t = told.iloc[0]
        x = np.array(rows["x"].tolist(), dtype=np.int64).reshape(len(rows), -1)
        base, trees = grow(x, rows["y"].to_numpy(), rows["w"].to_numpy(), {k: float(t[k]) for k in DEFAULTS})
        edges = [list(c) for c in t["cuts"]]
        out = [{"depth": int(t["max_depth"]), "feature": f, "threshold": [float(edges[i][c]) if i >= 0 else 0.0 for i, c in zip(f, cut)], "value": v} for f, cut, v in trees]
        return pd.DataFrame([(*key, base, len(rows), out)], columns=["panel_id", "channel", "trial", "intercept", "n", "trees"])

    rows = bins.join(small(asked.select(*K, F.col("trial").alias("t"))), K).withColumnRenamed("t", "trial")
    return rows.groupBy(*J).cogroup(asked.join(small(cuts.select(*K, "cuts")), K).groupBy(*J)).applyInPandas(run, GROWN)


# ------------------------------------------------------------------ by levels
def _step(n: Column, x: Column, feature: Column, cut: Column) -> Column:
    return F.when(feature >= 0, 2 * n + 1 + (F.get(x, feature) > cut).cast("int")).otherwise(n)


def walked(splits: Column, x: Column, levels: int) -> Column:
    """The node that ``x`` comes to in ``levels`` steps by ``splits`` (node -> (feature, cut))."""
    if not levels:
        return F.lit(0)
    return F.aggregate(F.sequence(F.lit(1), F.lit(levels)), F.lit(0), lambda n, _: F.when(splits[n].isNotNull(), _step(n, x, splits[n]["feature"], splits[n]["cut"])).otherwise(n))


def _level(state: DataFrame, asked: DataFrame, nodes: DataFrame | None, level: int) -> DataFrame:
    """(J, node, feature, cut, and the weights and gradients left of it and in all) of the nodes of ``level`` that split."""
    if nodes is None:
        at = state.withColumn("node", F.lit(0))
    else:
        splits = nodes.groupBy(*J).agg(F.map_from_entries(F.collect_list(F.struct("node", F.struct("feature", "cut")))).alias("splits"))  # a tree's nodes
        at = state.join(small(splits), J).withColumn("node", walked(F.col("splits"), F.col("x"), level)).where(F.col("node") >= 2**level - 1)
    g = F.col("w") * (F.col("y") - F.col("score"))
    cells = at.select(*J, "node", "w", g.alias("g"), F.posexplode("x").alias("feature", "cut"))
    sums = cells.groupBy(*J, "node", "feature", "cut").agg(F.sum("w").alias("h"), F.sum("g").alias("g"), F.count("*").alias("n"))
    every = Window.partitionBy(*J, "node", "feature")  # an input's bins
    upto = every.orderBy("cut")
    both = sums.select(*J, "node", "feature", "cut", *[F.sum(c).over(w).alias(f"{side}{c}") for c in "hgn" for w, side in ((upto, "l"), (every, "t"))])
    both = both.join(small(asked.where(F.col("max_depth") > level).select(*J, "reg_lambda", F.greatest("min_child_samples", F.lit(1.0)).alias("least"))), J)
    part = lambda g, h: g * g / (h + F.col("reg_lambda") + F.lit(1e-300))
    gain = part(F.col("lg"), F.col("lh")) + part(F.col("tg") - F.col("lg"), F.col("th") - F.col("lh")) - part(F.col("tg"), F.col("th"))
    good = both.withColumn("gain", gain).where("ln >= least and tn - ln >= least and gain > 1e-9")
    best = F.max_by(F.struct("feature", "cut", "lh", "lg", "th", "tg"), F.struct("gain", -F.col("feature"), -F.col("cut")))
    return settled(good.groupBy(*J, "node").agg(best.alias("b")).select(*J, "node", "b.*"), "splits")


def _by_levels(bins: DataFrame, cuts: DataFrame, asked: DataFrame) -> DataFrame:
    """GROWN of series of any length: an aggregate a level, over all series and trials of ``asked``."""
    rows = bins.join(small(asked.select(*J)), K)
    base = settled(rows.groupBy(*J).agg((F.sum(F.col("w") * F.col("y")) / F.sum("w")).alias("intercept"), F.count("*").alias("n")), "bases")
    state = settled(rows.join(small(base), J).select(*J, "y", "w", "x", F.col("intercept").alias("score")), "state")
    most = asked.agg(F.max("n_estimators"), F.max("max_depth")).first()
    grown: DataFrame | None = None
    for tree in range(int(most[0])):
        live = settled(asked.where(F.col("n_estimators") > tree), "live")
        nodes, told = None, state.join(small(live.select(*J)), J, "left_semi") if tree else state
        for level in range(int(most[1])):
            more = _level(told, live, nodes, level)
            nodes = more if nodes is None else settled(nodes.unionByName(more), "nodes")
        value = lambda g, h: F.col("learning_rate") * g / (h + F.col("reg_lambda"))
        split = nodes.join(small(live.select(*J, "learning_rate", "reg_lambda")), J)
        left, right = value(F.col("lg"), F.col("lh")), value(F.col("tg") - F.col("lg"), F.col("th") - F.col("lh"))
        leaves = split.select(*J, F.explode(F.array(F.struct((2 * F.col("node") + 1).alias("node"), left.alias("value")), F.struct((2 * F.col("node") + 2).alias("node"), right.alias("value")))).alias("v")).select(*J, "v.*")
        as_map = lambda df, *c: df.groupBy(*J).agg(F.map_from_entries(F.collect_list(F.struct("node", *c))).alias("m"))
        tree_ = as_map(nodes, F.struct("feature", "cut")).withColumnRenamed("m", "splits").join(as_map(leaves, "value").withColumnRenamed("m", "leaves"), J)
        # a root that does not split still has a value
        root = told.groupBy(*J).agg(F.sum(F.col("w") * (F.col("y") - F.col("score"))).alias("g"), F.sum("w").alias("h")).join(small(live.select(*J, "learning_rate", "reg_lambda")), J).select(*J, value(F.col("g"), F.col("h")).alias("root"))
        tree_ = settled(root.join(tree_, J, "left").withColumn("tree", F.lit(tree)), "tree")
        grown = tree_ if grown is None else grown.unionByName(tree_)
        if tree + 1 < int(most[0]):
            moved = state.join(small(tree_), J, "left")
            at = F.when(F.col("splits").isNotNull(), walked(F.col("splits"), F.col("x"), int(most[1]))).otherwise(0)
            gained = F.when(F.col("tree").isNull(), 0.0).otherwise(F.coalesce(F.col("leaves")[at], F.col("root")))
            state = settled(moved.select(*J, "y", "w", "x", (F.col("score") + gained).alias("score")), "state")
    out = grown.join(small(asked.select(*J, "max_depth")), J).join(small(cuts.select(*K, "cuts")), K)
    nodes_ = F.sequence(F.lit(0), F.pow(F.lit(2), F.col("max_depth") + 1).cast("int") - 2)
    at = lambda i: F.col("splits")[i]
    none = F.col("splits").isNull()
    shape = F.struct(
        F.col("max_depth").cast("int").alias("depth"),
        F.transform(nodes_, lambda i: F.when(none, -1).otherwise(F.coalesce(at(i)["feature"], F.lit(-1)))).alias("feature"),
        F.transform(nodes_, lambda i: F.coalesce(F.get(F.get("cuts", at(i)["feature"]), at(i)["cut"]), F.lit(0.0))).alias("threshold"),
        F.transform(nodes_, lambda i: F.when(i == 0, F.col("root")).otherwise(F.coalesce(F.col("leaves")[i], F.lit(0.0)))).alias("value"),
    )
    trees = out.groupBy(*J).agg(F.sort_array(F.collect_list(F.struct("tree", shape.alias("t")))).alias("a"))
    return base.join(trees, J).select(*J, "intercept", "n", F.col("a.t").cast(TREES).alias("trees"))


def fit(rows: DataFrame, specs: DataFrame, p: int, in_task: int = IN_TASK) -> DataFrame:
    """(panel_id, channel, trial, intercept, n, trees) of ``specs`` (panel_id, channel, trial, params; see DEFAULTS).

    ``rows``: (panel_id, channel, value, lags of length ``p``, weight if there). A weight counts as that many rows
    in sums; of 0 not at all. Specifications that differ in ``max_bin`` are binned apart. Settled.
    """
    asked = settled(jobs(specs), "jobs")
    out = None
    for r in asked.select("max_bin").distinct().collect():  # a configuration's
        bins, cuts = binned(rows, p, int(r[0]))
        here = asked.where(F.col("max_bin") == r[0]).join(small(cuts.select(*K, "rows")), K)
        part = _in_tasks(bins, cuts, here.where(F.col("rows") <= in_task).drop("rows"))
        long = settled(here.where(F.col("rows") > in_task).drop("rows"), "long")
        if not long.isEmpty():
            part = part.unionByName(_by_levels(bins, cuts, long))
        out = part if out is None else out.unionByName(part)
    return settled(out if out is not None else rows.sparkSession.createDataFrame([], GROWN), "trees")


#: Nodes of a model table up to which every task holds it (20 bytes each).
NODES = 2_000_000


def forest(told: list[dict]) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """(depth, and by tree and node the input or -1, threshold and value) of one model's trees, which are of one shape."""
    of = lambda c, kind: np.array([t[c] for t in told], dtype=kind)
    return int(told[0]["depth"]), of("feature", np.int64), of("threshold", float), of("value", float)


def values(trees: tuple[int, np.ndarray, np.ndarray, np.ndarray], x: np.ndarray) -> np.ndarray:
    """The sum of the trees' values at each row of ``x``, all trees a step at once."""
    depth, feature, threshold, value = trees
    tree, row = np.arange(len(feature))[None], np.arange(len(x))[:, None]
    node = np.zeros((len(x), len(feature)), dtype=np.int64)
    for _ in range(depth):
        at = feature[tree, node]
        node = np.where(at >= 0, 2 * node + 1 + (x[row, np.maximum(at, 0)] > threshold[tree, node]), node)
    out = np.zeros(len(x))
    for t in range(len(feature)):  # one after the other, as a walk adds them
        out += value[t, node[:, t]]
    return out


def added(models: DataFrame) -> Callable[[Column, Column, Column], Column] | None:
    """A function of panel, channel and inputs: what the trees of ``models`` add, in batches; None where the table
    has over NODES nodes, then see ``evaluated``."""
    grown = models.where("trees is not null and size(trees) > 0").select(*K, "trees")
    size = grown.agg(F.sum(F.aggregate("trees", F.lit(0).cast("long"), lambda s, t: s + F.size(t["feature"])))).first()[0] or 0
    if size > NODES:
        return None
    table = {(r["panel_id"], r["channel"]): forest([t.asDict() for t in r["trees"]]) for r in grown.collect()}

    @F.pandas_udf("double")
    def add(panel: pd.Series, channel: pd.Series, x: pd.Series) -> pd.Series:
        out = np.zeros(len(x))
        there = x.notna()
        for key, at in pd.Series(np.arange(len(x)))[there.to_numpy()].groupby([panel[there].to_numpy(), channel[there].to_numpy()]):
            if key in table:
                rows = at.to_numpy()
                width = max(len(v) for v in x.iloc[rows])
                whole = [i for i in rows if len(x.iloc[i]) == width]
                out[whole] = values(table[key], np.array([np.asarray(x.iloc[i], dtype=float) for i in whole]))
        return pd.Series(out)

    return add


def evaluated(trees: str, x: str) -> Column:
    """The sum of the trees' values at ``x``, by walking their arrays row by row; 0 without trees."""

    def value(t: Column) -> Column:
        at = F.aggregate(F.sequence(F.lit(1), t["depth"]), F.lit(0), lambda n, _: F.when(F.get(t["feature"], n) >= 0, 2 * n + 1 + (F.get(F.col(x), F.get(t["feature"], n)) > F.get(t["threshold"], n)).cast("int")).otherwise(n))
        return F.get(t["value"], at)

    return F.coalesce(F.aggregate(F.col(trees), F.lit(0.0), lambda s, t: s + value(t)), F.lit(0.0))
