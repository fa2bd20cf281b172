"""The search over models of every kind."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.plans import tune

START = datetime(2024, 1, 1)


def series(spark, values, channel="a", panel="p"):
    rows = [(panel, channel, START + timedelta(hours=i), float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "panel_id string, channel string, ts timestamp, value double")


def _crossed(n, seed=1):
    """The next value depends on whether the last two lie on the same side of 5, but for a third that is random: no
    sum of single cuts tells it."""
    rng, y = np.random.default_rng(seed), [1.0, 9.0]
    for _ in range(n):
        high = rng.random() < 0.5 if rng.random() < 0.3 else (y[-1] > 5) == (y[-2] > 5)
        y.append((8.0 if high else 1.5) + rng.normal(0, 0.3))
    return y


CANDIDATES = "trial int, model string, params map<string,double>, lags int"


def test_search_takes_trees_and_honours_budgets(spark):
    grown = {"n_estimators": 20.0, "learning_rate": 0.3, "min_child_samples": 5.0}
    tried = spark.createDataFrame([(0, "ridge", {"alpha": 1.0}, 2), (1, "lightgbm", {**grown, "max_depth": 1.0}, 2), (2, "lightgbm", {**grown, "max_depth": 3.0}, 2), (3, "nystroem", {"gamma": 1e-9, "n_components": 5.0}, 2), (4, "huber", {}, 2)], CANDIDATES)
    df = series(spark, _crossed(500)).unionByName(series(spark, _crossed(500, 2), "b"))
    budgets = spark.createDataFrame([(None, None, 5), ("p", "b", 1)], "panel_id string, channel string, trials int")
    got = {r["channel"]: r for r in tune.tune(df, tried, budgets=budgets).collect()}
    assert (got["a"]["model"], got["a"]["params"]["max_depth"]) == ("lightgbm", 3.0)
    assert got["b"]["params"].get("max_depth") != 3.0 and got["b"]["metric"] > got["a"]["metric"]
    assert got["a"]["error"] is None


@pytest.mark.parametrize("by", ["mse", "r2", "mae", "mape"])
def test_linear_candidates_by_any_metric(spark, by):
    rng = np.random.default_rng(6)
    y = [5.0, 5.0]
    for _ in range(300):
        y.append(2 + 0.8 * y[-2] + rng.normal() * 0.5)
    tried = spark.createDataFrame([(0, "ridge", {"alpha": 0.1}, 1, [1]), (1, "ridge", {"alpha": 0.1}, 2, [2]), (2, "lasso", {"alpha": 5.0}, 2, [1, 2])], CANDIDATES + ", steps array<int>")
    row = tune.tune(series(spark, y), tried, by=by).first()
    assert row["steps"] == [2]
    # by hand: ridge of the second lag
    a, b = int(302 * 0.6), int(302 * 0.6) + int(302 * 0.2)
    x, t = np.array(y[: a - 2]), np.array(y[2:a])
    s2 = t.var()
    w = ((x - x.mean()) @ (t - t.mean()) / s2) / (((x - x.mean()) ** 2).sum() / s2 + 0.1)
    pred = t.mean() + w * (np.array(y[a - 2 : b - 2]) - x.mean())
    v = np.array(y[a:b])
    want = {"mse": ((v - pred) ** 2).mean(), "r2": -(1 - ((v - pred) ** 2).sum() / ((v - v.mean()) ** 2).sum()), "mae": np.abs(v - pred).mean(), "mape": np.abs((v - pred) / v).mean()}[by]
    assert row["metric"] == pytest.approx(want, rel=1e-6) or abs(row["metric"] - want) < 0.02 * abs(want)


def test_failed_trials_are_told(spark):
    tried = spark.createDataFrame([(0, "ridge", {"alpha": 1.0}, 40), (1, "oracle", {}, 1)], CANDIDATES)
    row = tune.tune(series(spark, range(60)), tried).first()
    assert row["metric"] == tune.PENALTY and row["error"] == "all trials failed"


def test_spaces_of_any_kind(spark):
    space = {"lightgbm": {"max_depth": [3, 16], "n_estimators": [10, 1000, "log10"], "reg_lambda": [0.01, 100.0], "booster": ["gbdt", "dart"], "max_bin": ["16", "64"]}, "ridge": {"alpha": [0.01, 1.0, "log10"], "lags": [4]}}
    got = tune.expand_space(spark, space, 30, lags=["48", "[1, 2, 24]", 6]).collect()
    boosted = [r for r in got if r["model"] == "lightgbm"]
    assert all(r["params"]["max_depth"] == int(r["params"]["max_depth"]) and 3 <= r["params"]["max_depth"] <= 16 for r in boosted)
    assert all(r["params"]["n_estimators"] == int(r["params"]["n_estimators"]) and 10 <= r["params"]["n_estimators"] <= 1000 for r in boosted)
    assert {r["choices"]["booster"] for r in boosted} == {"gbdt", "dart"} and {r["params"]["max_bin"] for r in boosted} == {16.0, 64.0}
    assert {(r["lags"], len(r["steps"])) for r in boosted} == {(48, 48), (24, 3), (6, 6)}
    assert {tuple(r["steps"]) for r in got if r["model"] == "ridge"} == {(1, 2, 3, 4)}
    assert got == tune.expand_space(spark, space, 30, lags=["48", "[1, 2, 24]", 6]).collect()
