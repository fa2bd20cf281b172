"""Values of operators that SQL does not express, against plain numpy."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import imputation, models, windows

START = datetime(2024, 1, 1)


def panel(spark, **channels):
    rows = [("p", c, START + timedelta(hours=i), None if v is None or np.isnan(v) else float(v)) for c, values in channels.items() for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "panel_id string, channel string, ts timestamp, value double")


def lagged(y, p):
    """(X, y) of the rows that have ``p`` lags, the last value first."""
    return np.column_stack([y[p - k - 1 : len(y) - k - 1] for k in range(p)]), y[p:]


def walk(n, seed):
    rng, y = np.random.default_rng(seed), [3.0, 2.0]
    for _ in range(n):
        y.append(1 + 0.6 * y[-1] - 0.3 * y[-2] + rng.normal())
    return np.array(y)


def test_residual_windows(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=20), rng.normal(size=20)
    got = windows.residual_windows(panel(spark, b=b, a=a).withColumn("residual", F.col("value")), 3).orderBy("ts").collect()
    assert [r["channels"] for r in got] == [2] * 18
    for i, r in enumerate(got, 2):
        assert r["vector"] == pytest.approx([a[i], a[i - 1], a[i - 2], b[i], b[i - 1], b[i - 2]])


def test_injected_gaps(spark):
    v = np.arange(200.0)
    v[[17, 18, 60]] = np.nan
    df = panel(spark, a=v, b=np.arange(7.0), c=[np.nan] * 30)
    got = imputation.inject_gaps(df, 4, 6).orderBy("channel", "ts").collect()
    again = imputation.inject_gaps(df.repartition(7, "ts"), 4, 6).orderBy("channel", "ts").collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in again] and len(got) == 237
    by = {c: [r for r in got if r["channel"] == c] for c in "abc"}
    for c, values in (("a", v), ("b", np.arange(7.0))):
        hit = [r["injected"] for r in by[c]]
        edges = np.flatnonzero(np.diff([0, *map(int, hit), 0]))
        runs = list(zip(edges[::2], edges[1::2]))
        assert len(runs) == (6 if c == "a" else 1) and all(b - a == 4 for a, b in runs)  # none touches another, or it would be longer
        for r, x in zip(by[c], values):
            assert (r["original"] is None) == np.isnan(x) and (r["value"] is None) == (np.isnan(x) or r["injected"])
            assert not (r["injected"] and np.isnan(x))
    assert not any(r["injected"] for r in by["c"])
    other = [r["injected"] for r in imputation.inject_gaps(df, 4, 6, seed=7).where("channel = 'a'").orderBy("ts").collect()]
    assert other != [r["injected"] for r in by["a"]]


def test_imputation_benchmark(spark):
    rng = np.random.default_rng(2)
    a, sparse = rng.normal(10, 3, 150), rng.normal(size=60)
    sparse[::2] = np.nan  # over 30 % missing: left out
    df = panel(spark, a=a, sparse=sparse)
    got = {r["method"]: r for r in imputation.benchmark_imputation(df, ["mean", "forward_fill", "linear_interpolation"], 5, 4).collect()}
    holes = [r["injected"] for r in imputation.inject_gaps(df.where("channel = 'a'"), 5, 4).orderBy("ts").collect()]
    v = np.where(holes, np.nan, a)
    seen = np.flatnonzero(~np.isnan(v))
    at = np.flatnonzero(holes)
    carried = np.array([v[seen[seen <= i][-1]] if (seen <= i).any() else v[seen[0]] for i in at])
    fills = {"mean": np.full(len(at), np.nanmean(v)), "forward_fill": carried, "linear_interpolation": np.interp(at, seen, v[seen])}
    assert got.keys() == fills.keys() and {r["channel"] for r in got.values()} == {"a"}
    for name, f in fills.items():
        e = f - a[at]
        assert [got[name][c] for c in ("mae", "rmse", "mape", "n")] == pytest.approx([np.abs(e).mean(), np.sqrt((e**2).mean()), np.abs(e / a[at]).mean() * 100, len(at)])


@pytest.mark.parametrize(("kind", "l1"), [("lasso", 1.0), ("elasticnet", 0.4)])
def test_sparse_models_are_at_their_minimum(spark, kind, l1):
    y, alpha = walk(400, 3), 0.08
    row = models.fit_linear(panel(spark, a=y), kind, 5, alpha, l1).first()
    x, t = lagged(y, 5)
    b, sigma = np.array(row["coef"]), t.std()
    # in units of the target's spread: |t - Xb|^2 / 2n + alpha (l1 |b|_1 + (1 - l1) |b|^2 / 2)
    xs, ts = (x - x.mean(axis=0)) / sigma, (t - t.mean()) / sigma
    slope = -xs.T @ (ts - xs @ b) / len(t) + alpha * (1 - l1) * b
    used = np.abs(b) > 1e-9
    assert 0 < used.sum() < 5 or l1 < 1
    assert slope[used] == pytest.approx(-alpha * l1 * np.sign(b[used]), abs=1e-6)
    assert (np.abs(slope[~used]) <= alpha * l1 + 1e-6).all()
    assert row["intercept"] == pytest.approx(t.mean() - b @ x.mean(axis=0))


def test_bayesian_ridge_is_a_fixed_point_of_the_evidence(spark):
    y = walk(300, 4)
    row = models.fit_linear(panel(spark, a=y), "bayesianridge", 3).first()
    x, t = lagged(y, 3)
    sigma = t.std()
    xs, ts = (x - x.mean(axis=0)) / sigma, (t - t.mean()) / sigma
    b = np.array(row["coef"])
    # precisions that these weights call for, and the weights that these precisions give
    prior, noise = 1.0, 1.0
    values = np.linalg.eigvalsh(xs.T @ xs)
    for _ in range(200):
        used = (noise * values / (prior + noise * values)).sum()
        prior, noise = (used + 2e-6) / (b @ b + 2e-6), (len(t) - used + 2e-6) / (((ts - xs @ b) ** 2).sum() + 2e-6)
    assert np.linalg.solve(xs.T @ xs + prior / noise * np.eye(3), xs.T @ ts) == pytest.approx(b, abs=1e-4)
    assert b[:2] == pytest.approx([0.6, -0.3], abs=0.15)


def test_auto_clean_marks_what_no_lag_tells(spark):
    y = walk(400, 5)
    y[200] += 40
    df = imputation.impute(panel(spark, a=y))
    got = models.auto_clean(df, lags=4, factor=8.0, spread=3).orderBy("ts").collect()
    x, t = lagged(y, 4)
    b = np.linalg.solve((x - x.mean(axis=0)).T @ (x - x.mean(axis=0)) / t.var() + np.eye(4), (x - x.mean(axis=0)).T @ (t - t.mean()) / t.var())
    r = np.concatenate([[np.nan] * 4, np.abs(t - t.mean() - (x - x.mean(axis=0)) @ b)])
    median = np.nanmedian(r)
    hit = r > median + 8 * np.nanmedian(np.abs(r - median))
    want = [bool(hit[max(i - 3, 0) : i + 4].any()) for i in range(len(y))]
    assert want[197] and want[203] and not all(want)
    assert [x_["cleaned"] for x_ in got] == want
