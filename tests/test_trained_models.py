"""Boosted trees and kernel models as rows: against plain Python, through training, prediction and detection."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import imputation, models, scoring, trees
from tidemark.plans import detect

START = datetime(2024, 1, 1)
K = ["panel_id", "channel"]


def series(spark, values, channel="a", panel="p"):
    rows = [(panel, channel, START + timedelta(hours=i), None if v is None else float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "panel_id string, channel string, ts timestamp, value double")


def _plain_trees(rows, cuts, told):
    """Predictions of boosted trees, grown by recursion over lists of rows (x, y, w)."""
    base = sum(w * y for _, y, w in rows) / sum(w for _, _, w in rows)
    score = [base] * len(rows)
    for _ in range(told["n_estimators"]):
        gain = [0.0] * len(rows)

        def leaf(at, score=score):
            return told["learning_rate"] * sum(rows[i][2] * (rows[i][1] - score[i]) for i in at) / (sum(rows[i][2] for i in at) + told["reg_lambda"])

        def part(at, score=score):
            return sum(rows[i][2] * (rows[i][1] - score[i]) for i in at) ** 2 / (sum(rows[i][2] for i in at) + told["reg_lambda"])

        def split(at, depth, gain=gain, leaf=leaf, part=part):
            best = None
            for j, edges in enumerate(cuts if depth < told["max_depth"] else []):
                for c in edges:
                    left, right = [i for i in at if rows[i][0][j] <= c], [i for i in at if rows[i][0][j] > c]
                    if min(len(left), len(right)) < told["min_child_samples"]:
                        continue
                    g = part(left) + part(right) - part(at)
                    if g > 1e-9 and (best is None or g > best[0] + 1e-9):
                        best = g, left, right
            if best is None:
                for i in at:
                    gain[i] = leaf(at)
                return
            split(best[1], depth + 1)
            split(best[2], depth + 1)

        split(list(range(len(rows))), 0)
        score = [a + b for a, b in zip(score, gain)]
    return score


@pytest.mark.parametrize("in_task", [1_000_000, 0])
def test_trees_equal_plain_python(spark, in_task):
    rng = np.random.default_rng(11)
    told = {"n_estimators": 3, "max_depth": 3, "learning_rate": 0.5, "reg_lambda": 1.0, "min_child_samples": 4, "max_bin": 16}
    data = []
    for c in "ab":
        for _ in range(90):
            x = [float(v) for v in rng.integers(0, 40, 3)]
            data.append(("p", c, x, float(np.sin(x[0]) * 20 + (x[1] > 17) * 9 + rng.normal()) + (100 if c == "b" else 0), float(rng.integers(0, 4))))
    df = spark.createDataFrame(data, "panel_id string, channel string, lags array<double>, value double, weight double")
    specs = df.select(*K).distinct().select(*K, F.lit(0).alias("trial"), F.create_map(*[F.lit(x) for k, v in told.items() for x in (k, float(v))]).alias("params"))
    got = trees.fit(df, specs, 3, in_task)
    assert got.count() == 2 and {len(r["trees"]) for r in got.collect()} == {3}
    pred = {(r["channel"], tuple(r["lags"])): r["p"] for r in df.join(got.drop("n"), K).select("channel", "lags", (F.col("intercept") + trees.evaluated("trees", "lags")).alias("p")).collect()}
    cuts = {r["channel"]: r["cuts"] for r in trees.binned(df, 3, 16)[1].collect()}
    for c in "ab":
        rows = [(x, y, w) for _, k, x, y, w in data if k == c and w > 0]
        for (x, _, _), expected in zip(rows, _plain_trees(rows, cuts[c], told)):
            assert pred[c, tuple(x)] == pytest.approx(expected, abs=1e-9)


def test_trees_of_awkward_series(spark):
    told = {"n_estimators": 2.0, "max_depth": 2.0, "min_child_samples": 1.0}
    rows = [("p", "constant", [1.0, 2.0], 5.0), ("p", "constant", [1.0, 2.0], 5.0), ("p", "one", [1.0, 1.0], 3.0), ("p", "missing", [1.0, 1.0], None)]
    df = spark.createDataFrame(rows, "panel_id string, channel string, lags array<double>, value double")
    specs = df.select(*K).distinct().select(*K, F.lit(0).alias("trial"), F.create_map(*[F.lit(x) for kv in told.items() for x in kv]).alias("params"))
    for in_task in (10, 0):
        got = {r["channel"]: r["intercept"] for r in trees.fit(df, specs, 2, in_task).collect()}
        assert got == {"constant": 5.0, "one": 3.0}
    assert trees.fit(df.limit(0), specs, 2).count() == 0
    assert trees.fit(df, specs.limit(0), 2).count() == 0


def _bent(n, seed=3):
    """A series that no linear model follows: the next value is a step of the last one."""
    rng, y = np.random.default_rng(seed), [1.0]
    for _ in range(n):
        y.append((8.0 if y[-1] < 4 else 2.0 if y[-1] < 7 else 5.0 if y[-1] < 8 else 1.0) + rng.normal(0, 0.2))
    return y


def test_training_by_configuration_takes_trees_and_kernels(spark):
    df = imputation.impute(series(spark, _bent(500), "a").unionByName(series(spark, _bent(500, 4), "b")).unionByName(series(spark, _bent(500, 5), "c")).unionByName(series(spark, _bent(500, 6), "d")))
    spec = spark.createDataFrame(
        [(None, None, "ridge", {"alpha": 1.0}, 2), ("p", "a", "LightGBM", {"n_estimators": 30.0, "max_depth": 3.0, "learning_rate": 0.3}, 2), ("p", "b", "nystroem", {"gamma": 2.0, "n_components": 60.0, "alpha": 0.01}, 2), ("p", "d", "huber", {"epsilon": 1.5}, 2)],
        "panel_id string, channel string, model string, params map<string,double>, lags int",
    )
    told, evaluation = models.train(df, specs=spec)
    rows = {r["channel"]: r for r in told.collect()}
    assert {c: r["model"] for c, r in rows.items()} == {"a": "LightGBM", "b": "nystroem", "c": "ridge", "d": "huber"}
    errors = {r["channel"]: r["test_rmse"] for r in evaluation.collect()}
    assert errors["a"] < 0.5 and errors["b"] < 1.0 < 1.2 < min(errors["c"], errors["d"]), errors
    # the stored table predicts what the trained one does, also after other kinds were added
    again = models.predict(df, told, reach=2).where("pred is null").groupBy("channel").count().collect()
    assert {(r["channel"], r["count"]) for r in again} == {(c, 2) for c in "abcd"}


def test_trained_trees_detect(spark):
    y = _bent(600)
    y[590] += 25
    df = imputation.impute(series(spark, y))
    told, evaluation = models.train(df, "trees", 1, params={"n_estimators": 20, "learning_rate": 0.3})
    assert evaluation.first()["val_rmse"] < 0.8
    flags = scoring.combine_groups(detect.detect(df, told, detect.no_bounds(df), hist=30, q=0.99))
    assert START + timedelta(hours=590) in {r["ts"] for r in flags.where("anomaly_flag = 1").collect()}


def test_weights_leave_imputed_rows_out_of_trees(spark):
    y = _bent(400)
    holes = [None if i % 9 == 4 else v for i, v in enumerate(y)]
    df = imputation.impute(series(spark, holes))
    told, _ = models.train(df, "trees", 1, split=(100, 0, 0), params={"n_estimators": 2})
    usable = sum(1 for i in range(1, 401) if holes[i] is not None and holes[i - 1] is not None)
    assert told.first()["n"] == usable


def test_kernel_model_equals_numpy(spark):
    rng = np.random.default_rng(2)
    y = np.cumsum(rng.normal(size=300)).tolist()
    df = series(spark, y)
    specs = models._alike(df, "nystroem", 2, {"n_components": 20, "gamma": 0.3, "alpha": 0.5})
    row = models._fit_kernel_specs(df.where(F.col("ts") < START + timedelta(hours=200)), specs, [1, 2], 3600, 0).first()
    k = row["kernel"]
    x = np.array([[y[i - 1], y[i - 2]] for i in range(2, 300)])
    z = (x - np.array(k["center"])) / np.array(k["scale"])
    learn, target = z[:198], (np.array(y[2:200]) - np.mean(y[2:200])) / np.std(y[2:200])
    m = np.array(k["marks"])
    assert len(m) == 20 and all(np.isclose(learn, v).all(axis=1).any() for v in m)
    near = lambda a, b: np.exp(-0.3 * ((a[:, None] - b[None]) ** 2).sum(axis=2))
    # ridge in the kernel's own space: the same minimum whatever basis spans it
    kmm, g = near(m, m), np.column_stack([np.ones(198), near(learn, m)])
    penalty = np.zeros((21, 21))
    penalty[1:, 1:] = 0.5 * kmm
    b = np.linalg.lstsq(g.T @ g + penalty, g.T @ target, rcond=None)[0]
    expected = (np.column_stack([np.ones(len(z)), near(z, m)]) @ b) * np.std(y[2:200]) + np.mean(y[2:200])
    got = [r["pred"] for r in models.predict(df, spark.createDataFrame([row], models.MODEL + ", kernel " + models.KERNEL), reach=2).orderBy("ts").collect()]
    assert got[:2] == [None, None]
    assert np.abs(np.array(got[2:]) - expected).max() < 1e-3 * np.std(y)


def test_trees_walked_in_batches_and_row_by_row_tell_the_same(spark, monkeypatch):
    df = imputation.impute(series(spark, _bent(200)).unionByName(series(spark, [None, None, *_bent(100, 4)], "b")).unionByName(series(spark, _bent(60, 5), "c")))
    spec = spark.createDataFrame([(None, None, "trees", {"n_estimators": 7.0, "max_depth": 3.0}, 2), ("p", "c", "ridge", {"alpha": 1.0}, 3)], "panel_id string, channel string, model string, params map<string,double>, lags int")
    told, _ = models.train(df, specs=spec)
    rows = lambda: {(r["channel"], r["ts"]): r["pred"] for r in models.predict(df, told, reach=3).collect()}
    batches = rows()
    monkeypatch.setattr(trees, "NODES", 0)
    assert rows() == batches and sum(v is not None for v in batches.values()) > 300
