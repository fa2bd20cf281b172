"""Hand-computed cases."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.functions import scalar as S
from tidemark.operators import aggregates, filters, imputation, joins, ml_scorers, models, ranking, scoring, windows
from tidemark.operators.panel import exact_quantiles
from tidemark.plans import detect, tune
from tidemark.sources import tables
from tidemark.streaming import live

START = datetime(2024, 1, 1)


def series(spark, values, channel="a", panel="p"):
    rows = [(panel, channel, START + timedelta(hours=i), None if v is None else float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "panel_id string, channel string, ts timestamp, value double")


def values(df, column="value"):
    return [r[column] for r in df.orderBy("ts").collect()]


_ = None


@pytest.mark.parametrize(
    ("method", "params", "given", "expected"),
    [
        ("mean", {}, [1, 2, _, 4, 5], [1, 2, 3, 4, 5]),
        ("mean", {}, [1, _, 3, 4, _, 6, 7], [1, 2, 3, 4, 5, 6, 7]),
        ("forward_fill", {}, [1, _, _, 4], [1, 1, 1, 4]),
        ("backward_fill", {}, [1, _, _, 4], [1, 4, 4, 4]),
        ("linear_interpolation", {}, [0, _, _, 3], [0, 1, 2, 3]),
        ("linear_interpolation", {}, [_, 1, _, 3, _], [1, 1, 2, 3, 3]),
        ("knn_temporal", {}, [_, _, _], [_, _, _]),
        ("seasonal", {"period": 10000}, [1, 2, _, 4, 5], [1, 2, 3, 4, 5]),
        ("rolling_mean", {"window": 2}, [1, 2, _, 4, 5], [1, 2, 3, 4, 5]),
        ("iterative", {}, [1, _, 3], [1, 2, 3]),
        ("spline_interpolation", {}, [0, 1, _, 3, 4, 5], [0, 1, 2, 3, 4, 5]),
        ("psm", {}, [1, 2, 3, 4, 1, 2, _, _, 1, 2, 3, 4], [1, 2, 3, 4, 1, 2, 3, 4, 1, 2, 3, 4]),
    ],
)
def test_imputation(spark, method, params, given, expected):
    got = imputation.impute(series(spark, given), method, **params)
    assert values(got) == pytest.approx(expected, nan_ok=True) if None not in expected else values(got) == expected
    assert values(got, "observed") == [int(v is not None) for v in given]


def test_single_gaps_leave_longer_ones(spark):
    assert values(imputation.single_gaps(series(spark, [_, 1, _, _, 4, 5]))) == [_, 1, _, _, 4, 5]


def test_islands_do_not_change_fills(spark):
    given = [float(i % 7) if i % 11 not in (3, 4) else None for i in range(200)]
    short = imputation.impute(series(spark, given), "knn_temporal", n_neighbors=2)
    v = [x for x in given]
    for i, x in enumerate(given):
        if x is None:
            near = sorted((abs(j - i), j) for j in range(len(v)) if v[j] is not None)[:2]
            w = [1 / (d + 1) for d, _ in near]
            v[i] = sum(a * v[j] for a, (_, j) in zip(w, near)) / sum(w)
    assert values(short) == pytest.approx(v)


def test_missing_gaps(spark):
    gaps = windows.missing_gaps(series(spark, [1, _, _, 4, 5, _, 7, 8, _, _])).orderBy("start_ts").collect()
    assert [g["length"] for g in gaps] == [2, 1, 2]
    assert gaps[-1]["end_ts"] == START + timedelta(hours=9)
    assert windows.missing_gaps(series(spark, [_] * 5)).first()["length"] == 5
    assert windows.missing_gaps(series(spark, [1, 2])).count() == 0


def test_median_filter(spark):
    flow = series(spark, [5.0] * 10 + [100.0] + [5.0] * 9, "flow_1")
    other = series(spark, [5.0] * 10 + [100.0] + [5.0] * 9, "level")
    got = windows.median_filter(flow.unionByName(other), 3, "flow")
    assert values(got.where("channel = 'flow_1'"))[10] == 5.0
    assert values(got.where("channel = 'level'"))[10] == 100.0


def test_baseline_is_subtracted_and_dropped(spark):
    got = filters.adjust_by_baseline(series(spark, [20.0], "temperature").unionByName(series(spark, [5.0], "baseline")))
    assert [(r["channel"], r["value"]) for r in got.collect()] == [("temperature", 15.0)]


def test_resample_is_closed_on_the_right(spark):
    rows = [("p", "a", START + timedelta(minutes=m), float(m)) for m in (0, 30, 60, 61, 200)]
    df = spark.createDataFrame(rows, "panel_id string, channel string, ts timestamp, value double")
    assert values(windows.resample_mean(df, 3600)) == [0.0, 45.0, 61.0, None, 200.0]


def test_halo_gives_what_a_whole_window_gives(spark):
    df = series(spark, [float(i * i % 17) for i in range(300)])
    a = windows.lag_features(df, [1, 5], bucket=None).orderBy("ts").select("ts", "lags").collect()
    assert a == windows.lag_features(df, [1, 5], bucket=50 * 3600).orderBy("ts").select("ts", "lags").collect()


def test_windows_and_splits(spark):
    df = series(spark, range(500))
    got = values(windows.eval_window(df, 100))
    assert (got[0], got[-1]) == (400.0, 499.0)
    assert len(values(windows.eval_window(series(spark, range(50)), 100))) == 50
    few = series(spark, range(200))

    def unseen(**known):
        row = {"panel_id": "p", "test_start": None, "train_end": None, "train_size": None} | known
        models_ = spark.createDataFrame([tuple(row.values())], "panel_id string, test_start timestamp, train_end timestamp, train_size long")
        return windows.unseen_split(few, models_, train=60, val=10).where("unseen").count()

    assert unseen(test_start=START + timedelta(hours=180)) == 20
    assert unseen(train_end=START + timedelta(hours=120)) == 79
    assert unseen(train_size=120) == 80
    assert unseen() == 60


@pytest.mark.parametrize(("n", "start", "end", "expected"), [(50, 40, 50, "too short"), (250, 50, 150, "not enough data before test window"), (500, 300, 400, (300, 400)), (250, 150, 250, (150, 250))])
def test_adjust_window(spark, n, start, end, expected):
    row = windows.adjust_window(spark.createDataFrame([("p", n, start, end)], "panel_id string, n long, start long, end long"), 100).first()
    assert (row["problem"] or (row["window_start"], row["window_end"])) == expected


def test_bonferroni():
    assert [round(S.bonferroni(q, n), 6) for q, n in ((0.999, 1), (0.999, 2), (0.999, 4), (0.9999, 2))] == [0.999, 0.9995, 0.99975, 0.99995]


def test_combine_first_keeps_what_is_there(spark):
    merged = joins.combine_first(series(spark, [2.0, None]), series(spark, [9.0, 3.0, 3.0]), ["panel_id", "channel", "ts"])
    assert values(merged) == [2.0, 3.0, 3.0]


def test_gaps_are_classified_and_repaired(spark):
    full = series(spark, range(30))
    hole = full.where("value < 10 or value > 20")
    assert live.repair_gaps(hole, full).count() == 30
    assert live.repair_gaps(hole, hole).count() == hole.count()
    with pytest.raises(ValueError):
        live.repair_gaps(hole, None)


@pytest.mark.parametrize(("tail", "status"), [(5, "degraded"), (0, "ok"), (12, "degraded")])
def test_freshness(spark, tail, status):
    n = 40
    df = series(spark, [1.0] * (n - tail) + [None] * tail)
    row = aggregates.freshness(df, F.lit(START + timedelta(hours=n - 1)).cast("timestamp"), stale=3600).first()
    assert (row["trailing_missing"], row["status"]) == (tail, status)


def test_metrics(spark):
    df = series(spark, [1, 2, 3, 4]).join(series(spark, [1.1, 2, 2.9, 4.2]).select("ts", F.col("value").alias("pred")), "ts")
    assert tune.metric(df, "mae").first()["metric"] == pytest.approx(0.1)
    assert tune.metric(df.withColumn("pred", F.col("value")), "r2").first()["metric"] == pytest.approx(-1)
    assert tune.metric(df.withColumn("pred", F.lit(2.5)), "r2").first()["metric"] == pytest.approx(0)
    assert tune.metric(df.withColumn("pred", F.lit(None).cast("double")), "mae").first()["metric"] == 1e12


def test_ridge_matches_a_direct_solve(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    y = [50.0]
    for _i in range(300):
        y.append(50 + 0.9 * (y[-1] - 50) + rng.normal())
    row = models.fit_linear(series(spark, y), "ridge", 2, alpha=0.0).first()
    v = np.array(y)
    x = np.column_stack([np.ones(len(v) - 2), v[1:-1], v[:-2]])
    b = np.linalg.lstsq(x, v[2:], rcond=None)[0]
    assert [row["intercept"], *row["coef"]] == pytest.approx(b.tolist(), rel=1e-6)


def test_a_spike_is_flagged_in_one_region(spark):
    import numpy as np

    rng = np.random.default_rng(7)
    base = [10 + 3 * np.sin(i / 15) + rng.normal(0, 0.3) for i in range(800)]
    for i in (790, 791, 792):
        base[i] += 15
    df = imputation.impute(series(spark, base))
    trained, evaluation = models.train(df, "ridge", 6, split=(60, 10, 30))
    assert evaluation.first()["test_rmse"] > 0
    scores = scoring.combine_groups(detect.detect(df, trained, detect.no_bounds(df), hist=40))
    flagged = [r["ts"] for r in scores.where("anomaly_flag = 1").collect()]
    assert START + timedelta(hours=790) in flagged
    assert windows.anomaly_regions(scores, gap=12 * 3600).count() == 1  # twelve steps: flags follow a spike through the lags


def test_versions_and_results_round_trip(spark, tmp_path):
    df = series(spark, [1.0, 2.0])
    path = str(tmp_path / "raw")
    for name in ("20240101_000000", "20240301_000000", "live"):
        tables.write_version(df.withColumn("value", F.col("value") + len(name)), path, name)
    assert {r["version"] for r in tables.read_version(spark, path).collect()} == {"20240301_000000"}
    assert tables.read_version(spark, path, "live").count() == 2
    tables.write_panels(df, str(tmp_path / "p"))
    assert values(tables.read_panels(spark, str(tmp_path / "p"), ["p"])) == [1.0, 2.0]
    with pytest.raises(ValueError):
        filters.select_series(df, ["absent"])


def test_streams_equal_their_batch_counterparts(spark, tmp_path):
    df = series(spark, [float(i) for i in range(12)])
    fine = df.unionByName(df.withColumn("ts", F.expr("ts - interval 20 minutes")))
    fine.write.parquet(str(tmp_path / "in"))
    schema = "panel_id string, channel string, ts timestamp, value double"
    stream = live.stream_panels(spark, str(tmp_path / "in"), schema)
    q = live.stream_resample(stream, 3600).writeStream.format("memory").queryName("bins").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r["ts"]: r["value"] for r in spark.table("bins").collect()}
    batch = {r["ts"]: r["value"] for r in windows.resample_mean(fine, 3600).collect()}
    assert got and all(batch[t] == v for t, v in got.items())
    flags = fine.select("panel_id", "ts", F.lit(1).alias("anomaly_flag"))
    flags.where("hour(ts) <> 5").write.parquet(str(tmp_path / "flags"))
    sflags = spark.readStream.schema("panel_id string, ts timestamp, anomaly_flag int").parquet(str(tmp_path / "flags"))
    q = live.stream_regions(sflags, "30 minutes", "0 seconds").writeStream.format("memory").queryName("regions").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("regions").count() >= 1
    table = live.LiveTable(spark, str(tmp_path / "live"))
    table.follow(live.stream_panels(spark, str(tmp_path / "in"), schema), str(tmp_path / "c")).awaitTermination()
    table.merge(fine)  # a replay changes nothing
    assert table.read().count() == fine.count()


def test_stream_score_equals_batch_prediction(spark, tmp_path):
    df = series(spark, [float(i % 5) for i in range(20)])
    df.write.parquet(str(tmp_path / "in"))
    fixed = spark.createDataFrame([("p", "a", [1, 2], [0.5, 0.25], 1.0)], "panel_id string, channel string, lags array<int>, coef array<double>, intercept double")
    stream = live.stream_panels(spark, str(tmp_path / "in"), "panel_id string, channel string, ts timestamp, value double")
    q = live.stream_score(stream, fixed).writeStream.format("memory").queryName("scored").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert values(spark.table("scored"), "pred") == values(models.predict(df, fixed), "pred")


def test_status_and_sets(spark):
    df = series(spark, [1.0, 5.0]).unionByName(series(spark, [2.0, None], "b"))
    scores = spark.createDataFrame([("p", START + timedelta(hours=i), i, float(i)) for i in range(2)], "panel_id string, ts timestamp, anomaly_flag int, anomaly_score double")
    row = ranking.current_status(scores, df).first()
    assert (row["anomaly_flag"], row["channels"]) == (1, ["b", "a"])
    assert ranking.schema_diff(df, df.where("channel = 'a'")).collect()[0]["side"] == "live"
    assert live.stream_alerts(scores, df).count() == 1
    assert live.choose_live_base(df.where("channel = 'a'"), df).count() == 4
    assert live.ensure_min_history(df.limit(1), df, 2).count() == 4


def test_quantiles_are_exact_by_cells_and_by_arrays(spark):
    import random

    import numpy as np

    rng = random.Random(3)
    rows = [(k, rng.choice([rng.gauss(0, 1), 5.0, 1e9 * rng.random()])) for k in ("a", "b", "c") for _ in range(700)] + [("d", 4.0), ("e", None)] + [("f", 2.0)] * 300
    df = spark.createDataFrame(rows, "panel_id string, v double")
    own = spark.createDataFrame([("a", 0.3), ("b", 0.95), ("c", 0.0), ("d", 0.5), ("f", 1.0)], "panel_id string, own double")
    by = {"a": 0.3, "b": 0.95, "c": 0.0, "d": 0.5, "f": 1.0}
    for most in (10**6, 0):
        got = {r["panel_id"]: r for r in exact_quantiles(df, ["panel_id"], "v", {"x": 0.99, "y": "own", "z": 0.5}, own, most_sorted=most).collect()}
        assert set(got) == set(by)
        for k, q in by.items():
            v = [x for p, x in rows if p == k]
            assert [got[k]["x"], got[k]["y"], got[k]["z"]] == pytest.approx([np.quantile(v, p) for p in (0.99, q, 0.5)])


def residual_rows(spark, n=300, panels=("p", "q"), seed=4):
    import numpy as np

    rng = np.random.default_rng(seed)
    rows, vectors = [], {}
    for k, p in enumerate(panels):
        x = np.concatenate([rng.normal(0, 1, (n // 2, 2)), rng.normal(8 + k, 0.5, (n - n // 2, 2))])
        x[-1] = [60.0, -60.0]
        vectors[p] = x
        rows += [(p, "g", c, START + timedelta(hours=i), float(v), 0.0, i < n - 1, True) for i, r in enumerate(x) for c, v in zip("ab", r)]
    return spark.createDataFrame(rows, "panel_id string, group string, channel string, ts timestamp, value double, pred double, fit boolean, evaluated boolean"), vectors


@pytest.mark.parametrize(("name", "options"), [("kmeans", {"k": 2}), ("kmeans", {"k": "auto", "k_max": 3, "rounds": 4}), ("kmeans", {"k": "auto", "k_max": 4, "elbow": "kneedle", "rounds": 3}), ("gmm", {"most": 2, "rounds": 6}), ("iforest", {"trees": 20})])
def test_learned_scorers_rank_the_outlier_first(spark, name, options):
    rows, vectors = residual_rows(spark)
    got = ml_scorers.scorer(name, **options)(rows).toPandas()
    assert len(got) == sum(len(v) for v in vectors.values()) and got["score"].notna().all()
    for p in vectors:
        own = got[got["panel_id"] == p].sort_values("score")
        assert own["ts"].iloc[-1] == START + timedelta(hours=299)


def test_mixture_of_one_is_the_gaussian(spark):
    import numpy as np

    rows, vectors = residual_rows(spark, panels=("p",))
    got = ml_scorers.scorer("gmm", most=1, rounds=1)(rows).toPandas().sort_values("ts")
    x = vectors["p"]
    mean, cov = x[:-1].mean(axis=0), np.cov(x[:-1].T, bias=True)
    expected = 0.5 * (np.einsum("ni,ij,nj->n", x - mean, np.linalg.inv(cov), x - mean) + np.linalg.slogdet(cov)[1] + 2 * np.log(2 * np.pi))
    assert got["score"].to_numpy() == pytest.approx(expected, rel=1e-3)


def test_windows_and_components_of_scorers(spark):
    rows, vectors = residual_rows(spark, n=40, panels=("p",))
    two = ml_scorers.residual_vectors(rows, window=2).orderBy("ts").collect()
    x = vectors["p"]
    assert two[0]["vector"] is None and two[5]["vector"] == pytest.approx([*x[5], *x[4]])
    got = ml_scorers.scorer("kmeans", k=1, component_wise=True)(rows).toPandas().sort_values("ts")
    centre = x[:-1].mean(axis=0)
    assert got["score"].to_numpy() == pytest.approx(abs(x - centre).max(axis=1))
    with pytest.raises(ValueError):
        ml_scorers.scorer("none")


def test_detection_takes_a_scorer_and_window_rules(spark):
    df = imputation.impute(series(spark, [10.0 + (i * 7 % 5) / 10 + (20 if i == 395 else 0) for i in range(400)]))
    none = detect.no_bounds(df)
    for scorer in (None, ml_scorers.scorer("kmeans", k=2)):
        got = scoring.combine_groups(detect.detect(df, None, none, hist=50, scope="all", scorer=scorer, strict=True)).where("anomaly_flag = 1")
        assert START + timedelta(hours=395) in {r["ts"] for r in got.collect()}
    assert detect.detect(df, None, none, hist=100, least=100).count() == 0  # 40 unseen rows are too few
    assert detect.detect(df, None, none, hist=300, scope="all", least=100).count() == 160
    with pytest.raises(ValueError):
        detect.detect(df.withColumn("value", F.when(F.col("ts") != START + timedelta(hours=398), F.col("value"))), None, none, hist=50, scope="all", strict=True)


def test_models_by_specs_external_inputs_and_differences(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    e = rng.normal(size=300)
    y = [0.0]
    for i in range(1, 300):
        y.append(0.5 * y[-1] + 2.0 * e[i])
    df = imputation.impute(series(spark, y).unionByName(series(spark, e.tolist(), "e")))
    told, evaluation = models.train(df, "ridge", 1, alpha=1e-9, exog=["e"])
    row = told.first()
    assert row["coef"] == pytest.approx([0.5, 2.0], abs=1e-3) and evaluation.first()["test_rmse"] < 1e-2
    spec = spark.createDataFrame([(None, None, "ridge", {"alpha": 1.0}, 2), ("p", "e", "lasso", {"alpha": 0.5}, 3)], "panel_id string, channel string, model string, params map<string,double>, lags int")
    told = {r["channel"]: r for r in models.train(df, specs=spec)[0].collect()}
    assert [(told[c]["model"], len(told[c]["coef"])) for c in ("a", "e")] == [("ridge", 2), ("lasso", 3)]
    line = imputation.impute(series(spark, [3.0 * i for i in range(200)]))
    assert models.train(line, "ridge", 1, difference=True)[1].first()["test_rmse"] == pytest.approx(0, abs=1e-6)
    with pytest.raises(ValueError):
        models.train(df, specs=spec.withColumn("model", F.lit("oracle")))


def test_trees_take_many_series(spark):
    df = None
    for k in range(40):
        one = series(spark, [float((i * (k + 1)) % 7) for i in range(12)], f"c{k}")
        df = one if df is None else df.unionByName(one)
    got = models.fit_trees(df, 2, 2, 2)
    assert got.select("channel").distinct().count() == 40


def test_replay_modes(spark):
    n = 600
    df = imputation.impute(series(spark, [float(i * 7 % 5) + {100: 50, 560: 50, 595: 200}.get(i, 0) for i in range(n)]))
    at = lambda i: START + timedelta(hours=i)
    known = spark.createDataFrame([(1, at(98), at(102)), (2, at(590), at(597)), (3, at(556), at(564)), (4, at(9), at(8))], "window_id int, start_ts timestamp, end_ts timestamp")
    got = detect.replay_known(df, None, known, detect.no_bounds(df), hist=20, slack=30).toPandas()
    assert {w: set(g["mode"]) for w, g in got.groupby("window_id")} == {1: {"shift"}, 2: {"default"}, 3: {"target"}}
    assert {w: len(g) for w, g in got.groupby("window_id")} == {1: 5, 2: 8, 3: 9}
    hits = got[got["anomaly_flag"] == 1]
    assert {1, 2, 3} == set(hits["window_id"]) and at(100) in set(hits["ts"]) and at(595) in set(hits["ts"])


def test_search_picks_the_right_lags(spark):
    import numpy as np

    rng = np.random.default_rng(6)
    y = [0.0, 0.0]
    for _i in range(300):
        y.append(0.9 * y[-2] + rng.normal())
    space = {"ridge": {"alpha": [0.001, 0.01, "log10"], "lags": [1, 2]}, "lasso": {"alpha": [0.5, 0.9], "lags": [2]}}
    tried = tune.expand_space(spark, space, 12)
    assert tried.count() == 24 and all(0.001 <= r["params"]["alpha"] <= 0.9 for r in tried.collect())
    row = tune.tune(series(spark, y), tried).first()
    assert (row["model"], row["lags"]) == ("ridge", 2)


def test_huber_and_nystroem(spark):
    import numpy as np

    rng = np.random.default_rng(8)
    y = [10.0]
    for _i in range(400):
        y.append(5 + 0.5 * y[-1] + rng.normal(0, 0.1))
    spoiled = [v + (100 if i % 40 == 20 else 0) for i, v in enumerate(y)]
    row = models.fit_huber(series(spark, spoiled), 1).first()
    plain = models.fit_linear(series(spark, spoiled), "ridge", 1).first()
    line = lambda r: abs(r["intercept"] + r["coef"][0] * 10 - 10)
    assert row["model"] == "huber" and line(row) < 0.3 < line(plain)
    told = aggregates.forecast_metrics(models.fit_nystroem(series(spark, y), 1, 16)).first()
    assert told["rmse"] < 0.2


def test_asof_join_on_shared_and_repeated_times(spark):
    rows = series(spark, range(6)).unionByName(series(spark, range(6), panel="q"))
    at = lambda h: START + timedelta(hours=h)
    side = spark.createDataFrame([(at(1), 1.0, None), (at(1), 3.0, None), (at(2.5), None, 7.0), (at(4), 4.0, None)], "ts timestamp, a double, b double")
    for bucket in (3600, 7200, 86400):
        got = joins.asof_join(rows, side, ["a", "b"], bucket).where("panel_id = 'q'").orderBy("ts").collect()
        assert [(r["a"], r["b"]) for r in got] == [(None, None), (3.0, None), (3.0, None), (3.0, 7.0), (4.0, 7.0), (4.0, 7.0)]
