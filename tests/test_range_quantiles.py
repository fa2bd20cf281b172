"""Quantiles of many ranges against sorting each, and window problems."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import imputation, windows
from tidemark.operators.range_quantiles import counts_before, range_quantiles
from tidemark.plans import detect

START = datetime(2024, 1, 1)


@pytest.mark.parametrize(("width", "cuts", "few"), [(2048, 15, 1024), (16, 3, 8), (7, 2, 1)])
def test_any_ranges(spark, width, cuts, few):
    rng = random.Random(width)
    values = {k: [rng.choice([None, 1.0, 1.0, 1.0, 2.5]) if k == "ties" else rng.gauss(0, 1) if rng.random() < 0.9 else None for _ in range(n)] for k, n in (("a", 400), ("ties", 300), ("one", 1), ("none", 5))}
    values["none"] = [None] * 5
    rows = spark.createDataFrame([(k, p, v) for k, vs in values.items() for p, v in enumerate(vs)], "key string, pos long, value double")
    asks = [(k, i, *sorted((rng.randint(-5, len(vs)), rng.randint(0, len(vs) + 5))), rng.choice([0.0, 0.5, 0.99, 1.0, 0.123]), 0.01) for k, vs in values.items() for i in range(25)]
    asks += [("a", 99, 5, 4, 0.5, 0.1), ("absent", 1, 0, 9, 0.5, 0.1)]
    got = range_quantiles(rows, spark.createDataFrame(asks, "key string, ask int, lo long, hi long, q double, low double"), ["key"], {"t": "q", "l": "low"}, width, cuts, few)
    got = {(r["key"], r["ask"]): (r["t"], r["l"]) for r in got.collect()}
    want = {}
    for k, i, lo, hi, q, low in asks:
        inside = [v for p, v in enumerate(values.get(k, [])) if lo <= p <= hi and v is not None]
        if inside:
            want[k, i] = (np.quantile(inside, q), np.quantile(inside, low))
    assert got.keys() == want.keys()
    for k, pair in want.items():
        assert got[k] == pytest.approx(pair, abs=1e-12), k


def test_counts_before(spark):
    rows = spark.createDataFrame([("a", p, p % 3) for p in range(0, 100, 2)], "key string, pos long, sub int")
    ends = spark.createDataFrame([("a", i, at) for i, at in enumerate((-3, 0, 1, 15, 16, 17, 60, 99, 500))] + [("b", 0, 5)], "key string, end int, at long")
    got = {(r["key"], r["end"], r["sub"]): r["n"] for r in counts_before(rows, ends, ["key"], 16).collect() if r["n"]}
    want = {}
    for k, i, at in [tuple(r) for r in ends.collect()]:
        for p in range(0, 100, 2):
            if k == "a" and p < at:
                want[k, i, p % 3] = want.get((k, i, p % 3), 0) + 1
    assert got == want


def test_panels_without_a_window_are_told(spark):
    rows = [(p, "a", START + timedelta(hours=i), float(i % 7)) for p, n in (("long", 400), ("short", 60)) for i in range(n)]
    df = imputation.impute(spark.createDataFrame(rows, "panel_id string, channel string, ts timestamp, value double"))
    none = detect.no_bounds(df)
    assert windows.window_problems(df, none, 20).count() == 1  # 6 unseen rows leave none before the window
    told = {r["panel_id"]: r["problem"] for r in windows.window_problems(df, none, 300, scope="all", least=100).collect()}
    assert told == {"short": "too short"}
    with pytest.raises(windows.TooFewRows) as e:
        detect.detect(df, None, none, hist=300, scope="all", least=100, strict=True)
    assert e.value.panels == {"short": "too short"}
    late = none.withColumn("test_start", F.lit(START + timedelta(days=400)).cast("timestamp"))
    assert {r["problem"] for r in windows.window_problems(df, late, 20).collect()} == {"no unseen rows"}
