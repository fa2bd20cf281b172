"""Fills of series that one task cannot hold: the same as whole ones."""

from datetime import datetime, timedelta

import numpy as np
import pytest

from tidemark.operators import imputation, matching

START = datetime(2024, 1, 1)


def panel(spark, **channels):
    rows = [("p", c, START + timedelta(hours=i), None if v is None or np.isnan(v) else float(v)) for c, values in channels.items() for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "panel_id string, channel string, ts timestamp, value double")


def filled(df):
    return {(r["channel"], r["ts"]): (r["value"], r["observed"]) for r in df.collect()}


def holes(rng, n, gaps):
    v = np.round(np.sin(np.arange(n) / 7) * 10 + rng.normal(size=n), 2)
    for at, length in gaps:
        v[at : at + length] = np.nan
    return v


def test_matching_in_buckets_equals_whole_series(spark):
    rng = np.random.default_rng(4)
    # many gaps of equal lengths, some in the context of others, at the ends and over bucket edges
    a = holes(rng, 420, [(0, 2), (40, 3), (46, 3), (59, 2), (99, 3), (103, 2), (150, 3), (155, 3), (161, 3), (200, 2), (203, 2), (206, 2), (250, 9), (310, 3), (380, 1), (418, 2)])
    b = np.tile([1.0, 2.0, 3.0, 4.0, 5.0], 30)  # ties everywhere
    b[[20, 21, 47, 48, 70, 71, 72, 120, 121]] = np.nan
    df = panel(spark, a=a, b=b, c=[1.0, np.nan, np.nan, 4.0], d=[np.nan] * 5, e=[1.0, 2.0, 3.0])
    whole = filled(imputation.impute(df, "psm"))
    for width in (60, 1000):
        assert filled(imputation.impute(df, "psm", in_task=0, width=width)) == whole


def test_bounds_spare_windows_and_lose_none():
    rng = np.random.default_rng(5)
    v = np.cumsum(rng.normal(size=20_000))
    every = np.lib.stride_tricks.sliding_window_view(v, 11)
    order = np.where(np.arange(len(every)) % 5 == 0, 700, -1)
    told = matching.Windows(every, np.arange(len(every)), order)
    seen = []
    told.windows = type("Counted", (), {"__getitem__": lambda self, at: (seen.append(at), every[at])[1]})()
    for limit in (700, 701):
        for k in rng.integers(0, len(every), 30):
            query = every[k] + rng.normal(size=11) * 0.1
            d = np.sqrt(((every - query) ** 2).sum(axis=1))
            d[order >= limit] = np.inf
            assert told.nearest(query, limit, (np.inf, -1)) == (pytest.approx(d.min(), abs=0), int(d.argmin()))
    assert len(seen) < 0.2 * 60 * len(told.edges)


@pytest.mark.parametrize("order", [3, 1])
def test_spline_in_buckets_equals_whole_series(spark, order):
    rng = np.random.default_rng(6)
    a = holes(rng, 300, [(0, 3), (20, 1), (38, 5), (60, 45), (120, 20), (150, 9), (161, 1), (163, 16), (200, 20), (296, 4)])
    sparse = np.full(300, np.nan)
    sparse[[3, 77, 150, 151, 290]] = [1.0, 5.0, -3.0, 2.0, 8.0]
    three = np.full(120, np.nan)
    three[[5, 70, 119]] = [1.0, 4.0, 2.0]
    df = panel(spark, a=a, sparse=sparse, three=three, none=[np.nan] * 45, one=[np.nan, 2.0] + [np.nan] * 60, full=[1.0, 2.0, 4.0])
    whole = filled(imputation.impute(df, "spline_interpolation", order=order))
    for width in (20, 70, 1000):
        got = filled(imputation.impute(df, "spline_interpolation", order=order, in_task=0, width=width))
        assert got.keys() == whole.keys()
        for k, (v, seen) in whole.items():
            assert got[k][1] == seen and (got[k][0] is None if v is None else got[k][0] == pytest.approx(v, abs=1e-9, rel=1e-9)), (width, k)
