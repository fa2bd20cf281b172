"""A natural cubic spline through a series of any length, by a partitioned solve.

The second derivatives at the observations solve one tridiagonal system. Each bucket of rows eliminates those
between its first and last observation, which leaves two unknowns a bucket; these form a tridiagonal
system of their own, solved a series over its buckets; then every bucket puts them back and fills its gaps.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .panel import K, row_numbers, settled

#: Rows of a bucket.
ROWS = 200_000


def tridiagonal(below: np.ndarray, main: np.ndarray, above: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The solution of each column of ``right``; ``below`` and ``above`` are one shorter than ``main``."""
    n = len(main)
    if not n:
        return right.copy()
    c, d = [0.0] * n, np.array(right, dtype=float)
    beta = float(main[0])
    d[0] /= beta
    for i in range(1, n):
        c[i - 1] = above[i - 1] / beta
        beta = float(main[i] - below[i - 1] * c[i - 1])
        d[i] = (d[i] - below[i - 1] * d[i - 1]) / beta
    for i in range(n - 2, -1, -1):
        d[i] -= c[i] * d[i + 1]
    return d


def eliminated(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """(observations, 3): each second derivative as constant + share of the first one + share of the last one."""
    out = np.zeros((len(x), 3))
    out[0, 1] = 1
    out[-1, 1:] = (0, 1) if len(x) > 1 else (1, 0)
    if len(x) > 2:
        h = np.diff(x).astype(float)
        right = np.zeros((len(x) - 2, 3))
        right[:, 0] = 6 * np.diff(np.diff(y) / h)
        right[0, 1], right[-1, 2] = -h[0], right[-1, 2] - h[-1]
        out[1:-1] = tridiagonal(h[1:-1], 2 * (h[:-1] + h[1:]), h[1:-1], right)
    return out


#: Of a bucket: how many observations, the first two and last two of them, what the second and the last but one are made of.
ENDS = "panel_id string, channel string, bucket long, n long, x array<long>, y array<double>, second array<double>, penult array<double>"
#: Of a bucket: its first and last derivative, and the observation (place, value, derivative) before and after it.
SOLVED = "panel_id string, channel string, bucket long, first double, last double, before array<double>, after array<double>"


def _ends(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows[rows["value"].notna()].sort_values("at")
    x, y = rows["at"].to_numpy(), rows["value"].to_numpy(dtype=float)
    columns = [c.split()[0] for c in ENDS.split(", ")]
    if not len(x):
        return pd.DataFrame([(*key, 0, [], [], [], [])], columns=columns)
    made, some = eliminated(x, y), [0, min(1, len(x) - 1), max(len(x) - 2, 0), len(x) - 1]
    return pd.DataFrame([(*key, len(x), x[some].tolist(), y[some].tolist(), made[some[1]].tolist(), made[some[2]].tolist())], columns=columns)


def _interfaces(key: tuple, buckets: pd.DataFrame, order: int) -> pd.DataFrame:
    """Solves a series' two unknowns a bucket; one, where a bucket has a single observation."""
    buckets = buckets.sort_values("bucket")
    full = [r for r in buckets.itertuples(index=False) if r.n]
    place, size = {}, 0
    for r in full:
        place[r.bucket] = (size, size + (r.n > 1))
        size += 1 + (r.n > 1)
    m = np.zeros(size)
    if sum(r.n for r in full) >= 4 and order >= 2:
        below, main, above, right = np.zeros(size), np.ones(size), np.zeros(size), np.zeros(size)
        for i, r in enumerate(full):
            first, last = place[r.bucket]
            prior, after = full[i - 1] if i else None, full[i + 1] if i + 1 < len(full) else None
            for at, is_first in {first: True, last: False}.items() if r.n > 1 else {first: None}.items():
                # neighbours of this observation on both sides: (place, value), None beyond the series
                left = (prior.x[3], prior.y[3]) if prior else None
                next_ = (after.x[0], after.y[0]) if after else None
                if is_first is True:
                    next_ = (r.x[1], r.y[1])
                elif is_first is False:
                    left = (r.x[2], r.y[2])
                x, y = (r.x[3], r.y[3]) if is_first is False else (r.x[0], r.y[0])
                if left is None or next_ is None:
                    continue  # the series' own end: 0
                hl, hr = float(x - left[0]), float(next_[0] - x)
                main[at] = 2 * (hl + hr)
                right[at] = 6 * ((next_[1] - y) / hr - (y - left[1]) / hl)
                if is_first is not False:
                    below[at] = hl
                else:
                    constant, own, other = r.penult[0], r.penult[2], r.penult[1]
                    right[at] -= hl * constant
                    main[at] += hl * own
                    below[at] = hl * other
                if is_first is not True:
                    above[at] = hr
                else:
                    constant, own, other = r.second[0], r.second[1], r.second[2]
                    right[at] -= hr * constant
                    main[at] += hr * own
                    above[at] = hr * other
        m = tridiagonal(below[1:], main, above[:-1], right[:, None])[:, 0]
    before, sides = [], {}
    for r in buckets.itertuples(index=False):
        sides[r.bucket] = [before, []]
        if r.n:
            before = [float(r.x[3]), r.y[3], m[place[r.bucket][1]]]
    after: list[float] = []
    for r in reversed(list(buckets.itertuples(index=False))):
        sides[r.bucket][1] = after
        if r.n:
            after = [float(r.x[0]), r.y[0], m[place[r.bucket][0]]]
    out = [(*key, b, *((m[place[b][0]], m[place[b][1]]) if b in place else (0.0, 0.0)), *sides[b]) for b in buckets["bucket"]]
    return pd.DataFrame(out, columns=[c.split()[0] for c in SOLVED.split(", ")])


def curve(x: np.ndarray, y: np.ndarray, m: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The spline of observations (x, y) with second derivatives m at the places ``at``; constant outside."""
    if len(x) == 1:
        return np.full(len(at), y[0])
    h = np.diff(x).astype(float)
    k = np.clip(np.searchsorted(x, at) - 1, 0, len(h) - 1)
    a, b = x[k + 1] - at, at - x[k]
    inside = (m[k] * a**3 + m[k + 1] * b**3) / (6 * h[k]) + (y[k] / h[k] - m[k] * h[k] / 6) * a + (y[k + 1] / h[k] - m[k + 1] * h[k] / 6) * b
    return np.where(at < x[0], y[0], np.where(at > x[-1], y[-1], inside))


def _filled(key: tuple, rows: pd.DataFrame, solved: pd.DataFrame, order: int) -> pd.DataFrame:
    t = solved.iloc[0]
    rows = rows.sort_values("at")
    at, v = rows["at"].to_numpy(), rows["value"].to_numpy(dtype=float)
    seen = ~np.isnan(v)
    x, y = at[seen].astype(float), v[seen]
    m = np.zeros(len(x))
    if len(x) and order >= 2:
        m = eliminated(x, y) @ np.array([1.0, t["first"], t["last"] if len(x) > 1 else 0.0])
    if len(x) and t["linear"]:
        m[:] = 0
    ends = [np.array([list(s)]).reshape(-1, 3) for s in (t["before"], t["after"])]
    x, y, m = (np.concatenate([ends[0][:, i], own, ends[1][:, i]]) for i, own in enumerate((x, y, m)))
    if len(x):
        v = np.where(seen, v, curve(x, y, m, at.astype(float)))
    return rows.assign(value=v)[[*K, "ts", "value", "observed"]]


def spline(df: DataFrame, order: int = 3, width: int = ROWS) -> DataFrame:
    """``df`` (panel_id, channel, ts, value, observed) with the gaps filled; see ``imputation.spline_interpolation``."""
    rows = row_numbers(df, K).select(*K, "ts", "value", "observed", (F.col("rn") - 1).alias("at"))
    rows = settled(rows.withColumn("bucket", F.floor(F.col("at") / F.lit(width))), "series")
    ends = rows.select(*K, "bucket", "at", "value").groupBy(*K, "bucket").applyInPandas(_ends, ENDS)
    ends = settled(ends, "ends")
    few = ends.groupBy(*K).agg((F.sum("n") < 4).alias("linear")).select(*[F.col(c).alias(c) for c in K], "linear")
    solved = ends.groupBy(*K).applyInPandas(lambda key, b: _interfaces(key, b, order), SOLVED)
    solved = settled(solved.join(few, K), "solved")
    filled = rows.groupBy(*K, "bucket").cogroup(solved.groupBy(*K, "bucket")).applyInPandas(lambda key, a, b: _filled(key, a, b, order), "panel_id string, channel string, ts timestamp, value double, observed int")
    return filled.withColumn("value", F.nanvl("value", F.lit(None).cast("double")))
