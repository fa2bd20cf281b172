"""Partial subsequence matching on series of any length.

Gaps are filled by ascending length, those of equal length from left to right, and what is filled counts for later
gaps. All gaps of one length are searched side by side: a gap may use the fills of those left of it, so
the search is repeated with the fills found so far until they no longer change, which is then what filling them one
after the other gives. The series lies in buckets of rows, with copies of the neighbours that a window
reaches; every bucket tells each gap its nearest window, and an aggregate takes the least.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .panel import K, row_numbers, settled, small

#: Rows of a bucket.
ROWS = 1_000_000
#: Windows whose bounds are compared together, and the parts whose means bound them.
BLOCK, PARTS = 256, 4

PLACES = "panel_id string, channel string, a long, side int, distance double, start long, found array<double>"


class Windows:
    """Whole windows in the order of their starts, in blocks with the least and greatest mean of each part.

    The distance of two windows is at least that of their parts' means, each counted once for every value of it.
    """

    def __init__(self, windows: np.ndarray, starts: np.ndarray, order: np.ndarray):
        self.windows, self.starts, self.order = windows, starts, order
        n = windows.shape[1]
        self.cuts = np.unique(np.linspace(0, n, min(PARTS, n) + 1).astype(int))
        self.widths = np.diff(self.cuts)
        self.edges = np.arange(0, len(starts), BLOCK)
        means = self._means(windows)
        self.low, self.high = (f.reduceat(means, self.edges, axis=0) for f in (np.minimum, np.maximum))

    def _means(self, windows: np.ndarray) -> np.ndarray:
        return np.add.reduceat(windows, self.cuts[:-1], axis=-1) / self.widths

    def nearest(self, query: np.ndarray, limit: int, best: tuple[float, int]) -> tuple[float, int]:
        """(distance, start) of the nearest window whose order is below ``limit``, the first among equals, or ``best`` if it is less."""
        mean = self._means(query)
        off = np.maximum(self.low - mean, 0) + np.maximum(mean - self.high, 0)
        bound = np.sqrt((off * off * self.widths).sum(axis=1)) * (1 - 1e-9)
        for b in np.argsort(bound, kind="stable"):
            if bound[b] > best[0]:
                break
            at = slice(self.edges[b], self.edges[b] + BLOCK)
            distance = np.sqrt(((self.windows[at] - query) ** 2).sum(axis=1))
            distance[self.order[at] >= limit] = np.inf
            i = int(distance.argmin())
            if distance[i] < np.inf:
                best = min(best, (float(distance[i]), int(self.starts[at][i])))
        return best


def _search(key: tuple, rows: pd.DataFrame, asked: pd.DataFrame, n: int, width: int) -> pd.DataFrame:
    """The nearest window of each query among those that start in the bucket, with the values beside it."""
    columns = [c.split()[0] for c in PLACES.split(", ")]
    if asked.empty or rows.empty:
        return pd.DataFrame(columns=columns)
    size, low = int(asked["size"].iloc[0]), int(key[2]) * width - n
    v, g = np.full(width + 3 * n, np.nan), np.full(width + 3 * n, -1, dtype=np.int64)
    for fill in (0, 1):  # what was filled counts instead of what was missing
        part = rows[rows["fill"] == fill]
        at = part["at"].to_numpy() - low
        v[at], g[at] = part["value"].to_numpy(dtype=float), part["g"].to_numpy()
    every = np.lib.stride_tricks.sliding_window_view(v, n)
    whole = ~np.isnan(every).any(axis=1)
    order = np.lib.stride_tricks.sliding_window_view(g, 2 * n).max(axis=1)
    out = []
    for side, offset in ((0, n), (1, -n)):  # the values after a window, those before it
        mine = asked[asked["side"] == side]
        best = [(np.inf, -1)] * len(mine)
        queries = [np.array(q, dtype=float) for q in mine["query"]]
        first, last = max(low + n, 0, -offset), min(low + n + width, size - n + 1, size - n + 1 - offset)
        starts = np.arange(first, last)
        starts = starts[whole[starts - low] & whole[starts + offset - low]]
        for i in range(0, len(starts), step := max(BLOCK, (4 << 20) // n)):
            some = starts[i : i + step]
            told = Windows(every[some - low], some, order[np.minimum(some, some + offset) - low])
            best = [told.nearest(q, a, b) for q, a, b in zip(queries, mine["a"], best)]
        out += [(*key[:2], a, side, d, s, every[s + offset - low].tolist()) for a, (d, s) in zip(mine["a"], best) if s >= 0]
    return pd.DataFrame(out, columns=columns)


def _round(view: DataFrame, gaps: DataFrame, sizes: DataFrame, n: int, width: int) -> DataFrame:
    """(panel_id, channel, a, at, value): the fills of ``gaps`` (a) of length ``n``, as ``view`` (at, value, g, fill) lets them be.
    Values of a gap (g) are there for gaps after it alone."""
    sides = F.array(*[F.struct(F.lit(s).alias("side"), (F.col("a") + shift).alias("from")) for s, shift in ((0, -n), (1, n))])
    asked = gaps.select(*K, "a", F.explode(sides).alias("s")).select(*K, "a", "s.side", F.posexplode(F.sequence(F.col("s.from"), F.col("s.from") + n - 1)).alias("i", "at"))
    known = view.where("value is not null").select(*K, "at", "value", "g")
    queries = asked.join(known, [*K, "at"]).where("g < a").groupBy(*K, "a", "side").agg(F.sort_array(F.collect_list(F.struct("i", "value"))).alias("q"))
    queries = queries.where(F.size("q") == n).join(small(sizes), K).select(*K, "a", "side", "size", F.col("q.value").alias("query"))
    queries = queries.withColumn("bucket", F.explode(F.sequence(F.lit(0), F.floor((F.col("size") - 1) / width))))
    to = lambda c: F.floor(c / F.lit(width))
    dealt = view.withColumn("bucket", F.explode(F.sequence(to(F.col("at") - 2 * n + 1), to(F.col("at") + n))))
    found = dealt.groupBy(*K, "bucket").cogroup(queries.groupBy(*K, "bucket")).applyInPandas(lambda key, a, b: _search(key, a, b, n, width), PLACES)
    best = found.groupBy(*K, "a", "side").agg(F.min(F.struct("distance", "start", "found")).alias("b"))
    values = best.select(*K, "a", F.posexplode("b.found").alias("i", "value"))
    return values.groupBy(*K, "a", "i").agg((F.sum("value") / F.count("value")).alias("value")).select(*K, "a", (F.col("a") + F.col("i")).alias("at"), "value")


def match_rounds(df: DataFrame, width: int = ROWS) -> DataFrame:
    """``df`` (panel_id, channel, ts, value, ...) with the gaps filled that have a whole context and a whole window like it."""
    rows = settled(row_numbers(df, K).withColumn("at", F.col("rn") - 1).withColumnRenamed("n", "size").drop("rn"), "series")
    sizes = settled(rows.groupBy(*K).agg(F.max("size").alias("size")), "sizes")
    gone = row_numbers(rows.where("value is null").select(*K, "ts", "at"), K)
    gaps = settled(gone.groupBy(*K, (F.col("at") - F.col("rn")).alias("run")).agg(F.min("at").alias("a"), F.count("*").alias("length")).drop("run"), "gaps")
    plain = rows.select(*K, "at", "value", F.lit(-1).cast("long").alias("g"), F.lit(0).alias("fill"))
    filled = lambda df, g: df.select(*K, "at", "value", g.cast("long").alias("g"), F.lit(1).alias("fill"))
    done: DataFrame | None = None
    for (n,) in sorted(gaps.select("length").distinct().collect()):  # as many lengths as there are
        mine = settled(gaps.where(F.col("length") == n).select(*K, "a"), "round")
        # series without such a gap take no part
        base = plain if done is None else plain.unionByName(filled(done, F.lit(-1)))
        base = base.join(small(mine.select(*K).distinct()), K, "left_semi")
        now: DataFrame | None = None
        while True:
            view = base if now is None else base.unionByName(filled(now, F.col("a")))
            new = settled(_round(view, mine, sizes, n, width), "fills")
            if now is not None and new.exceptAll(now).isEmpty() and now.exceptAll(new).isEmpty():
                break
            if new.isEmpty():
                break
            now = new
        found = new.select(*K, "at", "value")
        done = found if done is None else settled(done.unionByName(found), "done")
    if done is None:
        return rows.drop("at", "size")
    return rows.join(done.withColumnRenamed("value", "__v"), [*K, "at"], "left").withColumn("value", F.coalesce("value", "__v")).drop("__v", "at", "size")
