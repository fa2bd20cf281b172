"""Scalar expressions: each takes columns and gives a column, all inside code generation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS = 1_000_000


def bonferroni(q: float, n: int | Column) -> float | Column:
    """The quantile for one of ``n`` groups that keeps the whole at ``q``."""
    if isinstance(n, Column):
        return F.when(n > 1, 1 - (1 - F.lit(q)) / n).otherwise(F.lit(q))
    return q if n <= 1 else 1 - (1 - q) / n


def rescale(col: Column, lo: Column, hi: Column) -> Column:
    """``col`` on [0, 1] between ``lo`` and ``hi``; 0.5 where they coincide."""
    return F.when(hi > lo, F.least(F.greatest((col - lo) / F.nullif(hi - lo, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))).otherwise(F.when(hi.isNotNull() & lo.isNotNull(), F.lit(0.5)))


def lp_norm(cols: list[Column], p: float) -> Column:
    """The L^p norm over columns."""
    return F.pow(reduce(lambda a, b: a + b, [F.pow(F.abs(c), F.lit(p)) for c in cols]), F.lit(1 / p))


def zscore(col: Column, mean: Column, std: Column) -> Column:
    """Standardised; 0 where nothing varies."""
    return F.when(std == 0, F.lit(0.0)).otherwise((col - mean) / F.nullif(std, F.lit(0.0)))


def argmax_group(name: Column, score: Column) -> Column:
    """Aggregate: the name of the largest score; missing scores lose, the first name wins ties."""
    value = F.coalesce(F.nanvl(score, F.lit(float("-inf"))), F.lit(float("-inf")))
    return F.min_by(name, F.struct(-value, name))


def is_finite(col: Column) -> Column:
    """Neither missing, NaN nor infinite."""
    return F.coalesce(~F.isnan(col) & (F.abs(col) < F.lit(float("inf"))), F.lit(False))


def to_number(col: Column) -> Column:
    """A double, or null for what is none; NaN is missing."""
    return F.nanvl(col.try_cast("double"), F.lit(None).cast("double"))


def fmt_version(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd_HHmmss")


def iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")


def micros(ts: Column) -> Column:
    """Microseconds since the epoch."""
    return F.unix_micros(ts.cast("timestamp"))


def from_micros(us: Column) -> Column:
    return F.timestamp_micros(us)


def ceil_to(ts: Column, every: int) -> Column:
    """The end of the bin of ``every`` seconds that ``ts`` lies in, bins closed on the right and
    counted from midnight."""
    start = micros(F.date_trunc("day", ts.cast("timestamp")))
    return from_micros(start + F.ceil((micros(ts) - start) / F.lit(every * MICROS)) * F.lit(every * MICROS))


def guard_zero(col: Column, instead: float | None = None) -> Column:
    """Zero becomes ``instead`` (null by default)."""
    return F.when(col == 0, F.lit(instead).cast("double")).otherwise(col)


def mean_arrays(a: Column, b: Column) -> Column:
    """Element by element."""
    return F.zip_with(a, b, lambda x, y: (x + y) / 2)


def to_json_record(**cols: Column) -> Column:
    return F.to_json(F.struct(*[c.alias(k) for k, c in cols.items()]))


def sanitize(col: Column) -> Column:
    """A name with other characters than letters, digits and _ made to _, none at the ends."""
    return F.regexp_replace(F.regexp_replace(col, "[^A-Za-z0-9_]+", "_"), "^_+|_+$", "")
