"""Rows within intervals against plain comparison."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import filters, intervals

START = datetime(2024, 1, 1)
SCHEMA = "start_ts timestamp, end_ts timestamp"


def panel(spark, stamps):
    return spark.createDataFrame([("p", "a", t, 1.0) for t in stamps], "panel_id string, channel string, ts timestamp, value double")


@pytest.mark.parametrize("each", [1, 5, 64, 10_000])
def test_any_list_of_intervals(spark, each):
    rng = random.Random(each)
    at = lambda s: START + timedelta(seconds=s)
    many = [(a, a + rng.choice([0, 1, 30, 500, 40_000])) for a in (rng.randrange(900_000) for _ in range(150))]
    many += [(1000, 1000), (1000, 2000), (2001, 3000), (500_000, 700_000)]
    listed = spark.createDataFrame([(at(a), at(b)) for a, b in many] + [(at(5), at(4)), (None, at(5)), (at(5), None)], SCHEMA)
    stamps = [rng.randrange(-1000, 960_000) for _ in range(1500)] + [x + d for x in (1000, 2000, 2001, 3000) for d in (-1, 0, 1)]
    got = {(r["ts"] - START).total_seconds(): r["known"] for r in intervals.within(panel(spark, [at(s) for s in stamps]), listed, 7, each).collect()}
    assert got == {float(s): any(a - 7 <= s <= b + 7 for a, b in many) for s in stamps}
    copies = intervals.each_within(panel(spark, [at(s) for s in set(stamps)]), listed, 7, each)
    assert sorted(((r["ts"] - START).total_seconds(), (r["start_ts"] - START).total_seconds(), (r["end_ts"] - START).total_seconds()) for r in copies.collect()) == sorted((float(s), float(a), float(b)) for s in set(stamps) for a, b in many if a - 7 <= s <= b + 7)


def test_no_intervals_and_no_rows(spark):
    none, rows = spark.createDataFrame([], SCHEMA), panel(spark, [START, None])
    assert [r["known"] for r in intervals.within(rows, none).collect()] == [False, False]
    assert intervals.each_within(rows, none).count() == 0
    one = spark.createDataFrame([(START, START)], SCHEMA)
    assert {r["ts"]: r["in_known"] for r in filters.in_interval(rows, one).collect()} == {START: True, None: False}
    assert intervals.within(rows.limit(0), one).count() == 0


def test_a_million_intervals(spark):
    listed = spark.range(1_000_000).select(F.timestamp_seconds(F.col("id") * 60).alias("start_ts"), F.timestamp_seconds(F.col("id") * 60 + F.col("id") % 50).alias("end_ts"))
    rows = spark.range(200_000).select(F.lit("p").alias("panel_id"), F.timestamp_seconds(F.col("id") * 301 + 7).alias("ts"))
    got = intervals.within(rows, listed).agg(F.count("*"), F.count_if("known")).first()
    at = [i * 301 + 7 for i in range(200_000)]
    assert tuple(got) == (200_000, sum(t % 60 <= (t // 60) % 50 and t // 60 < 1_000_000 for t in at))
