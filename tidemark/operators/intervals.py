"""An index of closed time intervals: disjoint ones by time bucket, found by bucket and binary search.

Overlapping intervals are merged. An interval longer than a bucket gives its first and last piece and covers the
buckets between, which a running sum over the buckets tells, so that no interval is written once a
bucket. A row meets only the pieces of its own bucket, whatever the length of the list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from .panel import settled, small

#: Intervals for which a bucket is made, and the most buckets.
EACH, MOST = 64, 1 << 16
#: Buckets whose running sums one task adds.
GROUP = 256


def widened(intervals: DataFrame, buffer: int, *more: str) -> DataFrame:
    """(__a, __b, more) in microseconds, ``buffer`` seconds longer on both sides; malformed intervals are skipped."""
    good = intervals.where("start_ts is not null and end_ts is not null and start_ts <= end_ts")
    side = lambda c, by: (S.micros(F.col(c)) + F.lit(by * S.MICROS))
    return good.select(side("start_ts", -buffer).alias("__a"), side("end_ts", buffer).alias("__b"), *more)


class Buckets:
    """Equal time buckets over the whole list; ``count`` is 0 for an empty one."""

    def __init__(self, wide: DataFrame, each: int = EACH):
        low, high, n = wide.agg(F.min("__a"), F.max("__b"), F.count("*")).first()
        self.low, self.count = low or 0, 0
        self.width = 1
        if n:
            self.width = max(-(-(high - low + 1) // min(MOST, -(-n // each))), 1)
            self.count = (high - low) // self.width + 1

    def of(self, t: Column) -> Column:
        return F.floor((t - F.lit(self.low)) / F.lit(self.width)).cast("long")

    def start(self, bucket: Column) -> Column:
        return F.lit(self.low) + bucket * F.lit(self.width)


def covered(wide: DataFrame, buckets: Buckets) -> DataFrame:
    """(bucket) of the buckets that lie whole within an interval, neither its first nor its last."""
    ends = wide.select(buckets.of(F.col("__a")).alias("p"), buckets.of(F.col("__b")).alias("q")).where("q - p > 1")
    change = ends.select(F.explode(F.array(F.struct((F.col("p") + 1).alias("bucket"), F.lit(1).alias("by")), F.struct(F.col("q").alias("bucket"), F.lit(-1).alias("by")))).alias("e")).groupBy("e.bucket").agg(F.sum("e.by").alias("by"))
    every = wide.sparkSession.range(buckets.count).withColumnRenamed("id", "bucket").join(change, "bucket", "left").withColumn("part", F.floor(F.col("bucket") / GROUP))
    inside = F.sum(F.coalesce("by", F.lit(0))).over(Window.partitionBy("part").orderBy("bucket"))
    every = settled(every.select("bucket", "part", F.coalesce("by", F.lit(0)).alias("by"), inside.alias("inside")), "cover")
    totals = every.groupBy("part").agg(F.sum("by").alias("total"))
    before = totals.alias("a").join(totals.select(F.col("part").alias("earlier"), F.col("total").alias("t")), F.col("earlier") < F.col("part"), "left").groupBy("part").agg(F.coalesce(F.sum("t"), F.lit(0)).alias("before"))
    return every.join(small(before), "part").where("inside + before > 0").select("bucket")


def pieces(wide: DataFrame, buckets: Buckets) -> DataFrame:
    """(bucket, pieces): disjoint pieces (a, b) of the intervals in the bucket, in order."""
    p, q = buckets.of(F.col("__a")), buckets.of(F.col("__b"))
    piece = lambda bucket: F.struct(bucket.alias("bucket"), F.greatest(F.col("__a"), buckets.start(bucket)).alias("a"), F.least(F.col("__b"), buckets.start(bucket + 1) - 1).alias("b"))
    edges = wide.select(F.explode(F.array_distinct(F.array(piece(p), piece(q)))).alias("e")).select("e.*")
    whole = covered(wide, buckets).select("bucket", buckets.start(F.col("bucket")).alias("a"), (buckets.start(F.col("bucket") + 1) - 1).alias("b"))
    order = Window.partitionBy("bucket").orderBy("a", "b")
    reach = F.max("b").over(order.rowsBetween(Window.unboundedPreceding, -1))
    runs = edges.unionByName(whole).withColumn("new", (F.col("a") > F.coalesce(reach, F.col("a") - 1)).cast("int")).withColumn("run", F.sum("new").over(order))
    merged = runs.groupBy("bucket", "run").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    return merged.groupBy("bucket").agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("pieces"))


def among(pieces_: Column, t: Column) -> Column:
    """Whether ``t`` lies in one of the disjoint ordered ``pieces_``, by binary search for the last that starts at or before it."""
    steps = F.sequence(F.lit(1), F.ceil(F.log2(F.size(pieces_) + 1)).cast("int"))
    middle = lambda s: F.floor((s["lo"] + s["hi"]) / 2).cast("int")
    ahead = lambda s: F.get(pieces_, middle(s))["a"] <= t
    halved = lambda s: F.when(s["lo"] >= s["hi"], s).otherwise(F.struct(F.when(ahead(s), middle(s) + 1).otherwise(s["lo"]).alias("lo"), F.when(ahead(s), s["hi"]).otherwise(middle(s)).alias("hi")))
    upto = F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.size(pieces_).alias("hi")), lambda s, _: halved(s), lambda s: s["lo"])
    return (upto > 0) & (F.get(pieces_, upto - 1)["b"] >= t)


def within(df: DataFrame, intervals: DataFrame, buffer: int = 0, each: int = EACH) -> DataFrame:
    """``df`` with known: whether ts lies in an interval (start_ts, end_ts) widened by ``buffer`` seconds; false for a missing ts."""
    wide = settled(widened(intervals, buffer), "intervals")
    buckets = Buckets(wide, each)
    if not buckets.count:
        return df.withColumn("known", F.lit(False))
    t = S.micros(F.col("ts"))
    index = pieces(wide, buckets).withColumnRenamed("bucket", "__bucket")
    out = df.withColumn("__bucket", buckets.of(t)).join(small(index), "__bucket", "left")
    known = F.col("pieces").isNotNull() & among(F.col("pieces"), t)
    return out.select(*[F.col(f"`{c}`") for c in df.columns], F.coalesce(known, F.lit(False)).alias("known"))


def each_within(df: DataFrame, intervals: DataFrame, buffer: int = 0, each: int = EACH) -> DataFrame:
    """A copy of each row for each interval that holds it, with start_ts and end_ts."""
    wide = settled(widened(intervals, buffer, "start_ts", "end_ts"), "intervals")
    buckets, t = Buckets(wide, each), S.micros(F.col("ts"))
    listed = wide.withColumn("__bucket", F.explode(F.sequence(buckets.of(F.col("__a")), buckets.of(F.col("__b")))))
    met = df.withColumn("__bucket", buckets.of(t)).join(small(listed), "__bucket").where((t >= F.col("__a")) & (t <= F.col("__b")))
    return met.select(*[F.col(f"`{c}`") for c in df.columns], "start_ts", "end_ts")
