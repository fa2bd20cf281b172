"""The long panel and the three ways in which operators look along a series.

* ``series``: a window over a whole series; for many series.
* ``with_halo``: series cut into time buckets, each with copies of the neighbours within reach;
  for bounded reach on long series. Own rows are kept after the window.
* ``carried``: for unbounded reach (fills): each bucket's last and first observation, carried over
  the few buckets of a series, then joined back; no task holds a whole series.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalar as S

K = ["panel_id", "channel"]
#: Seconds of a bucket in which a long series is cut.
BUCKET = 30 * 86_400


def series(keys: list[str] = K) -> Window:
    return Window.partitionBy(*keys).orderBy("ts")


def clean(df: DataFrame) -> DataFrame:
    """NaN is missing: null."""
    return df.withColumn("value", F.nanvl(F.col("value").cast("double"), F.lit(None).cast("double")))


def with_halo(df: DataFrame, before: int, after: int, bucket: int = BUCKET) -> DataFrame:
    """``df`` with bucket and own; rows also stand in the buckets that reach them: those starting
    within ``before`` seconds after the row or ending within ``after`` seconds before it."""
    t, width = S.micros(F.col("ts")), F.lit(bucket * S.MICROS)
    first, last = F.floor((t - F.lit(after * S.MICROS)) / width), F.floor((t + F.lit(before * S.MICROS)) / width)
    return df.withColumn("bucket", F.explode(F.sequence(first, last))).withColumn("own", F.col("bucket") == F.floor(t / width))


def own_rows(df: DataFrame) -> DataFrame:
    return df.where("own").drop("bucket", "own")


def bucketed(keys: list[str] = K) -> Window:
    return Window.partitionBy(*keys, "bucket").orderBy("ts")


def bounded(df: DataFrame, columns: dict[str, object], before: int, after: int, bucket: int | None = BUCKET) -> DataFrame:
    """Adds ``columns`` (name -> function of a window) that reach ``before`` and ``after`` seconds.

    ``bucket`` None: one window over the whole series."""
    if bucket is None:
        w = series()
        return df.withColumns({name: f(w) for name, f in columns.items()})
    w = bucketed()
    return own_rows(with_halo(df, before, after, bucket).withColumns({name: f(w) for name, f in columns.items()}))


def carried(df: DataFrame, bucket: int = BUCKET, keys: list[str] = K, value: str = "value") -> DataFrame:
    """``df`` with prev_ts, prev_value, next_ts, next_value: the last observation at or before each
    row and the first at or after it."""
    df = df.withColumn("bucket", F.floor(S.micros(F.col("ts")) / F.lit(bucket * S.MICROS)))
    seen = F.when(F.col(value).isNotNull(), F.struct(F.col("ts").alias("t"), F.col(value).alias("v")))
    ends = df.groupBy(*keys, "bucket").agg(F.max(seen).alias("last"), F.min(seen).alias("first"))
    w = Window.partitionBy(*keys).orderBy("bucket")
    ends = ends.select(*keys, "bucket", F.last("last", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("before"), F.first("first", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)).alias("after"))
    b = Window.partitionBy(*keys, "bucket").orderBy("ts")
    out = df.join(ends, [*keys, "bucket"]).withColumn("__p", F.coalesce(F.last(seen, ignorenulls=True).over(b), F.col("before")))
    out = out.withColumn("__n", F.coalesce(F.first(seen, ignorenulls=True).over(b.rowsBetween(0, Window.unboundedFollowing)), F.col("after")))
    return out.select(*[c for c in df.columns if c != "bucket"], F.col("__p.t").alias("prev_ts"), F.col("__p.v").alias("prev_value"), F.col("__n.t").alias("next_ts"), F.col("__n.v").alias("next_value"))


def row_numbers(df: DataFrame, keys: list[str], bucket: int = BUCKET) -> DataFrame:
    """``df`` with rn (from 1 by ts) and n of each group of ``keys``, counted over buckets."""
    df = df.withColumn("bucket", F.floor(S.micros(F.col("ts")) / F.lit(bucket * S.MICROS)))
    sizes = df.groupBy(*keys, "bucket").agg(F.count("*").alias("__c"))
    w = Window.partitionBy(*keys).orderBy("bucket")
    sizes = sizes.select(*keys, "bucket", F.coalesce(F.sum("__c").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"), F.sum("__c").over(Window.partitionBy(*keys)).alias("n"))
    out = df.join(sizes, [*keys, "bucket"])
    return out.withColumn("rn", F.col("__before") + F.row_number().over(Window.partitionBy(*keys, "bucket").orderBy("ts"))).drop("bucket", "__before")


def wide(df: DataFrame, channels: list[str] | None = None, value: str = "value") -> DataFrame:
    """One row a timestamp, one column a channel."""
    return df.groupBy("panel_id", "ts").pivot("channel", channels).agg(F.first(value, ignorenulls=True))


def long(df: DataFrame, channels: list[str]) -> DataFrame:
    """The long form of a wide frame."""
    return df.unpivot(["panel_id", "ts"], channels, "channel", "value").select("panel_id", "channel", "ts", "value")


def small(df: DataFrame) -> DataFrame:
    """A parameter table (bounds, thresholds, models), to be joined without a hint.

    Adaptive execution sees its true size when its stage has run and broadcasts it if it is under
    ``spark.sql.autoBroadcastJoinThreshold``; a larger one is joined by shuffle. Counting it first
    would run the plan below it twice.
    """
    return df


# --------------------------------------------------------------- tables between steps
def shared_folder(spark: SparkSession) -> str:
    """The folder of tables between steps: ``spark.checkpoint.dir`` of the session.

    Where it is unset, a local session gets a temporary folder, removed at exit; a cluster, whose
    machines would not see it, gets an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        own = tempfile.mkdtemp(prefix="tidemark-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(f"file://{own}")
        root = spark.sparkContext.getCheckpointDir()
    return root.rstrip("/")


def settled(df: DataFrame, name: str = "step") -> DataFrame:
    """``df`` written to the shared folder and read again: what is used several times is computed
    once, plans stay short, and lost executors do not lose it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tidemark-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


# --------------------------------------------------------------- quantiles
#: Values of a key up to which its quantiles are read off one sorted array (8 bytes each).
SORTED_VALUES = 100_000


def exact_quantiles(df: DataFrame, keys: list[str], value: str, q: dict[str, float | str], per: DataFrame | None = None, cells: int = 32, most_sorted: int = SORTED_VALUES) -> DataFrame:
    """(keys, names of ``q``): exact quantiles of ``value`` with linear interpolation; keys without a value are absent.

    ``q``: a quantile for each name, or the column of ``per`` (keys, columns) that holds a key's own.
    Where each key has few values they are sorted in one array; the results are the same beyond
    that: a mergeable sketch cuts each key's values into ``cells``, counts of the cells tell in which the
    wanted ranks lie, and only these are ordered, equal values counted together, so that no task holds
    a key's values. ``df`` is read two to four times: settle it first if it is a long plan.
    """
    rows = df.select(*keys, F.col(value).cast("double").alias("__v")).where("__v is not null")
    last = F.col("__n") - 1
    places = [(name, (F.col(x) if isinstance(x, str) else F.lit(float(x))) * last) for name, x in q.items()]

    def out(found: DataFrame, at: Callable[[Column], Column]) -> DataFrame:
        told = [(name, at(F.floor(p)), at(F.ceil(p)), p - F.floor(p)) for name, p in places]
        return found.select(*keys, *[(a + (b - a) * part).alias(name) for name, a, b, part in told])

    with_own = lambda told: told if per is None else told.join(small(per), keys)
    if (rows.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0) <= most_sorted:
        arrays = rows.groupBy(*keys).agg(F.sort_array(F.collect_list("__v")).alias("__s")).withColumn("__n", F.size("__s"))
        return out(with_own(arrays), lambda i: F.get("__s", i.cast("int")))
    ends = rows.groupBy(*keys).agg(F.count("*").alias("__n"), F.percentile_approx("__v", [i / cells for i in range(1, cells)], 1000).alias("__cuts"))
    ends = settled(with_own(ends).withColumn("__places", F.array(*[p for _, p in places])), "ends")
    placed = rows.join(small(ends.select(*keys, "__cuts")), keys).select(*keys, "__v", F.size(F.filter("__cuts", lambda c: c < F.col("__v"))).alias("__cell"))
    counts = placed.groupBy(*keys, "__cell").agg(F.count("*").alias("__c"))
    before = F.sum("__c").over(Window.partitionBy(*keys).orderBy("__cell")) - F.col("__c")  # as many rows as cells
    wanted = counts.withColumn("__before", before).join(small(ends.select(*keys, "__places")), keys)
    ranks = F.array_distinct(F.flatten(F.transform("__places", lambda p: F.array(F.floor(p), F.ceil(p)))))
    wanted = wanted.withColumn("__ranks", F.filter(ranks, lambda r: (r >= F.col("__before")) & (r < F.col("__before") + F.col("__c")))).where(F.size("__ranks") > 0)
    wanted = settled(wanted.select(*keys, "__cell", "__before", "__ranks"), "cells")
    near = placed.join(small(wanted), [*keys, "__cell"]).groupBy(*keys, "__cell", "__before", "__ranks", "__v").agg(F.count("*").alias("__c"))
    upto = F.col("__before") + F.sum("__c").over(Window.partitionBy(*keys, "__cell").orderBy("__v"))
    hits = near.withColumn("__upto", upto).withColumn("__rank", F.explode(F.filter("__ranks", lambda r: (r < F.col("__upto")) & (r >= F.col("__upto") - F.col("__c")))))
    found = hits.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("__rank", "__v"))).alias("__at"))  # two ranks a name
    return out(found.join(small(ends.drop("__cuts", "__places")), keys), lambda i: F.col("__at")[i])
