"""Exact quantiles of many ranges of a series, without a copy of its rows for each.

The values of a key are cut into cells; counts of cells by bucket of places, summed up along the series, tell
for any range in which cell a wanted rank lies, and only that cell is cut again. A cell of few rows, or of one
value, is looked into. So a row is counted once a level, and a range costs two buckets a level and one
last cell, whatever its length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .panel import settled, small

#: Places of a bucket, cuts of a cell, rows of a cell that is looked into.
WIDTH, CUTS, FEW = 2048, 15, 1024


def counts_before(rows: DataFrame, ends: DataFrame, keys: list[str], width: int) -> DataFrame:
    """(keys, end, sub, n) of ``ends`` (keys, end, at): how many of ``rows`` (keys, pos, sub) lie before ``at``, for
    each sub of the key; subs without such rows may be absent. ``end`` names an end within its key."""
    place = lambda c: F.floor(F.col(c) / F.lit(width))
    rows, ends = rows.withColumn("bucket", place("pos")), ends.withColumn("bucket", place("at"))
    totals = rows.groupBy(*keys, "sub", "bucket").agg(F.count("*").alias("c"))
    asked = ends.join(small(totals.select(*keys, "sub").distinct()), keys).select(*keys, "sub", "bucket", "end")
    along = Window.partitionBy(*keys, "sub").orderBy("bucket").rangeBetween(Window.unboundedPreceding, -1)  # as many rows as buckets and ends
    none = F.lit(None).cast(ends.schema["end"].dataType)
    both = totals.withColumn("end", none).unionByName(asked.withColumn("c", F.lit(0).cast("long")))
    whole = both.withColumn("n", F.coalesce(F.sum("c").over(along), F.lit(0))).where("end is not null").select(*keys, "end", "sub", "n")
    part = rows.join(ends, [*keys, "bucket"]).where("pos < at").groupBy(*keys, "end", "sub").agg(F.count("*").alias("n"))
    return whole.unionByName(part).groupBy(*keys, "end", "sub").agg(F.sum("n").alias("n"))


def _within(rows: DataFrame, asks: DataFrame, keys: list[str], width: int) -> DataFrame:
    """(keys, ask, sub, n): how many rows of each sub lie in the range of each of ``asks`` (keys, ask, lo, hi)."""
    sides = F.explode(F.array(F.struct(F.lit(-1).alias("sign"), F.col("lo").alias("at")), F.struct(F.lit(1).alias("sign"), (F.col("hi") + 1).alias("at"))))
    ends = asks.select(*keys, "ask", sides.alias("e")).select(*keys, F.struct("ask", "e.sign").alias("end"), "e.at")
    told = counts_before(rows, ends, keys, width)
    return told.groupBy(*keys, F.col("end.ask").alias("ask"), "sub").agg(F.sum(F.col("n") * F.col("end.sign")).alias("n")).where("n > 0")


def range_quantiles(rows: DataFrame, asks: DataFrame, keys: list[str], q: dict[str, str], width: int = WIDTH, cuts: int = CUTS, few: int = FEW) -> DataFrame:
    """(keys, ask, names of ``q``): exact quantiles, linear between ranks, of the values of ``rows`` (keys, pos,
    value) whose pos lies in the closed range of each of ``asks`` (keys, ask, lo, hi, and the columns that ``q`` names).

    Missing values do not count; ranges without a value are absent. ``ask`` is unique within its key.
    """
    rows = settled(rows.select(*keys, "pos", F.col("value").cast("double").alias("value")).where("value is not null"), "values")
    asks = settled(asks.where("lo <= hi"), "asks")
    sizes = _within(rows.withColumn("sub", F.lit(0)), asks.select(*keys, "ask", "lo", "hi"), keys, width).drop("sub")
    sized = settled(asks.join(small(sizes), [*keys, "ask"]), "sized")
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(F.col(c) * (F.col("n") - 1)), F.ceil(F.col(c) * (F.col("n") - 1))) for c in q.values()])))
    cell = [*keys, "cell"]
    # one open question for each range and rank: the cell it lies in, and the rank within the range's rows of it
    open_ = settled(sized.select(*keys, F.lit("").alias("cell"), "ask", "lo", "hi", F.explode(ranks).alias("rank")).withColumn("k", F.col("rank")), "open")
    rows = rows.withColumn("cell", F.lit(""))
    found: DataFrame | None = None
    while True:
        wanted = open_.select(*cell).distinct()
        here = rows.join(small(wanted), cell, "left_semi")
        told = here.groupBy(*cell).agg(F.count("*").alias("rows"), F.min("value").alias("least"), F.max("value").alias("most"), F.percentile_approx("value", [i / (cuts + 1) for i in range(1, cuts + 1)], 1000).alias("cuts"))
        told = settled(told.withColumn("last", (F.col("rows") <= few) | (F.col("least") == F.col("most"))), "cells")
        ended = open_.join(small(told.where("last").select(*cell, "least", "most")), cell)
        same = ended.where("least = most").select(*keys, "ask", "rank", F.col("least").alias("v"))
        near = here.join(small(told.where("last and least <> most").select(*cell)), cell, "left_semi").select(*cell, "pos", "value")
        looked = ended.where("least <> most").join(near, cell).where("pos between lo and hi").groupBy(*keys, "ask", "rank", "k").agg(F.sort_array(F.collect_list("value")).alias("s"))
        part = settled(same.unionByName(looked.select(*keys, "ask", "rank", F.get("s", F.col("k").cast("int")).alias("v"))), "found")
        found = part if found is None else found.unionByName(part)
        more = open_.join(small(told.where("not last").select(*cell)), cell, "left_semi")
        if more.isEmpty():
            break
        # a value that is a cut has a cell of its own, so that equal values come to an end
        v = F.col("value")
        sub = 2 * F.size(F.filter("cuts", lambda c: c < v)) + F.array_contains("cuts", v).cast("int")
        split = settled(here.join(small(told.where("not last").select(*cell, F.array_distinct("cuts").alias("cuts"))), cell).select(*cell, "pos", "value", sub.alias("sub")), "split")
        more = settled(more, "more")
        by = _within(split, more.select(*cell, F.struct("ask", "rank").alias("ask"), "lo", "hi"), cell, width)
        upto = F.sum("n").over(Window.partitionBy(*cell, "ask").orderBy("sub"))  # a cell's cuts
        by = by.withColumn("upto", upto).select(*cell, "ask.ask", "ask.rank", "sub", "n", "upto")
        down = F.concat_ws(".", F.nullif(F.col("cell"), F.lit("")), F.col("sub").cast("string"))
        chosen = more.join(by, [*cell, "ask", "rank"]).where((F.col("k") < F.col("upto")) & (F.col("k") >= F.col("upto") - F.col("n")))
        open_ = settled(chosen.select(*keys, down.alias("cell"), "ask", "lo", "hi", "rank", (F.col("k") - (F.col("upto") - F.col("n"))).alias("k")), "open")
        rows = split.select(*keys, down.alias("cell"), "pos", "value")
    at = found.groupBy(*keys, "ask").agg(F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("at"))  # two ranks a quantile
    out = sized.join(small(at), [*keys, "ask"])

    def between(c: str):
        place = F.col(c) * (F.col("n") - 1)
        a, b = F.col("at")[F.floor(place)], F.col("at")[F.ceil(place)]
        return a + (b - a) * (place - F.floor(place))

    return out.select(*keys, "ask", *[between(c).alias(name) for name, c in q.items()])
