"""The live table under crashes and other writers; scores of a stream with late rows."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import models, scoring
from tidemark.streaming import live, scores, store

START = datetime(2024, 1, 1)
LONG = "panel_id string, channel string, ts timestamp, value double"


def frame(spark, hours, value, panel="p"):
    return spark.createDataFrame([(panel, "a", START + timedelta(hours=h), value) for h in hours], LONG)


def rows(df):
    return sorted((r["panel_id"], r["channel"], str(r["ts"]), r["value"]) for r in df.collect())


class Killed(Exception):
    pass


STEPS = ["settled", "read", "written", "drafted", "committed", "forgotten", "vacuumed"]


@pytest.mark.parametrize("at", STEPS)
def test_a_killed_merge_leaves_the_old_table_or_the_new(spark, tmp_path, at):
    class Killer(store.LiveTable):
        def _step(self, name):
            if name == at:
                raise Killed(name)

    path = str(tmp_path / "t")
    table = store.LiveTable(spark, path)
    table.merge(frame(spark, range(0, 60), 1.0))
    table.merge(frame(spark, range(50, 70), 2.0))
    old = rows(table.read())
    batch = frame(spark, range(40, 100), 3.0)
    with pytest.raises(Killed):
        Killer(spark, path, keep=1).merge(batch)
    now = rows(table.read())
    new = sorted(old + [("p", "a", str(START + timedelta(hours=h)), 3.0) for h in range(70, 100)])
    assert now == (new if STEPS.index(at) >= STEPS.index("committed") else old)
    store.LiveTable(spark, path, keep=1).merge(batch)  # comes again
    assert rows(table.read()) == new
    files = store.Files(spark, path)
    assert {f"data/{n}" for n in files.names("data")} == set(table._manifest()["days"].values())


def test_only_touched_days_are_written(spark, tmp_path):
    table = store.LiveTable(spark, str(tmp_path / "t"))
    assert table.read() is None and table.merge(frame(spark, [], 1.0)) is None
    table.merge(frame(spark, range(0, 24 * 5), 1.0))
    before = table._manifest()["days"]
    table.merge(frame(spark, [30, 31], 9.0, "q").unionByName(spark.createDataFrame([("q", "a", None, 1.0)], LONG)))
    after = table._manifest()["days"]
    assert {d for d in after if after[d] != before.get(d)} == {"2024-01-02", store.NO_DAY}
    assert table.read().count() == 123 and table.read(version=0).count() == 120
    assert table.read(since="2024-01-02", until="2024-01-03").count() == 50
    with pytest.raises(ValueError):
        table.read(version=7)
    with pytest.raises(ValueError, match="did not read"):
        table.merge(frame(spark, [1], 1.0), lambda batch, live_: batch.withColumn("ts", F.lit(START + timedelta(days=3))))
    assert table.read().count() == 123


def test_two_writers_lose_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    other = store.LiveTable(spark, path)

    class Slow(store.LiveTable):
        done = False

        def _step(self, name):
            if name == "written" and not self.done:
                self.done = True
                other.merge(frame(spark, range(5, 10), 2.0))

    other.merge(frame(spark, range(0, 3), 1.0))
    assert Slow(spark, path).merge(frame(spark, range(3, 8), 3.0)) == 2
    got = {r["ts"].hour: r["value"] for r in other.read().collect()}
    assert got == {0: 1.0, 1: 1.0, 2: 1.0, 3: 3.0, 4: 3.0, 5: 2.0, 6: 2.0, 7: 2.0, 8: 2.0, 9: 2.0}


def test_old_versions_go(spark, tmp_path):
    table = store.LiveTable(spark, str(tmp_path / "t"), keep=2)
    for i in range(4):
        table.merge(frame(spark, [24 * i], float(i)))
    assert table.versions() == [2, 3] and table.read(version=2).count() == 3 and table.read().count() == 4


def test_bootstrap_takes_the_baseline_once(spark, tmp_path):
    table, base = store.LiveTable(spark, str(tmp_path / "t")), frame(spark, range(50), 1.0)
    with pytest.raises(ValueError):
        table.bootstrap(None)
    assert table.bootstrap(base) and rows(table.read()) == rows(base)
    assert not table.bootstrap(base) and not table.bootstrap(None)
    longer = frame(spark, range(60), 5.0)
    assert table.bootstrap(longer) and rows(table.read()) == rows(longer)


def test_new_columns_join_the_table(spark, tmp_path):
    table = store.LiveTable(spark, str(tmp_path / "t"))
    table.merge(frame(spark, [1], 1.0))
    table.merge(frame(spark, [30], 2.0).withColumn("observed", F.lit(1)))
    assert {(r["value"], r["observed"]) for r in table.read().collect()} == {(1.0, None), (2.0, 1)}


def test_late_rows_are_scored_as_the_batch_scores_them(spark, tmp_path):
    rng = random.Random(1)
    every = [("p", c, START + timedelta(hours=h), None if rng.random() < 0.03 else rng.gauss(10, 3)) for h in range(200) for c in ("a", "b")]
    every += [("q", "a", START + timedelta(hours=h), rng.gauss(0, 1)) for h in range(0, 200, 2)]
    fixed = spark.createDataFrame([("p", "a", [1, 2], [0.5, 0.2], 3.0), ("p", "b", [3], [0.9], 1.0), ("q", "a", [1], [0.5], 0.0)], "panel_id string, channel string, lags array<int>, coef array<double>, intercept double")
    limits = spark.createDataFrame([("p", "system", 4.0, 1.0), ("q", "system", 1.0, 0.1)], "panel_id string, group string, threshold double, q_low double")
    # each row comes up to five hours late, over twelve batches
    arriving = sorted(every, key=lambda r: r[2] + timedelta(hours=rng.uniform(0, 5)))
    for i in range(12):
        part = arriving[i * len(arriving) // 12 : (i + 1) * len(arriving) // 12]
        spark.createDataFrame(part, LONG).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    scores.state_in_rocksdb(spark)
    try:
        stream = spark.readStream.schema(LONG).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        out = scores.stream_flags(stream, fixed, limits, 3, delay="6 hours")
        out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = spark.read.schema(out.schema).parquet(str(tmp_path / "out"))
    told = models.predict(spark.createDataFrame(every, LONG), fixed, reach=3).withColumn("group", F.lit("system"))
    want = scoring.flag(scoring.score_norm(told), limits).where(F.col("ts") <= START + timedelta(hours=193))
    cell = lambda r: (r["panel_id"], r["ts"], None if r["score"] is None else round(r["score"], 9), r["flag"], None if r["normalized"] is None else round(r["normalized"], 9))
    a, b = (sorted(map(cell, df.collect()), key=str) for df in (got, want))
    assert a == b and sum(r[3] for r in a) > 10
