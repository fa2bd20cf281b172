"""Scores in parts, tables whose shuffle files go at once; after test_round3, which counts the session's shuffle files."""

import random
import time

import pytest
from pyspark.sql import functions as F

from tidemark.llm import bloom_lm, common


def test_batches_are_scored_in_parts(spark, monkeypatch):
    """So that the questions and answers of one part alone are on disk."""
    rng = random.Random(7)
    texts = [None, "", *[" ".join(f"w{rng.randrange(900)}" for _ in range(100)) for _ in range(150)]]
    table = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    monkeypatch.setattr(common, "SLICE_BYTES", 1500)
    model, parts, written = bloom_lm.train(table), [], common.written

    def noted(df, name, clean=False):
        out = written(df, name, clean)
        parts.extend([out.count()] * (name == "scores"))
        return out

    monkeypatch.setattr(common, "written", noted)
    scores = lambda: {r["doc_id"]: (r["n_tokens"], r["n_known"], r["score"]) for r in bloom_lm.score(table, model).collect()}
    got = scores()
    assert len(parts) == 3 and sum(parts) == len(texts) == len(got) and max(parts) < 0.6 * len(texts)
    monkeypatch.setattr(bloom_lm, "PARTS", 1)
    whole = scores()
    assert len(parts) == 3 and all(got[k][:2] == whole[k][:2] and got[k][2] == pytest.approx(whole[k][2]) for k in whole)


def test_a_clean_tables_shuffle_files_go_at_once(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled() -> set:
        names = files.getAllFiles()
        return {x for i in range(names.size()) if "shuffle_" in (x := names.apply(i).getName())}

    before = shuffled()
    rows = common.written(spark.range(20_000).groupBy((F.col("id") % 997).alias("k")).count(), "counts", clean=True)
    for _ in range(50):
        if not shuffled() - before:
            break
        time.sleep(0.2)
    assert not shuffled() - before and len(rows.collect()) == 997
    assert spark.conf.get(common.CLEANUP, "false") == "false"
