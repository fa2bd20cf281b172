"""What a task of the language model holds while it scores a batch."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa

from tidemark.llm import bloom_lm


def test_a_batch_is_scored_a_slice_at_a_time(spark, monkeypatch):
    """Few arrays hold a whole batch's tokens, a word of them 8 bytes: two tasks and a full heap share an executor."""
    rng = random.Random(3)
    words = [f"w{rng.randrange(10**6)}" for _ in range(20_000)]
    texts = [None, "", *[" ".join(rng.choices(words, k=900)) for _ in range(1500)]]
    n_words = 900 * 1500
    model = bloom_lm.train(spark.createDataFrame([(" ".join(words),), ("a b",)], "text string"))
    kind, found = type(spark.range(1).groupBy("id").cogroup(spark.range(1).groupBy("id"))), []
    plain = kind.applyInArrow

    def noted(self, func, schema):
        found.extend([func] * ("base_score" in schema))
        return plain(self, func, schema)

    monkeypatch.setattr(kind, "applyInArrow", noted)
    bloom_lm.score(spark.createDataFrame([(0, "a b")], "doc_id long, text string"), model)
    rows = pa.table({"doc_id": pa.array(range(len(texts))), "text": pa.array(texts, type=pa.string()), "batch": pa.array([0] * len(texts))})
    none = pa.table({"batch": pa.array([], type=pa.int64()), "kind": pa.array([], type=pa.int32()), "shard": pa.array([], type=pa.int32()), "c": pa.array([], type=pa.binary()), "t": pa.array([], type=pa.binary())})
    tracemalloc.start()
    try:
        out = found[0](rows, none)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert out.column("n_tokens").to_pylist() == [1, 1, *[901] * 1500] and np.isfinite(out.column("score").to_numpy()).all()
    assert peak < 6 * 8 * n_words, peak / n_words / 8
