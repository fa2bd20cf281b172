"""The language model's probabilities over whole vocabularies."""

import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import bloom_lm, common

FOLDER = Path("/root/testdata/sf0.1")


def sums(model, contexts):
    """p summed over the known words after each of ``contexts`` (hashes), with c(v); the end token is a word like any other."""
    shards = {(r["kind"], r["shard"]): r for r in model.shards.collect()}
    known = {k: np.concatenate([np.frombuffer(r[k], dtype=np.uint64 if k == "x" else np.int64) for (kind, _), r in sorted(shards.items()) if kind == 1]) for k in "xyz"}
    every, now = known["x"], known["y"]
    prior = (now + 0.1) / (model.tokens + 0.1 * (model.types + 1))
    out = []
    for v in contexts:
        at = int(np.flatnonzero(every == v)[0])
        pairs = bloom_lm._pair(np.stack([np.full(len(every), v), every], axis=1).ravel(), np.arange(1, 2 * len(every), 2), model.width)
        level = np.zeros(len(pairs), dtype=np.int64)
        order, places = bloom_lm._shards_of(pairs, model.filters)
        for s, a, b in places:
            level[order[a:b]] = bloom_lm._levels(np.frombuffer(shards[2, s]["x"], dtype=np.uint8), pairs[order[a:b]])
        same = lambda x: np.full(len(now), x)
        p = bloom_lm._probability(level, now, same(now[at]), same(known["z"][at]), prior, model.types, model.false)
        out.append((float(p.sum()), int(now[at])))
    return out


def once(model, n, seed):
    """Hashes of ``n`` words that training saw once."""
    seen = []
    for r in model.shards.where("kind = 1").collect():
        h, c = np.frombuffer(r["x"], dtype=np.uint64), np.frombuffer(r["y"], dtype=np.int64)
        seen += h[c == 1].tolist()
    return [np.uint64(h) for h in random.Random(seed).sample(seen, n)]


@pytest.mark.skipif(not FOLDER.exists(), reason="no test tables here")
def test_words_seen_once_sum_to_one_on_a_large_vocabulary(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").where(common.fold("doc_id", 10) != 0)
    model = bloom_lm.train(docs)
    assert model.types > 200_000 and model.width > bloom_lm.LEAST_WIDTH
    # a context of one token meets a few false hits of half a count each: the sum of one varies, their mean does not
    told = sums(model, once(model, 150, 1))
    assert all(c == 1 for _, c in told)
    assert np.mean([s for s, _ in told]) == pytest.approx(1, abs=0.05)


def test_equal_hashes_of_bigrams_are_divided_out(spark, monkeypatch):
    """With hashes of three bytes thousands of absent bigrams share a present one's."""
    monkeypatch.setattr(bloom_lm, "_width", lambda types, tokens: 3)
    rng = random.Random(3)
    texts = [" ".join(f"w{rng.randrange(20_000)}" for _ in range(300)) for _ in range(200)]
    model = bloom_lm.train(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"))
    assert model.width == 3 and model.types * model.false > 10
    told = sums(model, once(model, 12, 2))
    assert np.mean([s for s, _ in told]) == pytest.approx(1, abs=0.1)


def test_hashes_grow_with_the_corpus():
    assert [bloom_lm._width(10**v, 10**n) for v, n in ((3, 5), (6, 7), (7, 9), (8, 12))] == [5, 6, 7, 8]
    h = np.random.default_rng(1).integers(0, 2**63, 1000, dtype=np.uint64)
    for width in range(5, 9):
        kept = h & bloom_lm._high(width)
        assert (bloom_lm._unpacked(bloom_lm._packed(kept, width), width) == kept).all()


def test_a_filter_never_tells_too_low_a_level():
    h = np.random.default_rng(2).integers(0, 2**63, 20_000, dtype=np.uint64)
    c = np.random.default_rng(3).integers(1, 3000, 20_000)
    bits = np.frombuffer(bloom_lm._filled(h, c), dtype=np.uint8)
    assert (bloom_lm._levels(bits, h) >= bloom_lm._level(c)).all()
    absent = np.random.default_rng(4).integers(2**63, 2**64 - 1, 20_000, dtype=np.uint64)
    assert (bloom_lm._levels(bits, absent) > 0).mean() < 0.01


def test_null_ids_and_repeated_rows(spark):
    df = spark.createDataFrame([(None, "a b a b"), (None, "a b a b"), (1, None), (2, "a b")], "doc_id long, text string")
    got = bloom_lm.score(df, bloom_lm.train(df)).where(F.col("doc_id").isNull()).collect()
    assert len(got) == 2 and got[0]["score"] == got[1]["score"] and got[0]["n_tokens"] == 5


def test_shards_are_ranges_of_hashes():
    h = np.sort(np.random.default_rng(5).integers(0, 2**64 - 1, 5000, dtype=np.uint64))
    for shards in (1, 7, 200, 100_000):
        order, places = bloom_lm._shards_of(h, shards)
        assert (order == np.arange(len(h))).all() and [a for _, a, _ in places][1:] == [b for *_, b in places][:-1]
        assert places[0][1] == 0 and places[-1][2] == len(h) and len({s for s, *_ in places}) == len(places) <= shards
        mixed = np.random.default_rng(6).permutation(h)
        again, same = bloom_lm._shards_of(mixed & bloom_lm._high(5), shards)
        assert same == places and all(set(mixed[again[a:b]].tolist()) == set(h[a:b].tolist()) for _, a, b in places)
    assert bloom_lm._shards_of(h[:0], 3)[1] == []
