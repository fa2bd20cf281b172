"""What round 3 found: shuffle files and driver memory of finished tables, and work done twice."""

import random
import time

import pyarrow as pa
from pyspark.sql import functions as F

from tidemark.llm import common, decontaminate, tokens


def test_a_written_tables_shuffle_files_go(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled() -> int:
        names = files.getAllFiles()
        return sum("shuffle_" in names.apply(i).getName() for i in range(names.size()))

    spark._jvm.java.lang.System.gc()
    time.sleep(2)
    before, held = shuffled(), []
    for _ in range(6):
        rows = common.written(spark.range(20_000).groupBy(F.pmod("id", F.lit(997)).alias("k")).agg(F.sum("id").alias("s")), "sums")
        time.sleep(1)
        held.append(shuffled() - before)
    assert 0 < max(held) <= 2 * held[0], held  # those of two tables at most
    assert rows.count() == 997


def test_texts_without_placeholders_are_hashed_once(spark):
    texts = spark.createDataFrame([(1, "The cat sat.\n\tIt  slept"), (2, "we met Ann and 3 cats"), (3, None)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in decontaminate._shapes(texts, "doc_id").collect()}
    assert got[1]["words"] is None and got[1]["values"] == ["the", "cat", "sat", "it", "slept"]
    assert got[2]["words"] == ["we", "met", decontaminate.NAME, "and", decontaminate.NUMBER, "cats"] and got[2]["values"] == ["we", "met", "ann", "and", "3", "cats"]
    assert got[3]["words"] is None and got[3]["values"] == []


def test_windows_of_any_width(spark):
    rng = random.Random(31)
    lists = [[rng.randint(1, 2) for _ in range(n)] for n in [0, 3, 5, 7, 8, 9, 60]]
    rows = spark.createDataFrame(list(enumerate(lists)), "id long, w array<long>")
    for width in (1, 5, 6, 7, 8):
        seen = {}
        for r in decontaminate._windows(rows, width, "w").collect():
            own = lists[r["id"]]
            assert len(r["w"]) == max(len(own) - width + 1, 0)
            for i, h in enumerate(r["w"]):
                assert seen.setdefault(tuple(own[i : i + width]), h) == h
        assert len(set(seen.values())) == len(seen)


def test_a_lines_first_word_is_no_piece_of_its_own():
    rng = random.Random(33)
    texts = ["\n".join("".join(rng.choice("abé1'-") for _ in range(rng.randint(1, 9))) + " x" for _ in range(40)) + rng.choice(["", "\n", "\n\n b", " \n\tb"]) for _ in range(50)]
    e = tokens.Encoder(tokens.tokenizer_path("byte_bpe_50k.json"))
    ids, edges = e.encode(pa.array(texts), 0)
    whole = e.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
    assert [ids[a:b].tolist() for a, b in zip(edges.tolist(), edges.tolist()[1:], strict=False)] == [w.ids + [0] for w in whole]
    assert not [p for p in e.known.to_pylist() if p[0] == "\n" and p.strip() and not p[1:2].isspace()]
