"""Operators on documents, against brute force on small tables with awkward rows."""

import collections
import itertools
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import bloom_lm, common, decontaminate, jaccard, langid, packing, quality_fm, token_files, tokens

WORD, BYTE = tokens.tokenizer_path("word_bpe_49k.json"), tokens.tokenizer_path("byte_bpe_50k.json")
ODD = [None, "", "   ", "a  b  c\n\n d\x01 \x01", " x", "foo \n", "\n \nb", "foo   bar", "don't!! a--b 12", " q w　 e", "a\x1cb ,c.", "<|endoftext|> x", "ab, cd.\nEf! "]


def docs(spark, texts, start=0):
    rows = [(start + i, t, f"s{i}") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, token string")  # token: a name that clashes inside


@pytest.mark.parametrize("most", [300_000, 40])
@pytest.mark.parametrize("path", [WORD, BYTE])
def test_ids_of_slice_after_slice(path, most, monkeypatch):
    monkeypatch.setattr(tokens, "MOST", most)
    rng, e = random.Random(21), tokens.Encoder(path)
    for _ in range(6):
        texts = rng.sample(ODD, 5) + ["".join(rng.choice(["tea", "B", "é", " ", "\n", ".", ",", "'s", "1"]) for _ in range(30)) for _ in range(40)]
        ids, edges = e.encode(pa.array(texts, type=pa.string()), 7)
        whole = e.tokenizer.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)
        assert [ids[a:b].tolist() for a, b in itertools.pairwise(edges.tolist())] == [w.ids + [7] for w in whole]


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_ids_are_the_tokenizers(path):
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice(["a", "B", "é", " ", "\n", ".", ",", "'s", "1", "\x01"]) for _ in range(12)) for _ in range(500)]
    e = tokens.Encoder(path)
    ids, edges = e.encode(pa.array(texts, type=pa.string()), 7)
    whole = e.tokenizer.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)
    assert [ids[a:b].tolist() for a, b in itertools.pairwise(edges.tolist())] == [w.ids + [7] for w in whole]


def test_packing_puts_each_id_in_one_piece(spark):
    rng = random.Random(2)
    texts = [*ODD, *[" ".join(rng.choice(["alpha", "beta.", "gamma"]) for _ in range(rng.randint(1, 900))) for _ in range(30)], "word " * 9000]
    pieces = packing.pack_documents(docs(spark, texts).repartition(2), WORD).toPandas()
    e = tokens.Encoder(WORD)
    ids, edges = e.encode(pa.array(texts, type=pa.string()), 1)
    for i, p in pieces.groupby("doc_id"):
        p = p.sort_values("start")
        assert b"".join(p["ids"]) == ids[edges[i] : edges[i + 1]].tobytes()
        assert (p["doc_tokens"] == edges[i + 1] - edges[i]).all() and p["start"].tolist() == [0, *np.cumsum(p["length"])[:-1]]
    padding = 0
    for _s, p in pieces.groupby("sequence_id"):
        p = p.sort_values("offset")
        used = int(p["length"].sum())
        assert p["offset"].tolist() == [0, *np.cumsum(p["length"])[:-1]] and used <= 2048
        padding += 0 if used & (used - 1) == 0 else 2048 - used
    assert padding < 0.05 * len(ids)
    assert packing.pack_documents(docs(spark, ["x"]).limit(0), WORD).count() == 0


def test_cuts_are_the_cheapest():
    rng = random.Random(3)
    for _ in range(30):
        limit = 16
        at = sorted({0, *(rng.randint(1, 60) for _ in range(14)), *range(0, 61, 8)})
        penalty = [0, *(rng.choice([0, 3, 9]) for _ in at[1:])]
        free = {1 << k for k in range(5) if 1 << k >= limit // 8}

        def cost(cuts, at=at, penalty=penalty, free=free):
            where = dict(zip(at, penalty, strict=True))
            return sum(packing.PER_SEQUENCE + where[b] + (0 if b - a in free else limit - (b - a)) for a, b in itertools.pairwise(cuts))

        best = {0: 0}
        for b in at[1:]:
            best[b] = min(best[a] + cost([a, b]) for a in at if a < b and b - a <= limit)
        assert cost(packing.best_cuts(at, penalty, limit, False)) == best[at[-1]]


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_token_files_round_trip(spark, tmp_path, encoding):
    table = docs(spark, ODD * 3).withColumn("part", F.lit(1))
    path = str(tmp_path / "t")
    token_files.write_token_files(table.orderBy(F.desc("doc_id")), path, BYTE, encoding=encoding)
    files = token_files.read_token_files(spark, path)
    got = token_files.with_global_start(token_files.with_crc32(files), files).orderBy("doc_id").collect()
    ids, edges = tokens.Encoder(BYTE).encode(pa.array(ODD * 3, type=pa.string()), 0)
    assert [(r["start"], r["n_tokens"], r["ids_crc32"]) for r in got] == [(a, b - a, zlib.crc32(ids[a:b].tobytes())) for a, b in itertools.pairwise(edges.tolist())]
    assert token_files.read_token_files(spark, path, 3, 5).count() == 3


def brute_jaccard(texts, width, percent):
    sets = []
    for t in texts:
        w = [x for x in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set()))
    component = list(range(len(texts)))
    for a, b in itertools.combinations(range(len(texts)), 2):
        i = len(sets[a] & sets[b])
        if i and 100 * i >= percent * (len(sets[a]) + len(sets[b]) - i):
            low, high = sorted((component[a], component[b]))
            component = [low if c == high else c for c in component]
    return [(len(s), c) for s, c in zip(sets, component, strict=True)]


@pytest.mark.parametrize(("width", "percent"), [(3, 90), (5, 80)])
def test_jaccard_equals_brute_force(spark, width, percent):
    rng = random.Random(width)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(3))
    base = [[word() for _ in range(rng.choice([30, 80, 200]))] for _ in range(6)]
    texts = [None, "", " \n ", "one", "One", "two words", "two words", "x y z"]
    for _ in range(90):
        w = list(rng.choice(base))
        for _k in range(rng.choice([0, 0, 1, 2, 3, 5])):
            w[rng.randrange(len(w))] = word()
        w = w[: len(w) - rng.choice([0, 0, 1, 4, 9])]
        texts.append(" ".join(w) + rng.choice(["", " the common passage of many words stands here at the end"]))
    got = jaccard.jaccard_links(docs(spark, texts), width, percent).orderBy("doc_id").collect()
    assert [(r["n_shingles"], r["component_id"]) for r in got] == brute_jaccard(texts, width, percent)


def test_jaccard_of_repeated_and_missing_ids(spark):
    rows = [(5, "a b c d"), (5, "a b c d"), (None, "a b c d"), (3, "A b c D"), (9, None)]
    got = jaccard.jaccard_links(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert collections.Counter((r["doc_id"], r["component_id"]) for r in got) == {(5, 3): 2, (None, None): 1, (3, 3): 1, (9, 9): 1}
    assert jaccard.jaccard_links(docs(spark, ["a"]).limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 130)]
    got = {r["id"]: r["component"] for r in common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    low = {n: n for e in edges for n in e}
    for _ in range(60):
        for a, b in edges:
            low[a] = low[b] = min(low[a], low[b])
    assert all(got.get(n, n) == c for n, c in low.items())


def test_decontamination(spark):
    items = [(1, "If Alice buys 12 apples at 3 dollars each, how many dollars does Alice pay Bob after 12 days of work?"), (2, "too short"), (3, None), (4, "the train leaves the station in the north and then it stops for good near the harbour"), (4, "the train leaves the station in the north and then it stops for good near the harbour")]
    texts = [
        "Intro. If Carol buys 15 apples at 7 dollars each, how many dollars does Carol pay Dan after 15 days of work? End.",
        "Intro. If Carol buys 15 apples at 7 dollars each, how many dollars does Eve pay Dan after 99 days of work?",
        "clean text about the station in the north and other things that are too short to count as much",
        "before. The train leaves the station in the north and then it stops for good near the harbour. after",
        None,
        "",
        "THE TRAIN leaves the station, in the north - and then it stops for good near the harbour!",
    ]
    table, bench = docs(spark, texts).withColumn("item_id", F.lit(0)), spark.createDataFrame(items, "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]): r["exact"] for r in decontaminate.contaminated(table, bench).collect()}
    assert found == {(0, 1): False, (3, 4): True, (6, 4): True}
    kept = decontaminate.decontaminate(table, bench)
    assert kept.columns == table.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 4, 5]
    assert decontaminate.contaminated(table.limit(0), bench).count() == decontaminate.contaminated(table, bench.limit(0)).count() == 0



def test_rows_are_judged_by_their_own_text(spark):
    item = "the train leaves the station in the north and then it stops for good near the harbour"
    rows = [(None, item), (None, "clean text of no item"), (5, f"so {item}"), (5, "another clean text"), (6, None), (7, ""), (8, "word " * 60_000 + item + " word" * 60_000)]
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"words": F.lit(1), "hash": F.lit(2)})
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    for _ in range(3):  # the same each time
        kept = decontaminate.decontaminate(table, bench)
        assert kept.columns == table.columns
        assert sorted(kept.select("doc_id", "text").collect(), key=str) == sorted([(None, "clean text of no item"), (5, "another clean text"), (6, None), (7, "")], key=str)


def test_names_stand_one_to_one(spark):
    item = "On that day Anna gave 12 apples to Bertha and then 15 apples to her other friend for the party"
    told = ["On that day Carla gave 9 apples to Doris and then 9 apples to her other friend for the party", "On that day Carla gave 9 apples to Carla and then 7 apples to her other friend for the party"]
    got = decontaminate.contaminated(docs(spark, told), spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert [(r["doc_id"], r["exact"]) for r in got] == [(0, False)]


def test_decontamination_finds_verbatim_copies(spark):
    items = [(1, "What is 12 + 7 + 30?"), (2, "we flew to Rome with Ann and from Rome to Oslo with Ben and then to Bonn with Eve"), (3, "water boils at 100 ° on the stove in the kitchen of the old house"), (4, "Paris lies on the river Seine")]
    texts = [
        "So: What is 12 + 7 + 30? Tell me.",
        items[1][1].lower(),
        items[1][1].upper(),
        "It is known that " + items[2][1],
        "they say Paris lies on the river Seine",
        "What is 12 + 8 + 30?",
        "a mark \ue001 here. " + items[1][1],
    ]
    got = decontaminate.contaminated(docs(spark, texts), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"], r["exact"]) for r in got} == {(0, 1, True), (1, 2, True), (2, 2, True), (3, 3, True), (4, 4, True), (6, 2, True)}



def test_decontamination_sums_neighbouring_diagonals(spark):
    thirds = ["one red fox ran over the wide field", "while two grey owls sat in some tree", "and no dog of that farm woke up"]
    letter = "on the first day of june we all wrote to New York that our %s boxes had been sent off by mail and paid in full"
    items = [(1, " ".join(thirds)), (2, letter % 15)]
    texts = [
        "Look. " + " then ".join(thirds),
        thirds[0] + " and other things",
        thirds[0] + " then" * 40 + " " + thirds[1],
        (letter % 20).replace("New York", "Boston"),
        " ".join(thirds),
    ]
    got = decontaminate.contaminated(docs(spark, texts), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"], r["exact"]) for r in got} == {(0, 1, True), (3, 2, False), (4, 1, True)}
    assert {r["doc_id"]: (r["found"], r["words"]) for r in got if r["item_id"] == 1} == {0: (24, 24), 4: (24, 24)}


def test_language_model(spark):
    rng = random.Random(5)
    texts = [None, "", "\n", *[" ".join(rng.choice(["the", "Cat", "sat", "on", "mat", f"w{rng.randrange(400)}"]) for _ in range(rng.randint(1, 60))) for _ in range(80)], "unseen words only"]
    table = docs(spark, texts)
    learn = table.where("doc_id % 3 <> 0 and doc_id < 83")
    model = bloom_lm.train(learn)
    got = {r["doc_id"]: r for r in bloom_lm.score(table, model).collect()}
    split = lambda t: [w for w in re.split("[\x20\x09-\x0d]+", (t or "").lower()) if w] + ["</s>"]
    c = collections.Counter(w for i, t in enumerate(texts) if i % 3 and i < 83 for w in split(t))
    n, v = sum(c.values()), len(c)
    assert (model.tokens, model.types) == (n, v)
    for i, t in enumerate(texts):
        w = split(t)
        assert (got[i]["n_tokens"], got[i]["n_known"]) == (len(w), sum(c[x] > 0 for x in w))
        assert got[i]["base_score"] == pytest.approx(sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w))
        assert got[i]["score"] <= 0
    empty = bloom_lm.score(table, bloom_lm.train(learn.limit(0))).collect()
    assert len(empty) == len(texts) and all(r["n_known"] == 0 for r in empty)



def test_language_model_counts_bigrams_of_rare_words(spark, monkeypatch):
    table = docs(spark, ["of the of the of the"] * 20 + ["salty otter", "otter salty otter"] * 4 + ["salty otter", "otter otter salty"])
    scores = lambda: {r["doc_id"]: r["score"] for r in bloom_lm.score(table, bloom_lm.train(table)).collect()}
    all_words = scores()
    monkeypatch.setattr(bloom_lm, "FREQUENT", 3, raising=False)
    assert scores() == pytest.approx(all_words)



def test_language_model_keeps_bigrams_seen_once(spark):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(300)]
    rng.shuffle(words)
    swapped = words[:]
    rng.shuffle(swapped)
    train = docs(spark, [" ".join(words)])
    got = {r["doc_id"]: r for r in bloom_lm.score(docs(spark, [" ".join(words), " ".join(swapped)]), bloom_lm.train(train)).collect()}
    assert got[0]["base_score"] == pytest.approx(got[1]["base_score"])
    assert got[0]["score"] > got[1]["score"] + 250  # each word follows its own predecessor, once


def test_language_model_in_many_shards(spark, monkeypatch):
    rng = random.Random(12)
    texts = [" ".join(f"w{int(rng.paretovariate(0.6)) % 3000}" for _ in range(200)) for _ in range(60)]
    table = docs(spark, texts)
    scored = lambda: bloom_lm.score(table, model).orderBy("doc_id").toPandas()
    model = bloom_lm.train(table)
    whole = scored()
    monkeypatch.setattr(bloom_lm, "WORDS_BYTES", 4000)
    monkeypatch.setattr(common, "SLICE_BYTES", 5000)
    monkeypatch.setattr(bloom_lm, "BITS", 40_000)  # 1 MB a shard is fixed: so there are many
    model = bloom_lm.train(table)
    assert model.words > 5 and model.filters > 50
    many = scored()
    assert many["n_known"].tolist() == whole["n_known"].tolist() == many["n_tokens"].tolist()
    assert many["base_score"].tolist() == pytest.approx(whole["base_score"].tolist())
    # by the formula, with quantised bigram counts
    split = [["$", *t.split(), "$"] for t in texts]
    one, two = collections.Counter(w for t in split for w in t[1:]), collections.Counter(p for t in split for p in itertools.pairwise(t))
    after = collections.Counter(v for v, _ in two)
    n = sum(one.values()) + 0.1 * (len(one) + 1)

    def p(v, w):
        seen = min(float(bloom_lm._value(bloom_lm._level(np.array([two[v, w]])))[0]), one[v], one[w])
        return min(1.0, (seen - 0.5) / one[v] + min(1.0, max(0.02, 0.5 * after[v] / one[v])) * (one[w] + 0.1) / n)

    exact = [sum(math.log10(p(v, w)) for v, w in itertools.pairwise(t)) for t in split]
    assert many["score"].tolist() == pytest.approx(exact)
    assert whole["score"].tolist() == pytest.approx(exact, rel=0.01)


def test_probabilities_sum_to_one_over_the_vocabulary(spark):
    rng = random.Random(13)
    texts = [" ".join(f"w{int(rng.paretovariate(0.7)) % 4000}" for _ in range(250)) for _ in range(120)]
    model = bloom_lm.train(docs(spark, texts))
    c = collections.Counter(w for t in texts for w in t.split())
    ranked = [w for w, _ in c.most_common()]
    some = [ranked[0], ranked[1], next(w for w in ranked if c[w] <= 40), next(w for w in ranked if c[w] <= 5), *rng.sample([w for w in ranked if c[w] == 1], 3)]
    shards = {(r["kind"], r["shard"]): r for r in model.shards.collect()}
    h = {w: np.uint64(x) for w, x in zip(ranked, common.hash_words(ranked), strict=True)}
    every = np.array([h[w] for w in ranked])
    known = {k: np.concatenate([np.frombuffer(r[k], dtype=np.uint64 if k == "x" else np.int64) for (kind, _), r in sorted(shards.items()) if kind == 1]) for k in "xyz"}
    after = dict(zip(known["x"].tolist(), known["z"].tolist(), strict=True))
    n = model.tokens + 0.1 * (model.types + 1)
    now = np.array([c[w] for w in ranked])
    for v in some:
        pairs = bloom_lm._pair(np.stack([np.full(len(every), h[v]), every], axis=1).ravel(), np.arange(1, 2 * len(every), 2))
        level = np.zeros(len(pairs), dtype=np.int64)
        order, places = bloom_lm._shards_of(pairs, model.filters)
        for s, a, b in places:
            level[order[a:b]] = bloom_lm._levels(np.frombuffer(shards[2, s]["x"], dtype=np.uint8), pairs[order[a:b]])
        one = lambda x: np.full(len(now), x)
        p = bloom_lm._probability(level, now, one(c[v]), one(after[int(h[v])]), (now + 0.1) / n, model.types, model.false)
        ends = sum(t.split()[-1] == v for t in texts)  # the end and unknown words are the rest of the sum
        end = bloom_lm._probability(bloom_lm._level(np.array([max(ends, 1)])) * (ends > 0), np.array([len(texts)]), np.array([c[v]]), np.array([after[int(h[v])]]), np.array([(len(texts) + 0.2) / n]), model.types, model.false)
        assert p.sum() + end[0] == pytest.approx(1, abs=0.05), (v, c[v])


def test_filter_counts_are_quantised_and_never_too_low():
    h = np.arange(1, 2000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    c = np.arange(1, 2000)
    levels = bloom_lm._level(c)
    values = bloom_lm._value(levels)
    assert (np.abs(values - c) <= 0.5 * c + 0.5).all() and len(h) == len(values)


def test_language_identification(spark):
    rng = random.Random(6)
    pool = {"en": ["the", "and", "with", "house", "water"], "fr": ["le", "dans", "être", "maison", "eau"], "de": ["der", "und", "nicht", "straße", "wasser"]}
    rows = [(i, " ".join(rng.choice(pool[k]) for _ in range(rng.randint(5, 40))), k) for i, k in enumerate(itertools.islice(itertools.cycle(pool), 240))]
    rows += [(500, None, "en"), (501, "", "en"), (502, "12 34 !!", "fr"), (503, "the house and the water " * 3000, None)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("lang_pred", F.lit("old"))
    told = {r["doc_id"]: r for r in langid.predict(table, langid.train(table.where("doc_id % 4 <> 2"))).collect()}
    held = [i for i, _t, _k in rows[:240] if i % 4 == 2]
    assert sum(told[i]["lang_pred"] == told[i]["lang"] for i in held) >= 0.97 * len(held)
    assert all(told[i]["lang_pred"] == "und" and told[i]["lang_rejected"] and told[i]["lang_score"] == 0 for i in (500, 501, 502))
    assert told[503]["lang_pred"] == "en" and all(0 <= r["lang_score"] <= 1 for r in told.values())
    none = langid.predict(table, langid.train(table.limit(0)))
    assert {r["lang_pred"] for r in none.collect()} == {"und"}


def test_language_scores_equal_brute_force(spark):
    rng = random.Random(16)
    pool = {"aa": "aqua bona casa dura", "bb": "zwei drei vier fünf", "cc": "ñandú año niño uña", "dd": "only once"}
    rows = [(i, " ".join(rng.choices(pool[k].split(), k=rng.randint(1, 30))), k) for i, k in enumerate(["aa", "bb", "cc"] * 20)] + [(100, pool["dd"], "dd"), (100, pool["dd"], "dd"), (101, None, "aa"), (102, "x", None), (103, "ab", "ee")]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    m = langid.train(table)
    assert m.languages == ["aa", "bb", "cc", "dd"]  # "ab" has no n-gram
    texts = [*ODD, "drei AÑOS", "only once", "a" * 70_000 + " bona"]
    got = {r["doc_id"]: r for r in langid.predict(docs(spark, texts), m).collect()}
    for i, t in enumerate(texts):
        raw, z, n = (t or "").lower().encode(), np.zeros(len(m.languages)), 0
        for width in langid.WIDTHS:
            for a in range(len(raw) - width + 1):
                h = width
                for byte in raw[a : a + width]:
                    h = (h * 0x01000193 & 0xFFFFFFFF) ^ byte
                h = (h ^ h >> 15) * 0x85EBCA6B & 0xFFFFFFFF
                z += m.table[h >> 17]
                n += 1
        z = (z / max(n, 1) + m.bias) / m.temperature
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        letters = any(c.isalpha() for c in t or "")
        assert got[i]["lang_pred"] == (m.languages[int(p.argmax())] if letters else "und")
        assert got[i]["lang_score"] == pytest.approx(float(p.max()) if letters else 0.0, abs=1e-5)


def test_many_languages_are_all_learned(spark):
    rows = [(k * 40 + i, f"{chr(97 + k % 26) * 3}{chr(97 + k // 26) * 4} " * 8, f"l{k:03}") for k in range(450) for i in range(2)]
    m = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert m.languages == [f"l{k:03}" for k in range(450)]


def test_quality_takes_metadata(spark):
    rng = random.Random(17)
    text = lambda: " ".join(rng.choices("the river runs slowly past town".split(), k=30))
    rows = [(i, text(), 10_000 if i % 2 else 5) for i in range(300)] + [(900, text(), None)]
    table = spark.createDataFrame(rows, "doc_id long, text string, n_chars long").withColumn("__x", F.lit(1))
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(3, 0), (4, None)], "doc_id long, quality int")
    m = quality_fm.train(table, labels)
    told = {r["doc_id"]: r["quality_score"] for r in quality_fm.score(table, m).collect()}
    assert all((told[i] >= 0.5) == (i % 2 == 1) for i in range(200, 300)) and 0 <= told[900] <= 1
    bare = quality_fm.score(table.drop("n_chars"), m)
    assert bare.columns == ["doc_id", "text", "__x", "quality_score"] and bare.count() == len(rows)
    assert quality_fm.score(table.limit(0), m).count() == 0


def test_quality_classifier(spark):
    rng = random.Random(7)
    good = lambda: " ".join(rng.choice(["the", "river", "runs", "slowly,", "past", "town."]) for _ in range(40))
    junk = lambda: " ".join(rng.choice(["BUY!!", "now$$$", "click###", "free%%%"]) for _ in range(40))
    rows = [(i, good() if i % 3 else junk()) for i in range(240)] + [(900, None), (901, ""), (902, good() * 200)]
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumn("id", F.lit(1))
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(160)] + [(None, 1, 0), (7000, 0, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    told = {r["doc_id"]: r["quality_score"] for r in quality_fm.score(table, quality_fm.train(table, labels)).collect()}
    assert all((told[i] >= 0.5) == (i % 3 > 0) for i in range(160, 240)) and told[902] >= 0.5
    assert all(0 <= s <= 1 for s in told.values())
    flat = quality_fm.score(table, quality_fm.train(table, labels.limit(0)))
    assert {r["quality_score"] for r in flat.collect()} == {0.5}


def test_machine_equals_the_sum_over_pairs():
    rng = np.random.default_rng(8)
    s = len(quality_fm.STATISTICS)
    m = quality_fm.QualityModel(np.zeros(s), np.ones(s), 0.3, rng.normal(size=s + quality_fm.BUCKETS), rng.normal(size=(s + quality_fm.BUCKETS, 3)))
    texts = pa.array(["some words here, and words again", ""])
    statistics, of, bucket = quality_fm._inputs(texts)
    for i, z in enumerate(quality_fm._design(m, texts)):
        b = s + bucket[of == i]
        index = np.concatenate([np.arange(s), b])
        x = np.concatenate([np.clip(statistics[i], -4, 4), np.full(len(b), 1 / np.sqrt(max(len(b), 1)))])
        pairs = sum(m.factor[index[p]] @ m.factor[index[q]] * x[p] * x[q] for p, q in itertools.combinations(range(len(index)), 2))
        assert z == pytest.approx(m.bias + m.weight[index] @ x + pairs)
