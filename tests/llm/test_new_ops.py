"""URL rules, vector codes and spelling variants against plain Python."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import queries, spelling, url_filters, vector_codes


# ------------------------------------------------------------------ URL rules
def test_patterns_and_tokens():
    of = lambda p: url_filters.compiled(p)[1]
    assert of("||example.com/en/") == ["example", "com", "en"]
    assert of("ads") == [] and of("|ads|") == ["ads"] and of("/ads^") == ["ads"]
    assert of("||a*b.c^") == ["c"] and of("*x-y*") == []
    assert of("ads.js") == []
    assert of("/Login^") == ["login"]


def _by_hand(url, hosts):
    host = path = rest = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        tail = rest[len(host) :]
        path = re.match(r"[^?#]*", tail)[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
        rest = host + tail
    best = None
    for verdict, name in hosts:
        h, _, p = name.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(name) > len(best[1])):
            best = verdict, name
    if best:
        return host, path, best[1], best[0]
    verdict = "allow"
    for r in url_filters.PATTERNS:
        if re.search(url_filters.compiled(r.pattern)[0], rest, re.I | re.A | re.S):
            verdict = r.verdict if r.verdict == "block" and verdict != "last" else "last"
    return host, path, None, "allow" if verdict == "last" else verdict


HOSTS = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def test_urls_against_every_rule(spark):
    rng = random.Random(3)
    urls = [None, "", "example.com/en/", "http://", "http://example.com", "HTTP://WWW.Example.COM/en/1", "http://example.com/EN/1", "http://example.com?x/en/", "http://user@example.com:80/en/", "ftp://com/", "http://.com/", "http://xcom/", "a://b://example.com/en/", "http://x.net/es", "http://x.net/es/?q=1#f", "http://x.net/fr/" + "y" * 300_000, "http://x.org/robots.txt", "http://adult-x.org/robots.txt", "http://x.org/a\nb/login", "http://ſ.org/\u212alogin/", "http://x.org/logins", "http://tr.\u212ak.net/login\u212a", "http://x.example.net/fr/1", "http://x.example.net/fr/1"]
    for _ in range(400):
        host = ".".join(rng.choice(["www", "example", "ads", "adult-x", "com", "net", "org", "track", "m"]) for _ in range(rng.randint(1, 4)))
        urls.append(f"http://{host}/" + "/".join(rng.choice(["en", "es", "fr", "login", "cart", "1", "casino", "robots.txt"]) for _ in range(rng.randint(0, 3))) + rng.choice(["", "/", "?q=/en/", "#x"]))
    rows = [(i, u, "kept", "clash") for i, u in enumerate(urls)] + [(None, urls[5], None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, host string, url_host string")
    rules = [*[url_filters.host_rule(*h) for h in HOSTS], *url_filters.PATTERNS]
    got = url_filters.judge(df, rules).collect()
    assert len(got) == len(rows) and got[0]["host"] == "kept"
    for r in got:
        assert (r["url_host"], r["url_path"], r["url_rule"], r["url_verdict"]) == _by_hand(r["url"], HOSTS), r["url"]
    assert url_filters.judge(df.limit(0), rules).count() == 0
    assert {r["url_verdict"] for r in url_filters.judge(df, [], otherwise="block").collect()} == {"block"}


def test_rules_in_blocks_decide_as_one(spark, monkeypatch):
    urls = [f"http://{a}.{b}/{c}" for a, b, c in itertools.product(["ads", "x", "www.example"], ["com", "net"], ["en/1", "login", "cart/", "fr/"])]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    rules = [*[url_filters.host_rule(*h) for h in HOSTS], *url_filters.PATTERNS, url_filters.Rule("*", "allow"), url_filters.Rule("cart", "block")]
    whole = sorted(map(tuple, url_filters.judge(df, rules).collect()))
    monkeypatch.setattr(url_filters, "BLOCK_RULES", 3)
    assert sorted(map(tuple, url_filters.judge(df, rules).collect()), key=str) == sorted(whole, key=str)


def test_a_rule_is_filed_under_its_rarest_token(spark):
    df = spark.createDataFrame([(f"http://common.org/{i}/common",) for i in range(20)] + [("http://common.org/rare/",)], "url string")
    assert url_filters.token_counts(df, "url", {"common", "rare", "absent"}) == {"common": 21, "rare": 1}
    got = url_filters.judge(df, [url_filters.Rule("||common.org/rare/", "block")]).where("url_verdict = 'block'").collect()
    assert [r["url"] for r in got] == ["http://common.org/rare/"]


# ------------------------------------------------------------------ vector codes
def _codes_by_hand(rows, parts=8, entries=16, rounds=6):
    kept = sorted(((i, v, lab) for i, v, lab in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)), key=lambda r: (r[0] is None, r[0] or 0, np.floor(4096 * np.array(r[1], dtype=float)).tolist()))
    ints = [[int(np.floor(4096.0 * float(x))) for x in v] for _, v, _ in kept]
    w = len(ints[0]) // parts if ints else 0
    cut = lambda v, p: v[p * w : (p + 1) * w]
    books = [[cut(v, p) for v in ints[:entries]] for p in range(parts)]

    def assign():
        out = []
        for v in ints:
            out.append([min((sum((a - b) ** 2 for a, b in zip(cut(v, p), e)), k) for k, e in enumerate(books[p])) for p in range(parts)])
        return out

    for _ in range(rounds):
        told = assign()
        for p in range(parts):
            for k in range(len(books[p])):
                mine = [cut(v, p) for v, t in zip(ints, told) if t[p][1] == k]
                if mine:
                    books[p][k] = [sum(c) // len(mine) for c in zip(*mine)]
    told = assign()
    by_label = collections.Counter()
    for (_, _, lab), t in zip(kept, told):
        by_label[lab] += sum(d for d, _ in t)
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, lab, "".join(f"{k:02x}" for _, k in t), sum(d for d, _ in t), by_label[lab], sha) for (i, _, lab), t in zip(kept, told)), key=str)


def test_codes_against_brute_force(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(30, 16))
    rows = [(i, (centres[i % 30] + rng.normal(size=16) * 0.2).tolist(), [None, 1, 2][i % 3]) for i in range(600)]
    rows += [(1000 + i, rows[7][1], 7) for i in range(300)]  # a third are copies
    rows += [(3, rows[3][1], 0), (None, rows[5][1], 1), (-1, None, 1), (-2, [float("nan")] * 16, 1), (-3, [None] + [0.0] * 15, 1), (-4, [float("-inf")] * 16, None), (2000, [0.0] * 16, 5), (2001, [-1e-9] * 16, 5)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, code string").repartition(5)
    got = vector_codes.compress(df).collect()
    assert sorted((tuple(r) for r in got), key=str) == _codes_by_hand(rows)


def test_codes_of_awkward_tables(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert vector_codes.compress(spark.createDataFrame([], schema)).count() == 0
    few = [(i, [float(i * j % 5) for j in range(16)], None) for i in range(5)]
    assert sorted((tuple(r) for r in vector_codes.compress(spark.createDataFrame(few, schema)).collect()), key=str) == _codes_by_hand(few)
    mixed = few + [(10, [], 1), (11, [1.0, 2.0, 3.0], 1), (12, [1.0, 2.0, 3.5], 1)]
    got = {r["vec_id"]: r for r in vector_codes.compress(spark.createDataFrame(mixed, schema)).collect()}
    assert len(got) == 8 and got[10]["code"] == "00" * 8 and got[10]["error"] == 0
    assert got[11]["error"] == got[12]["error"] == 0 and got[11]["code"] != got[12]["code"]
    assert got[0]["codebooks_sha256"] != got[11]["codebooks_sha256"]
    with pytest.raises(Exception, match="above"):
        vector_codes.compress(spark.createDataFrame([(1, [1e30], 1)], schema)).collect()


def test_pruned_search_evaluates_less_and_finds_the_same(monkeypatch):
    rng = np.random.default_rng(6)
    entries = np.floor(rng.normal(size=(16, 8)) * 4096).astype(np.int64)
    rows = entries[rng.integers(0, 16, 3000)] + rng.integers(-200, 200, size=(3000, 8))
    rows[:100] = (entries[0] + entries[1]) // 2
    pivots = vector_codes.spread(entries)
    far = vector_codes.roots(vector_codes.squared(rows[:, None], pivots[None]))
    seen = []
    plain = vector_codes.squared
    monkeypatch.setattr(vector_codes, "squared", lambda a, b: (seen.append(len(a)), plain(a, b))[1])
    index, best = vector_codes.nearest(rows, far, entries, pivots)
    whole = plain(rows[:, None], entries[None])
    assert (index == whole.argmin(axis=1)).all() and (best == whole.min(axis=1)).all()
    assert sum(seen) < 0.4 * whole.size
    x = np.array([0, 1, 2, 3, 4, (1 << 30) ** 2 - 1, (1 << 30) ** 2, (1 << 60) + 12345], dtype=np.int64)
    r = vector_codes.roots(x)
    assert (r * r <= x).all() and ((r + 1) ** 2 > x).all()


def test_label_totals_with_many_labels(spark):
    told = spark.createDataFrame([(i, 1 if i % 3 == 0 else None if i % 7 == 0 else i, i) for i in range(1, 3000)], "id long, __label long, error long")
    totals = told.groupBy("__label").agg(F.sum("error").alias("label_error"), F.count("*").alias("__n")).withColumnRenamed("__label", "__of")
    a, b = (sorted(map(tuple, vector_codes.with_totals(told, totals, few).select("id", "label_error").collect())) for few in (1_000_000, 10))
    assert a == b and len(a) == 2999


# ------------------------------------------------------------------ spelling
def _near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def _variants_by_hand(counts):
    form, out = {}, []
    near = {w: [v for v in counts if _near(w, v)] for w in counts}
    for w in counts:
        best = min(near[w], key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * counts[w] else None
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, counts[w], len(near[w]), counts.get(form[w])))
    return sorted(out, key=str)


def test_variants_against_all_pairs(spark):
    rng = random.Random(4)
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(5, 8))) for _ in range(700)} | {"aaaaa", "aaaaaa", "aaaaaaa", "", "a", "b", "bb"}
    counts = {w: rng.choice([3, 3, 4, 6, 8, 12, 13, 30, 60, 500]) for w in words}
    df = spark.createDataFrame([(w, n, 0) for w, n in counts.items()] + [(None, 9, 0)], "word string, n long, form int")
    got = sorted((tuple(r) for r in spelling.variants(df).collect()), key=str)
    assert got == _variants_by_hand(counts)
    assert spelling.variants(df.limit(0)).count() == 0


def test_long_chains_end_at_their_root(spark):
    forms = [(f"w{i:03}", f"w{i + 1:03}") for i in range(37)] + [("x", "w020")]
    got = {r["word"]: r["root"] for r in spelling.followed(spark.createDataFrame(forms, "word string, form string")).collect()}
    assert got == {w: "w037" for w, _ in forms}


def test_groups_go_on_over_batches(spark):
    counts = {f"{c}aaaa": 3 + i for i, c in enumerate("abcdefghijklmnopqrstuvwxyz")}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert sorted((tuple(r) for r in spelling.variants(df).collect()), key=str) == _variants_by_hand(counts)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_spelling_query_against_plain_counting(spark, tmp_path):
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("abcdeÄö") for _ in range(rng.randint(4, 9))) for _ in range(150)]
    docs = [(i, " ".join(rng.choice(vocabulary).title() if rng.random() < 0.2 else rng.choice(vocabulary) for _ in range(200)) + ", x1y-z×÷ŒŒ") for i in range(120)]
    docs += [(500, None), (501, ""), (502, "1 2 3"), (None, docs[0][1]), (503, docs[1][1]), (503, docs[1][1]), (504, (docs[2][1] + " ") * 300)]
    spark.createDataFrame([(*d, "s") for d in docs], "doc_id long, text string, source string").write.parquet(f"file://{tmp_path}/documents.parquet")
    counts = collections.Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", text or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 97 == 0:
                k = h % len(w)
                w = w[:k] + w[k + 1 :]
            counts[w] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    got = queries.QUERIES["op13_spelling_variants"](spark, f"file://{tmp_path}")
    assert sorted((tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in got.collect()), key=str) == _variants_by_hand(counts)
