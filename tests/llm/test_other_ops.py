"""Embeddings, archives, pages and the pipeline."""

import hashlib
import io
import itertools
import random
import struct
import time
import zipfile
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import embeddings, html_main, warc_zip


def test_embeddings_against_brute_force(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(40, 16))
    rows = []
    for i in range(400):
        rows.append((i, (base[i % 40] + rng.normal(size=16) * rng.choice([0.05, 0.2, 0.6])).tolist()))
    rows += [(1000 + k, rows[3][1]) for k in range(30)]
    rows += [(2000, None), (2001, []), (2002, [0.0] * 16), (2003, [float("nan")] + [1.0] * 15), (2004, [float("inf")] * 16), (2005, [None] + [1.0] * 15), (2006, [1.0, 2.0]), (2007, [2.0, 4.0]), (None, rows[3][1]), (2008, [1e-200] * 16), (2009, [1e-200] * 16)]
    got = embeddings.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rep", F.lit(0))).collect()
    assert len(got) == len(rows)
    usable = [(i, np.array(v)) for i, v in rows if v and None not in v and np.isfinite(v).all() and np.any(v)]
    count, component = {i: 0 for i, _ in usable}, {i: i for i, _ in usable if i is not None}
    unit = {k: v / np.abs(v).max() for k, (_, v) in enumerate(usable)}
    links = []
    for a, b in itertools.combinations(range(len(usable)), 2):
        x, y = unit[a], unit[b]
        if len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.95:
            links.append((usable[a][0], usable[b][0]))
            count[usable[a][0]] += 1
            count[usable[b][0]] += 1
    for _ in range(50):
        for a, b in links:
            if a is not None and b is not None:
                component[a] = component[b] = min(component[a], component[b])
    found = {r["vec_id"]: r for r in got}
    total = sum(count.values())
    assert sum(abs(found[i]["n_links"] - n) for i, n in count.items()) <= 0.1 * total
    assert all(found[i]["n_links"] <= n for i, n in count.items())
    assert sum(found[i]["component_id"] == c for i, c in component.items()) >= 0.95 * len(component)
    assert all(found[i]["n_links"] == 0 and found[i]["component_id"] == i and found[i]["kept"] for i in (2000, 2001, 2002, 2003, 2004, 2005))
    assert found[None]["component_id"] is None and not found[None]["kept"]
    assert found[2009]["component_id"] == 2008
    assert embeddings.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>").limit(0)).count() == 0



def test_embeddings_lose_no_link_with_many_cells(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "CELL", 20)
    monkeypatch.setattr(embeddings, "BLOCK_BYTES", 0)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 64))
    hot = rng.normal(size=64)
    x[:1000] = hot / np.linalg.norm(hot) + rng.normal(size=(1000, 64)) * np.sqrt(0.03 / 64)  # cosine about 0.97
    x[1000:1200] = x[1000] + rng.normal(size=(200, 64)) * 0.02  # a tight group: all link
    x[1200:2000] = x[2000:2800] + rng.normal(size=(800, 64)) * 0.31  # pairs about the threshold
    got = embeddings.near_duplicate_vectors(spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")).toPandas().sort_values("vec_id")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = (unit @ unit.T >= 0.95) & ~np.eye(len(x), dtype=bool)
    assert got["n_links"].tolist() == links.sum(axis=1).tolist()
    component = np.arange(len(x))
    for _ in range(len(x)):
        lower = np.minimum(component, np.where(links, component[None, :], len(x)).min(axis=1))
        if (lower == component).all():
            break
        component = lower
    assert got["component_id"].tolist() == component.tolist()
    assert (got["kept"] == (got["component_id"] == got["vec_id"])).all()


def test_archives_round_trip(spark, tmp_path):
    long = "<p>" + "x" * 300 + "é</p>"
    rows = [(5, "http://a/ b\r\nc", long), (3, "http://b", long), (9, None, long), (4, "http://c", None), (6, "http://d", ""), (7, "u", "tiny"), (8, "u", "tiny"), (2, "u", "\r\n\r\nbody\r\n" + "y" * 200), (3, "http://b", long), (None, "u", long)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("size", F.lit(1))
    got = warc_zip.archive_pages(pages.repartition(3), str(tmp_path / "w")).collect()
    assert len(got) == len(rows)
    for page_id in (5, 9):
        r = next(r for r in got if r["page_id"] == page_id)
        assert (r["record_type"], r["refers_to"], r["payload"], r["declared_length"], r["declared_digest"]) == ("revisit", 3, None, len(long.encode()), hashlib.sha256(long.encode()).hexdigest())
    assert sorted((r["page_id"], bytes(r["payload"]).decode()) for r in got if r["record_type"] == "response" and r["page_id"] is not None) == sorted((i, t or "") for i, _u, t in rows if i not in (5, 9, None))
    assert next(r["url"] for r in got if r["page_id"] == 5) == "http://a/%20b%0D%0Ac"
    told = {(r["page_id"], r["record_type"]): r for r in warc_zip.with_payloads(warc_zip.archive_pages(pages.repartition(3), str(tmp_path / "v"))).collect()}
    assert all(told[i, "revisit"]["payload_digest"] == told[3, "response"]["payload_digest"] == hashlib.sha256(long.encode()).hexdigest() and told[i, "revisit"]["payload_bytes"] == len(long.encode()) for i in (5, 9))
    assert told[4, "response"]["payload_bytes"] == 0
    assert warc_zip.with_payloads(warc_zip.archive_pages(pages.limit(0), str(tmp_path / "e"))).count() == 0


def test_records_whose_edges_fall_on_the_edges_of_reads():
    rng = random.Random(10)
    pack = lambda raw: (d := zlib.compressobj(1, zlib.DEFLATED, 31)).compress(raw) + d.flush()
    for plain in (False, True):
        tail = warc_zip._record(2, "u", b"tail", 4, "0", "response", None)
        for size in range(65_536 - 40, 65_536 + 40):
            payload = rng.randbytes(size - 400)
            head = warc_zip._record(1, "u", payload, len(payload), "0", "response", None)
            first = head if plain else pack(head)
            if not plain:  # stored blocks: one byte more of payload is one byte more of the member
                payload = rng.randbytes(size - len(first) + len(payload))
                head = warc_zip._record(1, "u", payload, len(payload), "0", "response", None)
                first = pack(head)
            data = first + (tail if plain else pack(tail))
            assert list(warc_zip._records(pa.BufferReader(data), 0, len(data))) == [head, tail]


def test_zip_directories():
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("a.txt", "hello")
        z.writestr("é/b.txt", "world!")
        z.comment = b"a comment"
    data = raw.getvalue()
    found = warc_zip.zip_members(pa.BufferReader(data))
    assert {n: data[o : o + s] for n, (o, s, _m) in found.items()} == {"a.txt": b"hello", "é/b.txt": b"world!"}
    # the same archive with ZIP64 records for the directory and for one member
    name = b"big.warc"
    local = struct.pack("<4sHHHHHIIIHH", b"PK\x03\x04", 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, len(name), 20) + name + struct.pack("<HHQQ", 1, 16, 4, 4) + b"data"
    extra = struct.pack("<HHQQQ", 1, 24, 4, 4, 0)
    central = struct.pack("<4sHHHHHHIIIHHHHHII", b"PK\x01\x02", 45, 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, len(name), len(extra), 0, 0, 0, 0, 0xFFFFFFFF) + name + extra
    end64 = struct.pack("<4sQHHIIQQQQ", b"PK\x06\x06", 44, 45, 45, 0, 0, 1, 1, len(central), len(local))
    tail = struct.pack("<4sIQI", b"PK\x06\x07", 0, len(local) + len(central), 1) + struct.pack("<4sHHHHIIH", b"PK\x05\x06", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    whole = local + central + end64 + tail
    (at, size, method), *_ = warc_zip.zip_members(pa.BufferReader(whole)).values()
    assert (whole[at : at + size], method) == (b"data", 0)
    with pytest.raises(ValueError):
        warc_zip.zip_members(pa.BufferReader(b"no archive here at all......"))


def test_plain_records_without_gzip():
    record = warc_zip._record(1, "u", b"abc\r\n\r\ndef", 10, "0", "response", None)
    assert list(warc_zip._records(pa.BufferReader(record * 3), 0, 3 * len(record))) == [record] * 3


PAGE = """<!DOCTYPE html><html><head><title>no</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></li></ul></nav>
<div class="cookie-notice">We use cookies, lots, of, them, on this page, as everyone does now.</div><!-- ad --><div class="ad">Buy, buy, buy, something, today, for your home and garden.</div>
%s<form><input><label>Name</label></form><section id="comments"><p>A reader, who writes much, says, with many commas, that this is long.</p></section>
<aside>Side, text, with commas, that goes on and on and on for a while.</aside><footer>&copy; Foot</footer></body></html>"""
TEXT = "Title &amp; more</h%d><p>First paragraph,  with\n commas, and enough text to count for something &lt;tag&gt;.</p><p><b>Second&nbsp;one <a href=#>link</a><br>goes on, here, for long enough to count.<p>Short.</p><ul><li>item one<li>item two</ul>"
EXPECTED = "Title & more\nFirst paragraph, with commas, and enough text to count for something <tag>.\nSecond one link goes on, here, for long enough to count.\nShort.\nitem one\nitem two"


@pytest.mark.parametrize("frame", ["<article><h1>%s<script>var a='<p>no</p>';</script></article>", "<main><div class=wrap><h1>%s</div></main>", "<div class='post-content'><h1>%s</div>", "<div><div><h1>%s</div></div>"])
def test_main_text(frame):
    assert html_main.extract_main_text(PAGE % (frame % (TEXT % 1))) == EXPECTED


@pytest.mark.parametrize(("html", "text"), [(None, ""), ("", ""), ("plain &amp; simple", "plain & simple"), ("<p>a<b>c", "ac"), ("<div>" * 2000 + "x", "x"), ("<script>never closed <p>x", ""), ("<nav>only</nav>", ""), ("<p>x <!-- unclosed", "x")])
def test_broken_pages(html, text):
    assert html_main.extract_main_text(html) == text


PROSE = "<p>Words, more words, and yet more words, which make up the text of this page and go on for a while.</p>"
LINE = "Words, more words, and yet more words, which make up the text of this page and go on for a while."


@pytest.mark.parametrize("size", [1900, 2001, 70_000])
def test_attributes_of_any_length(size):
    value = "a < b > c" * (size // 9)
    assert html_main.extract_main_text(f'<article><div data-x="{value}" title=\'{value}\'>{PROSE}</div></article>') == LINE


@pytest.mark.parametrize("names", ["content has-sidebar", "page with-header", "post share-enabled", "layout-right-rail", "no-comments", "sidebar-layout", "widget", "ad"])
def test_names_do_not_take_out_the_text(names):
    aside = '<div class="sidebar">Side, text, with commas, that goes on.</div>'
    for frame in (f'<div class="{names}"><article>{PROSE * 3}</article>{aside}</div>', f'<div class="{names}">{PROSE * 3}{aside}</div>'):
        assert html_main.extract_main_text(frame) == "\n".join([LINE] * 3)


@pytest.mark.parametrize("part", ['<section class="comments">%s</section>', '<div id="sidebar-left">%s</div>', '<div class="cookie-notice">%s</div>', '<form class="x">%s</form>', '<div class="comment-list open">%s</div>', "<header>%s</header>", '<div class="ad-box2">%s</div>', "<div aria-hidden=true>%s</div>", "<p hidden>%s</p>"])
def test_what_is_not_the_article_goes(part):
    other = part % ("Other, things, that are not the article, said at some length here." * 2)
    for body in (f"{PROSE * 3}{other}", f"{other}{PROSE * 3}"):
        assert html_main.extract_main_text(f"<body><div>{body}</div></body>") == "\n".join([LINE] * 3)
    comments = '<section id="comments">' + "<p>Readers, who write, and write, much more than the author did, of all things.</p>" * 9 + "</section>"
    assert html_main.extract_main_text(f"<body><div>{PROSE}</div>{comments}</body>") == LINE


def test_pages_inside_a_form_siblings_and_odd_markup():
    assert html_main.extract_main_text(f"<body><form id=aspnet><input>{PROSE * 2}<button>Send</button></form></body>") == f"{LINE}\n{LINE}"
    assert html_main.extract_main_text(f"<main><h1>Title</h1><article>{PROSE}</article><article>{PROSE}</article></main>") == f"Title\n{LINE}\n{LINE}"
    assert html_main.extract_main_text(f'<article><p title="a hidden gem" data-id="nav">Words</p>{PROSE}</article>') == f"Words\n{LINE}"
    assert html_main.extract_main_text("<article><p>where <math><mi>x</mi></math> is it's <b it's>bold</b <i>y</i></p></article>") == "where x is it's boldy"
    began = time.time()
    for odd in ("<a ='" * 100_000, '<a "' * 100_000, "<a b=<" * 100_000, '<a="<a" ' * 100_000, "<!--" * 100_000, "<script " * 50_000, "< <<" * 100_000):
        html_main.extract_main_text(odd)
    assert time.time() - began < 60


def test_pages_keep_their_columns(spark):
    pages = spark.createDataFrame([(1, "u", None, "old"), (2, "v", "<p>long " + "word, " * 50000 + "</p>", "old")], "page_id long, url string, html string, text string")
    got = html_main.extract_pages(pages).orderBy("page_id").collect()
    assert [(r["page_id"], r["url"]) for r in got] == [(1, "u"), (2, "v")]
    assert got[0]["text"] == "" and got[1]["n_chars"] == len(got[1]["text"]) > 200_000


def test_pipeline_stages(spark, tmp_path):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("aeioustrnl") for _ in range(5))
    clean = lambda: ". ".join(" ".join(["the", word(), "and", word(), "with", word()]).capitalize() for _ in range(8)) + "."
    junk = lambda: " ".join(word().upper() + "!!$$" for _ in range(40))
    item = "the quick fox of the north runs over seven lazy dogs while nobody looks at the moon tonight"
    texts = [clean() for _ in range(60)] + [junk() for _ in range(20)]
    texts += [texts[0], texts[1] + " extra", f"{clean()} {item} {clean()}"]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)] + [(500, "1 2 3", "en", "s", 5), (None, clean(), "en", "s", 3)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i < 60), 0) for i in range(80)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    now, kept = frame, []
    for _name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == frame.columns
        kept.append({r["doc_id"] for r in now.select("doc_id").collect()})
    quality, language, near, bench = kept
    assert set(range(60)) <= quality and not quality & set(range(60, 80))
    assert set(range(60)) <= language
    assert 80 not in near and 81 not in near and set(range(60)) <= near and None in near
    assert 82 in near and 82 not in bench and set(range(60)) <= bench
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == bench


def test_pipeline_stages_of_awkward_tables(spark, tmp_path):
    rng = random.Random(19)
    word = lambda: "".join(rng.choice("aeioustrnl") for _ in range(5))
    clean = lambda: ". ".join(" ".join(["the", word(), "and", word(), "with", word()]).capitalize() for _ in range(8)) + "."
    schema = "doc_id long, text string, lang string, source string, n_chars long, words string, component_id long, hash long"
    texts = [clean() for _ in range(12)]
    rows = [(i, t, "en", "s", 1, "w", 7, 8) for i, t in enumerate(texts)]
    rows += [(3, texts[3], "en", "s", 1, "w", 7, 8), (4, texts[5], "en", "s", 1, "w", 7, 8), (None, texts[6], "en", None, None, None, None, None), (None, clean(), None, "s", 1, "w", 7, 8), (50, None, "en", "s", 1, "w", 7, 8), (51, "", "en", "s", 1, "w", 7, 8)]
    rows += [(4, clean(), "en", "s", 1, "w", 7, 8), (60, " ".join([texts[0]] * 1500), "en", "s", 1, "w", 7, 8)]
    frame = spark.createDataFrame(rows, schema)
    near = corpus_pipeline.near_duplicates(spark, frame, str(tmp_path))
    left = sorted(near.select("doc_id", "text").collect(), key=str)
    gone = [(3, texts[3]), (5, texts[5]), (None, texts[6]), (60, rows[-1][1])]  # a repeated row, the later ids of two copies, a text repeated within itself
    expected = [(r[0], r[1]) for r in rows]
    for g in gone:
        expected.remove(g)
    assert near.columns == frame.columns and left == sorted(expected, key=str)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        empty = stage(spark, frame.limit(0), str(tmp_path))
        assert empty.count() == 0
        if name != "packing":
            out = stage(spark, frame, str(tmp_path))
            assert out.columns == frame.columns
            kept = {r["text"] for r in out.select("text").collect()}
            assert kept >= set(texts) and (name == "language ID") == (None not in kept)
