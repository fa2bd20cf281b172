"""Exact Jaccard join of documents on distinct word n-grams, with set-relation skipping.

1. One pass turns each text into its set of 64-bit shingle hashes, keeps only size and
   fingerprint, and counts all shingles in a fixed-width sketch. Equal sets form one class.
2. The sketch gives the order of tokens (rare first, then by hash). Any fixed order makes the
   prefix filter exact; the counts only keep common shingles out of the prefixes. A second pass
   emits each set's prefix: index lists with positions.
3. Index lists are cut into blocks by token and size level. Each block's members are compared
   with the block's head alone: a linear number of pairs. Linked members inherit the head's
   component, so a large group of similar sets costs one comparison per member and token.
4. What remains are pairs of different components that share a token. Before any set is read,
   the sets' histograms bound every pair's overlap from above. Blocks by position
   that cannot reach the overlap are skipped; and where both sets have been compared with one pivot,
   their overlap is bounded from the two known ones, |x n y| >= |x n p| + |y n p| - |p| and
   |x n y| <= min(|x n p|, |y n p|) + min(|x - p|, |y - p|), so many pairs are answered without
   reading the sets. The rest is compared exactly.

What a step wrote is deleted when no later step reads it, its shuffle files when it is written.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SKETCH_BITS = 22
CHUNK = 1 << 12
#: Buckets of a set's histogram, which bounds overlaps from above.
BUCKETS = 128
#: Ids up to this count may be broadcast (8 bytes each).
BROADCAST_IDS = 500_000
#: Parts, by token, in which the index lists are gathered: each has 1 / PARTS of their shuffle files on disk.
PARTS = 3


def shingle_sets(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; shorter texts have their whole sequence."""
    words = common.Words(texts)
    hashed = common.hash_words(words.vocabulary)[words.code] if len(words.code) else np.zeros(0, dtype=np.uint64)
    n = len(hashed)
    rolled = common.chain([hashed[k : n - width + 1 + k] for k in range(width)]) if n >= width else None
    bounds = words.bounds.tolist()
    for a, b in zip(bounds, bounds[1:], strict=False):
        if b - a >= width:
            yield np.unique(rolled[a : b - width + 1])
        elif b > a:
            yield common.chain([hashed[k : k + 1] for k in range(a, b)])
        else:
            yield np.zeros(0, dtype=np.uint64)


def _written(df: DataFrame, name: str) -> DataFrame:
    return common.written(df, name, clean=True)


def _narrow(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    return docs.select(docs[id_column].cast("long").alias("doc_id"), docs[text_column].cast("string").alias("text"))


def _profiles(docs: DataFrame, width: int) -> DataFrame:
    """Rows of two kinds: (doc_id, n, print) of each text; (chunk, counts) of the sketch of a task."""
    mask = np.uint64((1 << SKETCH_BITS) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH_BITS, dtype=np.uint32)
        names = ["doc_id", "n", "print", "chunk", "counts"]
        for batch in batches:
            for rows in common.slices(batch, "text", 2 << 20):
                sets = list(shingle_sets(rows.column("text"), width))
                every = np.concatenate(sets) if sets else np.zeros(0, dtype=np.uint64)
                at, often = np.unique(every & mask, return_counts=True)
                counts[at] += often.astype(np.uint32)
                k = len(sets)
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), pa.array([len(s) for s in sets], type=pa.int64()), pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], type=pa.binary()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())],
                    names=names,
                )
        narrow = np.uint8 if counts.max(initial=0) < 256 else np.uint32
        parts = [(i, bytes([narrow().itemsize]) + zlib.compress(c.astype(narrow).tobytes(), 1)) for i in range(len(counts) // CHUNK) if (c := counts[i * CHUNK : (i + 1) * CHUNK]).any()]
        k = len(parts)
        yield pa.RecordBatch.from_arrays([pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary()), pa.array([p[0] for p in parts], type=pa.int32()), pa.array([p[1] for p in parts], type=pa.binary())], names=names)

    return docs.mapInArrow(common.lean(run), "doc_id long, n long, print binary, chunk int, counts binary")


def _levels(sketch: DataFrame) -> np.ndarray:
    """The summed sketch as one byte for each counter, its level rising with the logarithm."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, raw in zip(batch.column("chunk").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                part = np.frombuffer(zlib.decompress(raw[1:]), dtype=np.uint8 if raw[0] == 1 else np.uint32)
                sums[i] = sums[i] + part if i in sums else part.astype(np.uint64)
        for i, c in sums.items():
            level = np.minimum(255, 6 * np.log2(c + 1.0)).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([i], type=pa.int32()), pa.array([level.tobytes()], type=pa.binary())], names=["chunk", "levels"])

    levels = np.zeros(1 << SKETCH_BITS, dtype=np.uint8)
    for row in sketch.repartition(64, "chunk").mapInArrow(common.lean(run), "chunk int, levels binary").collect():  # 4 MB in all
        levels[row["chunk"] * CHUNK : (row["chunk"] + 1) * CHUNK] = np.frombuffer(row["levels"], dtype=np.uint8)
    return levels


def _prefixes(docs: DataFrame, width: int, percent: int, levels: np.ndarray) -> DataFrame:
    """(doc_id, n, prefix, histogram) of each text that has shingles; the prefix in the tokens' order,
    the histogram of its hashes over BUCKETS as bytes (255 and more as 255)."""
    shared = docs.sparkSession.sparkContext.broadcast(levels)
    mask = np.uint64((1 << SKETCH_BITS) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = shared.value
        for batch in batches:
            for rows in common.slices(batch, "text", 2 << 20):
                ids, sizes, prefixes, histograms = [], [], [], []
                for doc_id, s in zip(rows.column("doc_id").to_pylist(), shingle_sets(rows.column("text"), width), strict=True):
                    if n := len(s):
                        k = n - -(-percent * n // 100) + 1
                        order = np.argsort(level[(s & mask).astype(np.int64)], kind="stable")[:k]
                        ids.append(doc_id)
                        sizes.append(n)
                        prefixes.append(s[order].view(np.int64))
                        histograms.append(np.minimum(np.bincount((s >> np.uint64(57)).astype(np.int64), minlength=BUCKETS), 255).astype(np.uint8).tobytes())
                edges = np.concatenate(([0], np.cumsum([len(p) for p in prefixes]))).astype(np.int32)
                flat = np.concatenate(prefixes) if prefixes else np.zeros(0, dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(ids, type=pa.int64()), pa.array(sizes, type=pa.int64()), pa.ListArray.from_arrays(pa.array(edges), pa.array(flat)), pa.array(histograms, type=pa.binary())], names=["doc_id", "n", "prefix", "histogram"])

    return docs.mapInArrow(common.lean(run), "doc_id long, n long, prefix array<long>, histogram binary")


def _sets(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """(id, shingles) of the documents in ``ids`` (id), from their texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in common.slices(batch, "text", 2 << 20):
                sets = [s.view(np.int64) for s in shingle_sets(rows.column("text"), width)]
                edges = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
                flat = np.concatenate(sets) if sets else np.zeros(0, dtype=np.int64)
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.ListArray.from_arrays(pa.array(edges), pa.array(flat))], names=["id", "shingles"])

    ids = common.bounded_broadcast(ids, ids.count(), BROADCAST_IDS)
    return docs.join(ids, docs["doc_id"] == ids["id"], "left_semi").mapInArrow(common.lean(run), "id long, shingles array<long>")


def _needed(percent: int, n: F.Column, m: F.Column) -> F.Column:
    """The least overlap of linked sets of sizes n and m: 100 i >= percent (n + m - i)."""
    return F.ceil((F.lit(percent) * (n + m)) / F.lit(100 + percent)).cast("long")


def _overlaps(docs: DataFrame, pairs: DataFrame, width: int, name: str) -> DataFrame:
    """``pairs`` (a, na, b, nb) with their exact overlap i, written."""
    ids = _written(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct(), f"{name}-ids")
    sets = _written(_sets(docs, ids, width), f"{name}-sets")
    left = pairs.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb")), "b")
    both = left.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), "a")
    # one row a pair, also where rows share a doc_id
    told = both.select("a", "na", "b", "nb", F.size(F.array_intersect("sa", "sb")).cast("long").alias("i")).groupBy("a", "na", "b", "nb").agg(F.max("i").alias("i"))
    told = _written(told, f"{name}-answers")
    common.dropped(ids, sets)
    return told


def _possible(pairs: DataFrame, histograms: DataFrame, percent: int) -> DataFrame:
    """``pairs`` whose histograms leave room for a link: an overlap is at most the sum of the lesser counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ha, hb = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint8).reshape(-1, BUCKETS) for c in ("ha", "hb"))
            na, nb = (np.asarray(batch.column(c)) for c in ("na", "nb"))
            full = ((ha == 255) | (hb == 255)).any(axis=1)  # a count that did not fit bounds nothing
            most = np.minimum(ha, hb).sum(axis=1, dtype=np.int64)
            keep = full | ((100 + percent) * most >= percent * (na + nb))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("a", "na", "b", "nb")], names=["a", "na", "b", "nb"]).filter(pa.array(keep))

    of = lambda side: histograms.select(F.col("doc_id").alias(side), F.col("histogram").alias(f"h{side}"))
    told = pairs.join(of("a"), "a").join(of("b"), "b").select("a", "na", "b", "nb", "ha", "hb")
    return told.mapInArrow(common.lean(run), "a long, na long, b long, nb long").distinct()


def jaccard_links(docs: DataFrame, width: int = 3, percent: int = 90, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs``.

    Two documents link when 100 * |x n y| >= percent * |x u y| over their distinct ``width``-word
    shingles (ASCII letters lower-cased, words cut at ``[\\x20\\x09-\\x0D]+``; a text with fewer
    words is one shingle). component_id: the smallest doc_id reachable by links, itself included.

    Cases: null texts and texts without words are empty sets, linked with nothing, not even with
    each other; equal texts link; rows that share a doc_id count as one document whose set is that of one
    of them, and each row is returned; a null doc_id has its size and no component; a document of
    any length is one set; other columns are not read; an empty table gives no rows. Shingles are
    compared by 64-bit hashes, class fingerprints by 128 bits.
    """
    docs = _narrow(docs, id_column, text_column)
    profiles = _written(_profiles(docs, width), "profiles")
    levels = _levels(profiles.where("chunk is not null").select("chunk", "counts"))
    sizes = profiles.where("chunk is null").select("doc_id", "n", "print")

    # equal sets are one class, named by its smallest doc_id
    classes = sizes.where("n > 0 and doc_id is not null").groupBy("print").agg(F.min("doc_id").alias("rep"))
    classes = _written(classes, "classes")
    prefixes = _prefixes(docs.where("doc_id is not null"), width, percent, levels).join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
    prefixes = _written(prefixes, "prefixes")
    histograms = _written(prefixes.select("doc_id", "histogram"), "histograms")
    step = math.log(100 / percent)
    # a posting travels as id, token, and size and position in one number
    postings = prefixes.select(F.col("doc_id").alias("id"), "n", F.posexplode("prefix").alias("pos", "token")).select("id", "token", (F.shiftleft("n", 32) + F.col("pos")).alias("place"))

    # lists of one entry link nothing; each block's head is the member whose token stands first
    parts = []
    for k in range(PARTS):
        some = postings.where(F.pmod("token", F.lit(PARTS)) == k)
        lists = _written(some.groupBy("token").agg(F.count("*").alias("entries")).where("entries > 1").select("token"), "lists")
        some = some.join(lists, "token").withColumns({"n": F.shiftright("place", 32), "pos": (F.col("place") % F.lit(1 << 32)).cast("int")}).drop("place")
        parts.append(_written(some.withColumn("level", F.floor(F.log("n") / step + 1e-9).cast("int")), "shared"))
        common.dropped(lists)
    shared = reduce(DataFrame.unionByName, parts)
    common.dropped(prefixes)
    blocks = shared.groupBy("token", "level").agg(F.count("*").alias("entries"), F.min(F.struct("pos", "id", "n")).alias("head")).where("entries > 1").select("token", "level", "head")
    near = shared.join(blocks, ["token", "level"]).where("id <> head.id")
    near = near.where(F.least(F.col("n") - F.col("pos"), F.col("head.n") - F.col("head.pos")) >= _needed(percent, F.col("n"), F.col("head.n")))
    near = near.select(F.col("head.id").alias("a"), F.col("head.n").alias("na"), F.col("id").alias("b"), F.col("n").alias("nb")).distinct()
    near = _written(_possible(near, histograms, percent), "near")
    answers = _overlaps(docs, near, width, "near")
    common.dropped(near)
    linked = F.col("i") >= _needed(percent, F.col("na"), F.col("nb"))
    links = answers.where(linked).select("a", "b")
    parts = _written(common.connected_components(links), "parts")

    # what is left: members of other components in the same list
    placed = shared.join(parts, "id", "left").withColumn("component", F.coalesce("component", "id"))
    placed = _written(placed, "placed")
    common.dropped(shared, parts)
    split = placed.groupBy("token").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least <> most")
    counted = placed.join(split.select("token"), "token", "left_semi").groupBy("token", "component").agg(F.count("*").alias("entries"))
    main = _written(counted.groupBy("token").agg(F.max_by("component", F.struct("entries", "component")).alias("main")), "main")
    mixed = placed.join(main, "token")
    reach = lambda n, level: n - _needed(percent, n, F.exp((level + 1) * F.lit(step)))  # noqa: E731  the last position that can do, for sizes up to a level's largest
    probes = mixed.where("component <> main").select("token", F.col("id").alias("x"), F.col("n").alias("nx"), F.col("pos").alias("px"), F.col("component").alias("cx"), "main", F.explode(F.array(F.col("level") - 1, F.col("level"), F.col("level") + 1)).alias("level"))
    # the smallest partner of a level asks for the least; a probe that stands too deep for it skips the block
    probes = probes.where(F.col("px") <= F.col("nx") - _needed(percent, F.col("nx"), F.floor(F.exp(F.col("level") * F.lit(step)))))
    partners = mixed.select("token", "level", F.col("id").alias("y"), F.col("n").alias("ny"), F.col("pos").alias("py"), F.col("component").alias("cy"))
    partners = partners.where(F.col("py") <= reach(F.col("ny"), F.lit(0) + F.col("level") - 2) + 1)
    far = probes.join(partners, ["token", "level"]).where("cx <> cy and (cy = main or x < y)")
    far = far.where(F.least(F.col("nx") - F.col("px"), F.col("ny") - F.col("py")) >= _needed(percent, F.col("nx"), F.col("ny")))
    far = far.select(F.least("x", "y").alias("a"), F.when(F.col("x") < F.col("y"), F.col("nx")).otherwise(F.col("ny")).alias("na"), F.greatest("x", "y").alias("b"), F.when(F.col("x") < F.col("y"), F.col("ny")).otherwise(F.col("nx")).alias("nb")).distinct()

    # answers that follow from those of a common pivot
    known = answers.select(F.col("b").alias("id"), F.struct("i", F.col("a").alias("p"), F.col("na").alias("np")).alias("best"))
    known = known.unionByName(answers.select(F.col("a").alias("id"), F.struct(F.col("na").alias("i"), F.col("a").alias("p"), F.col("na").alias("np")).alias("best")))
    pivots = _written(known.groupBy("id").agg(F.max("best").alias("best")).select("id", "best.*"), "pivots")
    of = lambda side: pivots.select(F.col("id").alias(side), F.col("i").alias(f"i{side}"), F.col("p").alias(f"p{side}"), F.col("np").alias(f"np{side}"))
    far = _possible(far, histograms, percent)
    far = far.join(of("a"), "a", "left").join(of("b"), "b", "left")
    same = F.coalesce(F.col("pa") == F.col("pb"), F.lit(False))
    need = _needed(percent, F.col("na"), F.col("nb"))
    least = F.when(same, F.col("ia") + F.col("ib") - F.col("npa")).otherwise(0)
    most = F.when(same, F.least("ia", "ib") + F.least(F.col("na") - F.col("ia"), F.col("nb") - F.col("ib"))).otherwise(F.least("na", "nb"))
    far = _written(far.where(most >= need).select("a", "na", "b", "nb", (least >= need).alias("sure")), "far")
    common.dropped(histograms, placed, main, pivots)
    told = _overlaps(docs, far.where("not sure").drop("sure"), width, "far")
    links = links.unionByName(far.where("sure").select("a", "b")).unionByName(told.where(linked).select("a", "b"))
    merged = _written(common.connected_components(links), "components")
    common.dropped(answers, far, told)

    named = classes.join(merged, F.col("rep") == F.col("id"), "left").select("print", F.coalesce("component", "rep").alias("component"))
    named = named.withColumn("print", F.col("print"))
    full = sizes.join(named, "print", "left")
    alone = F.when(F.col("doc_id").isNull(), F.lit(None).cast("long")).when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component"))
    return full.select("doc_id", F.col("n").alias("n_shingles"), alone.alias("component_id"))
