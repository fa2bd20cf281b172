"""A bigram language model in a log-frequency Bloom filter.

Counts are quantised on a logarithmic scale, q(c) = 1 + floor(log_b c), and a bigram enters the
filter q(c) times, as (bigram, 1) ... (bigram, q). A worker asks for (bigram, 1), (bigram, 2) and
on until a miss: the last hit is the count's level. Probabilities are smoothed by absolute discounting:
p(w | v) = (c(v, w) - d) / c(v) + d T(v) / c(v) p(w), p(w) = (c(w) + 0.1) / (N + 0.1 (V + 1)),
where T(v) is the number of distinct bigrams that begin with v; c(v), c(w) and T(v) are exact. The whole
is divided by 1 + f V (1 - d) / c(v), f being the share of absent bigrams that seem present, so that p sums
to 1 over the vocabulary: those that the filter takes for present, and those whose hash is a present one's.
Bigrams have hashes of 5 to 8 bytes, as many as keep the latter to a fraction of one a context.

No n-gram is cut. Words and the filter are dealt by hash into shards of about one size, as many as
the corpus needs, and a task holds one of them at a time. Texts are scored in batches: a batch's
distinct words and bigrams are asked of their shards, and the answers come back to the batch. What
travels is packed, one row for each batch and shard; the batches are scored in a few parts, one after
the other, so that what a part sent is gone from the disk before the next.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Quantisation base, discount, least weight of the prior after a known word, hash functions, bits for each entry aimed at.
BASE, DISCOUNT, FLOOR, PROBES, BITS = 1.5, 0.5, 0.02, 12, 24
#: Bits of a shard of the filter (1 MB), as a power of two; bytes of text for each shard of words.
SHARD_BITS, WORDS_BYTES = 23, 64 << 20
#: Least bytes of a bigram's hash, and how many absent bigrams of a context may share a present one's.
LEAST_WIDTH, SHARED = 5, 0.25
#: Stands before and after a text; no word holds a space.
EDGE = np.uint64(xxhash.xxh3_64_intdigest(" edge"))
#: Tokens that are counted together, slices of text in a batch: the more they are, the less is sent twice.
GATHER, BATCH = 3_000_000, 4
#: Bytes of a batch's texts that are scored at once; a longer text stands alone.
SCORED_BYTES = 1 << 20
#: Parts in which the batches are scored: each sends the model once, and 1 / PARTS of the questions and answers.
PARTS = 3


def _coded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct hashes in order; an edge, the words and an edge of each text as places in them; each text's first."""
    words = common.Words(texts)
    distinct, place = np.unique(np.append(common.hash_words(words.vocabulary), EDGE), return_inverse=True)
    starts = np.concatenate(([0], np.cumsum(np.diff(words.bounds) + 2)))
    code = np.full(int(starts[-1]), place[-1], dtype=np.int64)
    inner = np.ones(len(code), dtype=bool)
    inner[starts[:-1]] = inner[starts[1:] - 1] = False
    code[inner] = place[words.code]
    return distinct, code, starts


def _tokens(starts: np.ndarray) -> np.ndarray:
    """The places of the tokens: words and final edges."""
    token = np.ones(int(starts[-1]), dtype=bool)
    token[starts[:-1]] = False
    return np.flatnonzero(token)


@dataclass
class _Batch:
    """A batch's distinct hashes of words (with the edge) and of bigrams in order, and its slices: the places of a
    slice's words and edges among the former, its texts' first places, and its bigrams' places among the latter.
    """

    one: np.ndarray
    two: np.ndarray
    slices: list[tuple[np.ndarray, np.ndarray, np.ndarray | None]]


def _batch(rows: pa.Table, width: int, places: bool) -> _Batch:
    """The batch ``rows``, a slice at a time, so that few arrays hold all of its tokens; those of bigrams only for ``places``."""
    found, pairs = [], []
    for batch in rows.select(["text"]).to_batches():
        for part in common.slices(batch, "text", SCORED_BYTES):
            distinct, code, starts = _coded(part.column("text"))
            pairs.append(_pair(distinct[code], _tokens(starts), width))
            found.append((distinct, code.astype(np.int32), starts) if places else (distinct, None, None))
    one = np.unique(np.concatenate([f[0] for f in found])) if found else np.zeros(0, dtype=np.uint64)
    ends = np.cumsum([len(p) for p in pairs])
    h = np.concatenate(pairs) if pairs else np.zeros(0, dtype=np.uint64)
    del pairs
    if not places:
        h.sort()
        return _Batch(one, h[_new(h)], [])
    order = np.argsort(h)
    h = h[order]
    new = _new(h)
    two = h[new]
    del h
    pair = np.empty(len(order), dtype=np.int32)
    pair[order] = np.cumsum(new, dtype=np.int32) - 1
    del order, new
    return _Batch(one, two, [(np.searchsorted(one, distinct).astype(np.int32)[code], starts, of) for (distinct, code, starts), of in zip(found, np.split(pair, ends[:-1]), strict=True)])


def _width(types: int, tokens: int) -> int:
    """Bytes of a bigram's hash: each of a context's ``types`` absent bigrams meets one of at most ``tokens`` hashes by chance."""
    return next((w for w in range(LEAST_WIDTH, 8) if types * tokens <= SHARED * 2.0 ** (8 * w)), 8)


def _high(width: int) -> np.uint64:
    """Selects the upper ``width`` bytes."""
    return np.uint64((1 << 64) - (1 << (64 - 8 * width)))


def _pair(hashed: np.ndarray, at: np.ndarray, width: int = LEAST_WIDTH) -> np.ndarray:
    """Hashes of the tokens ``at`` with their predecessors, in the upper ``width`` bytes."""
    return common.chain([hashed[at - 1], hashed[at]]) & _high(width) if len(at) else hashed[:0]


def _packed(h: np.ndarray, width: int) -> bytes:
    """The upper ``width`` bytes of each."""
    return np.ascontiguousarray(np.ascontiguousarray(h).view(np.uint8).reshape(-1, 8)[:, 8 - width :]).tobytes()


def _unpacked(raw: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(raw) // width, 8), dtype=np.uint8)
    out[:, 8 - width :] = np.frombuffer(raw, dtype=np.uint8).reshape(-1, width)
    return out.view(np.uint64).ravel()


def _shards_of(h: np.ndarray, shards: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """An order of ``h`` by shard, and (shard, first place, end) of those that occur.

    A shard is a range of hashes, told by their upper half: hashes in order are in order of shards too.
    """
    shard = _shard(h, shards)
    if (shard[1:] >= shard[:-1]).all():
        order = np.arange(len(h))
    else:  # numpy sorts 16 bits by radix
        order = np.argsort(shard.astype(np.uint16) if shards <= 1 << 16 else shard, kind="stable")
        shard = shard[order]
    return order, _places(shard)


def _shard(h: np.ndarray, shards: int) -> np.ndarray:
    shard = h >> np.uint64(32)
    shard *= np.uint64(shards)
    shard >>= np.uint64(32)
    return shard


def _places(shard: np.ndarray) -> list[tuple[int, int, int]]:
    """(value, first place, end) of each value of an ordered ``shard``."""
    first = np.flatnonzero(_new(shard))
    edges = [*first.tolist(), len(shard)]
    return list(zip(shard[first].tolist(), edges, edges[1:], strict=False))


def _new(v: np.ndarray) -> np.ndarray:
    """Where an ordered ``v`` has a value for the first time."""
    return np.concatenate((np.ones(min(len(v), 1), dtype=bool), v[1:] != v[:-1]))


def _joined(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    """The packed values of all rows."""
    return np.frombuffer(b"".join(column.drop_null().to_pylist()), dtype=kind)


def _summed(h: np.ndarray, c: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct ``h`` in order, the sums of ``c`` (None: ones), and a place of each."""
    if not len(h):
        return h, np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    order = np.argsort(h)
    h = h[order]
    first = np.flatnonzero(_new(h))
    total = np.diff(first, append=len(h)) if c is None else np.add.reduceat(c[order].astype(np.int64), first)
    return h[first], total, order[first]


def _runs(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of an ordered ``v``, each once, and how often each stands there."""
    first = np.flatnonzero(_new(v))
    return v[first], np.diff(np.append(first, len(v))).astype(np.uint32)


def _partial(docs: DataFrame, pairs: bool, shards: int, width: int = 8) -> DataFrame:
    """(shard, h, v, n, c): packed counts of bigrams (``pairs``) or tokens, of some texts each.

    Bigrams stand by their first token: v names each of these once, n says how many bigrams it has.
    """

    def keys(distinct: np.ndarray, code: np.ndarray, at: np.ndarray) -> tuple:
        if not pairs:
            c = np.bincount(code[at], minlength=len(distinct))
            return distinct[c > 0], None, c[c > 0]
        hashed = distinct[code]
        return _pair(hashed, at, width), hashed[at - 1], None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h, v, c in _gathered(batches, keys):
            if pairs:
                by = np.argsort(v)
                h, v, c = h[by], v[by], c[by]
            order, places = _shards_of(h, shards)
            packed = {"h": [], "v": [], "n": [], "c": []}
            for _, a, b in places:
                i = order[a:b]
                packed["h"].append(_packed(h[i], width) if pairs else h[i].tobytes())
                packed["c"].append(c[i].astype(np.uint32).tobytes())
                first, n = _runs(v[i]) if pairs else (None, None)
                packed["v"].append(_packed(first, width) if pairs else None)
                packed["n"].append(n.tobytes() if pairs else None)
            columns = [pa.array([s for s, _, _ in places], type=pa.int32()), *[pa.array(x, type=pa.binary()) for x in packed.values()]]
            yield pa.RecordBatch.from_arrays(columns, names=["shard", *packed])

    return docs.mapInArrow(common.lean(run), "shard int, h binary, v binary, n binary, c binary")


def _gathered(batches: Iterator[pa.RecordBatch], keys) -> Iterator[tuple]:
    """Distinct keys with companions and counts, of about GATHER tokens at a time."""
    parts, held = [], 0

    def summed() -> tuple:
        h, v, c = (None if x[0] is None else np.concatenate(x) for x in zip(*parts, strict=True))
        h, c, at = _summed(h, c)
        return h, None if v is None else v[at], c

    for batch in batches:
        for part in common.slices(batch, "text"):
            distinct, code, starts = _coded(part.column("text"))
            at = _tokens(starts)
            parts.append(keys(distinct, code, at))
            held += len(at)
            if held >= GATHER:
                yield summed()
                parts, held = [], 0
    if held:
        yield summed()


def _level(c: np.ndarray) -> np.ndarray:
    """q(c) of counts of at least 1."""
    return 1 + np.floor(np.log(c) / np.log(BASE) + 1e-9).astype(np.int64)


def _value(q: np.ndarray) -> np.ndarray:
    """The count that level q stands for: the mean of its range where a count's weight falls with its
    square, as counts of words do; 0 for none."""
    low = np.ceil(BASE ** (q - 1.0) - 1e-9)
    high = np.maximum(np.ceil(BASE**q - 1e-9) - 1, low)
    below, above = low - 0.5, high + 0.5
    mean = np.log(above / below) / (1 / below - 1 / above)
    return np.where(q > 0, np.where(high > low, mean, low), 0.0)


def _key(h: np.ndarray, j: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the probes of entry (bigram, j) begin, and how far they lie apart."""
    key = common.mix(h + np.uint64(((2 << 32) + j) * 0x9E3779B97F4A7C15 & (2**64 - 1)))
    return key, (key >> np.uint64(32)) | np.uint64(1)


def _bit(first: np.ndarray, step: np.ndarray, i: int) -> np.ndarray:
    return ((first + np.uint64(i) * step) & np.uint64((1 << SHARD_BITS) - 1)).astype(np.int64)


def _filled(h: np.ndarray, c: np.ndarray) -> bytes:
    """A shard of the filter with the bigrams ``h``."""
    bits, level, j = np.zeros(1 << SHARD_BITS, dtype=bool), _level(c), 1
    while len(h):
        first, step = _key(h, j)
        for i in range(PROBES):
            bits[_bit(first, step, i)] = True
        j += 1
        h, level = h[level >= j], level[level >= j]
    return np.packbits(bits, bitorder="little").tobytes()


def _levels(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Levels of the bigrams ``h`` by probing a shard until a miss."""
    level, live, j = np.zeros(len(h), dtype=np.uint8), np.arange(len(h)), 1
    while len(live):
        first, step = _key(h[live], j)
        for i in range(PROBES):  # most that are absent are gone after a probe or two
            bit = _bit(first, step, i)
            hit = (bits[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1
            live, first, step = live[hit], first[hit], step[hit]
        level[live] = j
        j += 1
    return level


@dataclass
class Model:
    """What training leaves: N, V, the shards of the words (kind 1) and of the filter (kind 2) with their numbers,
    the share of absent bigrams that seem present, and the bytes of a bigram's hash."""

    tokens: int
    types: int
    words: int
    filters: int
    shards: DataFrame
    false: float
    width: int = LEAST_WIDTH


def _probability(level: np.ndarray, now: np.ndarray, before: np.ndarray, after: np.ndarray, prior: np.ndarray, types: int, false: float) -> np.ndarray:
    """p(w | v) of bigrams: the filter's levels, c(w), c(v), T(v) and p(w).

    The edge as a context was seen once a text, as it was as a token. An unknown v leaves p(w).
    """
    context = np.maximum(before, 1)
    seen = np.maximum(np.minimum(_value(level), np.minimum(now, before)) - DISCOUNT, 0)
    rest = np.where(before > 0, np.clip(DISCOUNT * after / context, FLOOR, 1.0), 1.0)
    # what absent bigrams that seem present once add up to over all words
    whole = np.where(before > 0, 1 + false * types * (1 - DISCOUNT) / context, 1.0)
    return (seen / context + rest * prior) / whole


def _bytes(texts: DataFrame) -> int:
    return texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def train(docs: DataFrame, text_column: str = "text") -> Model:
    """Counts all of ``docs`` and builds the model; a null text is an empty one."""
    texts = docs.select(docs[text_column].cast("string").alias("text"))
    words = -(-_bytes(texts) // WORDS_BYTES) or 1

    def count(rows: pa.Table) -> pa.Table:
        h, c, _ = _summed(_joined(rows.column("h"), np.uint64), _joined(rows.column("c"), np.uint32))
        return pa.table({"shard": rows.column("shard")[:1].cast(pa.int32()), "h": pa.array([h.tobytes()], type=pa.binary()), "c": pa.array([c.tobytes()], type=pa.binary()), "types": pa.array([len(h)]), "tokens": pa.array([int(c.sum())])})

    one = common.written(_partial(texts, False, words).groupBy("shard").applyInArrow(common.lean_group(count), "shard int, h binary, c binary, types long, tokens long"), "unigrams", clean=True)
    sums = one.agg(F.sum("tokens"), F.sum("types")).first()
    tokens, types = sums[0] or 0, sums[1] or 0
    # q(c) <= c, so a bigram's entries are no more than its tokens
    filters = -(-tokens * BITS // (1 << SHARD_BITS)) or 1
    width = _width(types, tokens)

    def fill(rows: pa.Table) -> pa.Table:
        v = np.repeat(_unpacked(b"".join(rows.column("v").to_pylist()), width), _joined(rows.column("n"), np.uint32))
        h, c, first = _summed(_unpacked(b"".join(rows.column("h").to_pylist()), width), _joined(rows.column("c"), np.uint32))
        distinct = len(h)
        v, t, _ = _summed(v[first], np.ones(distinct, dtype=np.int64))
        order, places = _shards_of(v, words)
        pack = lambda x, f=np.ndarray.tobytes: [None, *[f(x[order[a:b]]) for _, a, b in places]]
        n, bits = len(places), _filled(h, c)
        return pa.table(
            {
                "kind": pa.array([2] + [1] * n, type=pa.int32()),
                "shard": pa.array([rows.column("shard")[0].as_py(), *[s for s, _, _ in places]], type=pa.int32()),
                "bits": pa.array([bits, *[None] * n], type=pa.binary()),
                "fill": pa.array([int(np.unpackbits(np.frombuffer(bits, dtype=np.uint8)).sum()) / (1 << SHARD_BITS), *[None] * n], type=pa.float64()),
                "distinct": pa.array([distinct, *[None] * n], type=pa.int64()),
                "h": pa.array(pack(v, lambda x: _packed(x, width)), type=pa.binary()),
                "t": pa.array(pack(t.astype(np.uint32)), type=pa.binary()),
            }
        )

    two = common.written(_partial(texts, True, filters, width).groupBy("shard").applyInArrow(common.lean_group(fill), "kind int, shard int, bits binary, fill double, distinct long, h binary, t binary"), "bigrams", clean=True)
    # how often a bigram that is not there seems to be: the fill of the shards to the power of the probes, and
    # the hashes that are there among all
    told = two.where("kind = 2").agg(F.sum(F.pow("fill", F.lit(float(PROBES)))), F.sum("distinct")).first()
    false = (told[0] or 0.0) / filters + (told[1] or 0) / 2.0 ** (8 * width)

    def follow(of: pa.Table, after: pa.Table) -> pa.Table:
        h, c = _joined(of.column("h"), np.uint64), _joined(of.column("c"), np.int64)
        v, types_after, _ = _summed(_unpacked(b"".join(after.column("h").to_pylist()), width), _joined(after.column("t"), np.uint32))
        t = np.zeros(len(h), dtype=np.int64)
        t[np.searchsorted(h & _high(width), v)] = types_after  # what precedes a token is one; the words are in order, by their upper bytes too
        return pa.table({"kind": pa.array([1], type=pa.int32()), "shard": of.column("shard")[:1].cast(pa.int32()), "x": pa.array([h.tobytes()], type=pa.binary()), "y": pa.array([c.tobytes()], type=pa.binary()), "z": pa.array([t.tobytes()], type=pa.binary())})

    ones = one.select("shard", "h", "c").groupBy("shard").cogroup(two.where("kind = 1").select("shard", "h", "t").groupBy("shard")).applyInArrow(common.lean_cogroup(follow), "kind int, shard int, x binary, y binary, z binary")
    none = F.lit(None).cast("binary")
    shards = common.written(ones, "model", clean=True).unionByName(two.where("kind = 2").select("kind", "shard", F.col("bits").alias("x"), none.alias("y"), none.alias("z")))
    return Model(tokens, types, words, filters, shards, false, width)


def score(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score) of every row of ``docs``.

    Tokens: the words (ASCII letters lower-cased, cut at ``[\\x20\\x09-\\x0D]+``) and one end. n_known:
    those that training saw. base_score: the exact smoothed unigram log10 probability; score: the
    model's. Cases: a null or empty text is the end alone; repeated rows are scored each; a null
    doc_id is carried; an empty training set leaves N = V = 0 and all tokens unknown; other columns
    are not read. ``docs`` is read a few times; a batch holds all rows that share id and text. Where there
    are several batches they are scored, in PARTS parts, before this returns.
    """
    tokens, types, words, filters, model_false, width = model.tokens, model.types, model.words, model.filters, model.false, model.width
    total = tokens + 0.1 * (types + 1)
    narrow = docs.select(docs[id_column].cast("long").alias("doc_id"), docs[text_column].cast("string").alias("text"))
    batches = -(-_bytes(narrow) // (BATCH * common.SLICE_BYTES)) or 1
    narrow = narrow.withColumn("batch", F.pmod(F.xxhash64("doc_id", "text"), F.lit(batches)))

    def ask(rows: pa.Table) -> pa.Table:
        batch = _batch(rows, width, False)
        kinds, shards, packed = [], [], []
        for kind, h, n in ((1, batch.one, words), (2, batch.two, filters)):
            for s, a, b in _places(_shard(h, n)):
                kinds.append(kind), shards.append(s), packed.append(h[a:b].tobytes() if kind == 1 else _packed(h[a:b], width))
        return pa.table({"kind": pa.array(kinds, type=pa.int32()), "shard": pa.array(shards, type=pa.int32()), "batch": pa.array([rows.column("batch")[0].as_py()] * len(kinds), type=pa.int64()), "h": pa.array(packed, type=pa.binary())})

    def answer(shard: pa.Table, asked: pa.Table) -> pa.Table:
        c, t = [], []
        kind = asked.column("kind")[0].as_py() if asked.num_rows else 0
        known = [_joined(shard.column(x), np.uint8) for x in ("x", "y", "z")]
        for raw in asked.column("h").to_pylist():
            h = np.frombuffer(raw, dtype=np.uint64) if kind == 1 else _unpacked(raw, width)
            if kind == 2:
                c.append((_levels(known[0], h) if len(known[0]) else np.zeros(len(h), dtype=np.uint8)).tobytes()), t.append(None)
                continue
            have = known[0].view(np.uint64)
            place = np.minimum(np.searchsorted(have, h), max(len(have) - 1, 0))
            for out, values in ((c, known[1]), (t, known[2])):
                out.append((np.where(have[place] == h, values.view(np.int64)[place], 0) if len(have) else np.zeros(len(h), dtype=np.int64)).tobytes())
        return pa.table({"batch": asked.column("batch"), "kind": asked.column("kind"), "shard": asked.column("shard"), "c": pa.array(c, type=pa.binary()), "t": pa.array(t, type=pa.binary())})

    def told(rows: pa.Table, answers: pa.Table) -> pa.Table:
        batch = _batch(rows, width, True)
        of_one, of_two = ({s: slice(a, b) for s, a, b in _places(_shard(h, n))} for h, n in ((batch.one, words), (batch.two, filters)))
        c, t, level = np.zeros(len(batch.one), dtype=np.int64), np.zeros(len(batch.one), dtype=np.int64), np.zeros(len(batch.two), dtype=np.uint8)
        for r in answers.to_pylist():
            if r["kind"] == 2:
                level[of_two[r["shard"]]] = np.frombuffer(r["c"], dtype=np.uint8)
            else:
                c[of_one[r["shard"]]] = np.frombuffer(r["c"], dtype=np.int64)
                t[of_one[r["shard"]]] = np.frombuffer(r["t"], dtype=np.int64)
        prior = (c + 0.1) / total
        columns = []
        for code, starts, pair in batch.slices:
            n, size, at = len(starts) - 1, np.diff(starts) - 1, _tokens(starts)
            owner = np.repeat(np.arange(n), size)
            now, before = code[at], code[at - 1]
            p = _probability(level[pair].astype(np.int64), c[now], c[before], t[before], prior[now], types, model_false)
            by = lambda v: np.bincount(owner, weights=v, minlength=n)  # noqa: B023, E731
            columns.append((size, by(c[now] > 0).astype(np.int64), by(np.log10(prior[now])), by(np.log10(np.minimum(p, 1.0)))))
        size, known, base, whole = (np.concatenate(x) for x in zip(*columns, strict=True)) if columns else [np.zeros(0)] * 4
        return pa.table({"doc_id": rows.column("doc_id"), "n_tokens": pa.array(size.astype(np.int64)), "n_known": pa.array(known.astype(np.int64)), "base_score": pa.array(base), "score": pa.array(whole)})

    def scored(part: DataFrame) -> DataFrame:
        asked = part.groupBy("batch").applyInArrow(common.lean_group(ask), "kind int, shard int, batch long, h binary")
        answers = model.shards.groupBy("kind", "shard").cogroup(asked.groupBy("kind", "shard")).applyInArrow(common.lean_cogroup(answer), "batch long, kind int, shard int, c binary, t binary")
        return part.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(common.lean_cogroup(told), "doc_id long, n_tokens long, n_known long, base_score double, score double")

    parts = min(PARTS, batches)
    if parts == 1:
        return scored(narrow)
    done = [common.written(scored(narrow.where(F.pmod("batch", F.lit(parts)) == k)), "scores", clean=True) for k in range(parts)]
    return reduce(DataFrame.unionByName, done)
