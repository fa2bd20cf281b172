"""Text quality by a factorisation machine.

Inputs: which hashed words occur, statistics of the text's structure, and numeric metadata. The machine
adds pairwise interactions through short factors of each input; a text is scored in time linear
in its inputs, as sum_{i<j} <v_i, v_j> x_i x_j = (|sum_i v_i x_i|^2 - sum_i |v_i|^2 x_i^2) / 2.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

BUCKETS, FACTORS = 1 << 14, 6
#: Labelled rows that training uses, at most in expectation.
SAMPLE = 6_000
EPOCHS, BATCH, RATE, SHRINK = 12, 64, 0.08, 1e-4
PART = 2 << 20

# classes of bytes: letters, capitals, digits, sentence marks, other marks, space, line ends, bytes above ASCII
_CLASS = np.full(256, 4, dtype=np.int64)
_CLASS[[*range(97, 123)]], _CLASS[[*range(65, 91)]], _CLASS[[*range(48, 58)]] = 0, 1, 2
_CLASS[[ord(c) for c in ".,;:?'\"()-"]], _CLASS[[9, 11, 12, 13, 32]], _CLASS[10], _CLASS[128:] = 3, 5, 6, 7
STATISTICS = ("letters", "capitals", "digits", "sentence_marks", "other_marks", "spaces", "line_ends", "above_ascii", "log_bytes", "log_words", "word_bytes", "distinct_words", "short_words", "marked_words", "line_words", "repeated_lines", "empty")


@dataclass
class QualityModel:
    """Means and spreads of the statistics and metadata; bias, weights and factors of these and of words; metadata columns."""

    mean: np.ndarray
    spread: np.ndarray
    bias: float
    weight: np.ndarray
    factor: np.ndarray
    metadata: tuple[str, ...] = ()


def _metadata(rows: pa.RecordBatch, columns: list[str]) -> np.ndarray:
    """For each numeric column the signed logarithm of its value, 0 where it is missing, and whether it is."""
    out = []
    for c in columns:
        v = np.asarray(rows.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False), dtype=np.float64)
        gone = ~np.isfinite(v)
        v = np.where(gone, 0.0, v)
        out += [np.sign(v) * np.log1p(np.abs(v)), gone]
    return np.column_stack(out).astype(np.float64) if out else np.zeros((rows.num_rows, 0))


def _inputs(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Statistics by text; text numbers and buckets of the distinct hashed words of each."""
    texts = pc.fill_null(texts, "")
    n = len(texts)
    size = np.asarray(pc.binary_length(texts), dtype=np.int64)
    raw = np.frombuffer("".join(texts.to_pylist()).encode(), dtype=np.uint8)
    of = np.repeat(np.arange(n), size)
    kinds = np.bincount(of * 8 + _CLASS[raw], minlength=8 * n).reshape(n, 8)
    words = common.Words(texts)
    count = np.diff(words.bounds)
    owner = np.repeat(np.arange(n), count)
    length = np.array([len(w.encode()) for w in words.vocabulary] or [0], dtype=np.int64)
    marked = np.array([not w[-1:].isalnum() and w[-1:] not in ".,;:?'\")" for w in words.vocabulary] or [False])
    lines = pc.split_pattern(texts, "\n")
    edges = np.asarray(lines.offsets, dtype=np.int64)
    coded = lines.values.slice(edges[0], edges[-1] - edges[0]).dictionary_encode()
    line_of = np.repeat(np.arange(n), np.diff(edges))
    line_codes = np.asarray(coded.indices, dtype=np.int64)
    distinct_lines = np.bincount(np.unique(line_of * (len(coded.dictionary) + 1) + line_codes) // (len(coded.dictionary) + 1), minlength=n)
    n_lines = np.diff(edges)
    distinct = np.unique(owner * (len(words.vocabulary) + 1) + words.code)
    distinct_of, distinct_word = distinct // (len(words.vocabulary) + 1), distinct % (len(words.vocabulary) + 1)
    hashed = common.hash_words(words.vocabulary) if words.vocabulary else np.zeros(1, dtype=np.uint64)
    bucket = (hashed >> np.uint64(40)).astype(np.int64) % BUCKETS
    pairs = np.unique(distinct_of * BUCKETS + bucket[distinct_word]) if len(distinct) else distinct
    per = lambda v: np.bincount(owner, weights=v[words.code], minlength=n) / np.maximum(count, 1) if len(words.code) else np.zeros(n)
    share = kinds / np.maximum(size, 1)[:, None]
    statistics = np.column_stack(
        [*share.T, np.log1p(size), np.log1p(count), np.log1p(per(length)), np.bincount(distinct_of, minlength=n) / np.maximum(count, 1), per(length <= 3), per(marked), np.log1p(count / np.maximum(n_lines, 1)), 1 - distinct_lines / n_lines, count == 0]
    )
    return statistics, pairs // BUCKETS, pairs % BUCKETS


def _design(m: QualityModel, texts: pa.Array, metadata: np.ndarray | None = None) -> np.ndarray:
    """Logits of some texts and their metadata under ``m``."""
    statistics, of, bucket = _inputs(texts)
    if metadata is not None:
        statistics = np.column_stack([statistics, metadata])
    n, s = statistics.shape
    x = np.clip((statistics - m.mean) / m.spread, -4, 4)
    each = 1 / np.sqrt(np.maximum(np.bincount(of, minlength=n), 1))
    linear = x @ m.weight[:s] + each * np.bincount(of, weights=m.weight[s + bucket], minlength=n)
    pairwise = np.zeros(n)
    for k in range(m.factor.shape[1]):
        v, u = m.factor[:s, k], m.factor[s + bucket, k]
        total = x @ v + each * np.bincount(of, weights=u, minlength=n)
        squares = (x * x) @ (v * v) + each * each * np.bincount(of, weights=u * u, minlength=n)
        pairwise += (total * total - squares) / 2
    return m.bias + linear + pairwise


def _descend(statistics: np.ndarray, words: list[np.ndarray], label: np.ndarray, seed: int = 5) -> QualityModel:
    """Fits the machine by stochastic gradient descent with a rate for each parameter (AdaGrad)."""
    rng = np.random.default_rng(seed)
    mean, spread = statistics.mean(axis=0), statistics.std(axis=0)
    spread = np.where(spread > 1e-9, spread, 1.0)
    x = np.clip((statistics - mean) / spread, -4, 4)
    n, s = x.shape
    rate = label.mean()
    bias = float(np.log((rate + 1e-3) / (1 - rate + 1e-3)))
    weight, factor = np.zeros(s + BUCKETS), rng.normal(0, 0.02, (s + BUCKETS, FACTORS))
    gw, gv, gb = np.full(s + BUCKETS, 1e-2), np.full((s + BUCKETS, FACTORS), 1e-2), 1e-2
    for _ in range(EPOCHS):
        order = rng.permutation(n)
        for a in range(0, n, BATCH):
            at = order[a : a + BATCH]
            lists = [np.concatenate([np.arange(s), s + words[i].astype(np.int64)]) for i in at]
            values = np.concatenate([np.concatenate([x[i], np.full(len(words[i]), 1 / np.sqrt(max(len(words[i]), 1)))]) for i in at])
            index, edges = np.concatenate(lists), np.cumsum([0] + [len(q) for q in lists])[:-1]
            size = np.array([len(q) for q in lists])
            v = factor[index]
            vx = v * values[:, None]
            total = np.add.reduceat(vx, edges, axis=0)
            squares = np.add.reduceat(vx * vx, edges, axis=0)
            z = bias + np.add.reduceat(weight[index] * values, edges) + 0.5 * (total * total - squares).sum(axis=1)
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - label[at]) / len(at)
            ge = np.repeat(g, size)
            dw = np.bincount(index, weights=ge * values, minlength=len(weight))
            dv = np.zeros_like(factor)
            slope = ge[:, None] * values[:, None] * (np.repeat(total, size, axis=0) - vx)
            np.add.at(dv, index, slope)
            hit = np.unique(index)
            dw[hit] += SHRINK * weight[hit]
            dv[hit] += SHRINK * factor[hit]
            gw[hit] += dw[hit] ** 2
            gv[hit] += dv[hit] ** 2
            gb += g.sum() ** 2
            weight[hit] -= RATE * dw[hit] / np.sqrt(gw[hit])
            factor[hit] -= RATE * 0.5 * dv[hit] / np.sqrt(gv[hit])
            bias -= RATE * g.sum() / np.sqrt(gb)
    return QualityModel(mean, spread, float(bias), weight, factor)


def train(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality", metadata: tuple[str, ...] = ("n_chars",)) -> QualityModel:
    """A model of ``labels`` (id, label 0 or 1), which may be other rows than those scored later.

    The sample: labelled ids by hash, SAMPLE at most in expectation; labels that are null or of
    an unknown id teach nothing; of several labels of one id the larger counts. Without a label every
    score is 0.5. ``metadata``: numeric columns that are inputs too, where ``docs`` has them.
    """
    metadata = tuple(c for c in metadata if c in docs.columns)
    told = labels.select(labels[id_column].cast("long").alias("id"), labels[label_column].cast("int").alias("label")).where("id is not null and label is not null").groupBy("id").agg(F.max("label").alias("label"))
    told = common.written(told, "labels")
    known = told.count()
    told = told.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) <= int(min(1.0, SAMPLE / max(known, 1)) * (1 << 30)))
    rows = docs.select(docs[id_column].cast("long").alias("id"), docs[text_column].cast("string").alias("text"), *[docs[c].cast("double").alias(f"__m{i}") for i, c in enumerate(metadata)])
    names = [f"__m{i}" for i in range(len(metadata))]
    rows = rows.join(F.broadcast(told), "id").select("id", "text", "label", *names)  # bounded by SAMPLE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, "text", PART):
                statistics, of, bucket = _inputs(part.column("text"))
                statistics = np.column_stack([statistics, _metadata(part, names)])
                edges = np.searchsorted(of, np.arange(len(statistics) + 1))
                bucket = bucket.astype("<u2")
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("label"), pa.array([row.tobytes() for row in statistics.astype("<f8")], type=pa.binary()), pa.array([bucket[a:b].tobytes() for a, b in zip(edges, edges[1:], strict=False)], type=pa.binary())],
                    names=["id", "label", "statistics", "words"],
                )

    drawn = rows.mapInArrow(common.lean(run), "id long, label int, statistics binary, words binary").toArrow().combine_chunks()
    s = len(STATISTICS) + 2 * len(metadata)
    if not drawn.num_rows:
        return QualityModel(np.zeros(s), np.ones(s), 0.0, np.zeros(s + BUCKETS), np.zeros((s + BUCKETS, FACTORS)), metadata)
    drawn = drawn.take(pc.sort_indices(drawn, sort_keys=[("id", "ascending"), ("words", "ascending")]))
    statistics = np.frombuffer(b"".join(drawn.column("statistics").to_pylist()), dtype="<f8").reshape(-1, s)
    model = _descend(statistics, [np.frombuffer(w, dtype="<u2") for w in drawn.column("words").to_pylist()], np.asarray(drawn.column("label"), dtype=float))
    model.metadata = metadata
    return model


def score(docs: DataFrame, model: QualityModel, text_column: str = "text") -> DataFrame:
    """``docs`` with quality_score, the probability of label 1.

    The text and the model's metadata columns are inputs (a column that ``docs`` lacks counts as
    missing). A null text counts as empty and is scored like any other; texts of
    any length are scored whole; repeated rows are scored alike; an existing column of that name is
    replaced, all others stay.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop("quality_score")
    text, columns = docs.columns.index(text_column), list(docs.columns)
    names = [f"__m{i}" for i in range(len(model.metadata))]
    given = docs.select("*", *[(docs[c].cast("double") if c in columns else F.lit(None).cast("double")).alias(n) for c, n in zip(model.metadata, names, strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in common.slices(batch, text, PART):
                z = _design(shared.value, rows.column(text), _metadata(rows, names))
                yield pa.RecordBatch.from_arrays([*rows.columns[: len(columns)], pa.array(1 / (1 + np.exp(-np.clip(z, -40, 40))))], names=[*columns, "quality_score"])

    return given.mapInArrow(common.lean(run), common.extended(docs.schema, quality_score="double"))
