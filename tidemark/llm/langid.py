"""Language identification: averaged hashed subword embeddings with a linear softmax.

A text is the mean of the embeddings of its hashed byte n-grams (3 and 4 bytes of the lower-cased
text); the softmax over that mean is trained by stochastic gradient descent in numpy on a bounded
sample. As mean and softmax weights are both linear, a worker scores a text with the product of
the two tables: one small row of logits for each n-gram, whole texts, no n-gram left out.
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

BUCKETS, WIDTHS, DIMENSIONS = 1 << 15, (3, 4), 16
#: Labelled texts that training uses, at most in expectation: of each language, and in all.
PER_LANGUAGE, IN_ALL = 600, 24_000
EPOCHS, BATCH, RATE = 8, 32, 0.5
#: Share of right answers on validation texts that calibrated rejection may give up; least confidence ever asked for.
GIVEN_UP, ASKED = 0.001, 0.5
PART = 1 << 20


@dataclass
class LanguageModel:
    """Languages, a row of logits for each bucket, biases, the temperature and the confidence asked for."""

    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    reject_below: float


def _grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of some texts, one row a width, BUCKETS where none begins; texts' edges in bytes."""
    lower = pc.utf8_lower(pc.fill_null(texts, ""))
    size = np.asarray(pc.binary_length(lower), dtype=np.int64)
    edges = np.concatenate(([0], np.cumsum(size)))
    raw = np.frombuffer("".join(lower.to_pylist()).encode(), dtype=np.uint8).astype(np.uint32)
    left = np.repeat(edges[1:], size) - np.arange(len(raw))  # bytes from here to the text's end
    out = np.full((len(WIDTHS), len(raw)), BUCKETS, dtype=np.int32)
    for k, width in enumerate(WIDTHS):
        if len(raw) < width:
            continue
        h = np.full(len(raw) - width + 1, width, dtype=np.uint32)
        for i in range(width):
            h = h * np.uint32(0x01000193) ^ raw[i : len(raw) - width + 1 + i]
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B)
        out[k, : len(h)] = np.where(left[: len(h)] >= width, h >> np.uint32(32 - 15), BUCKETS)
    return out, edges


def _by_text(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Sums of the rows of ``values`` by text; an empty text has zeros."""
    out = np.zeros((len(edges) - 1, *values.shape[1:]), dtype=np.float64)
    full = np.flatnonzero(np.diff(edges) > 0)
    if len(full):
        out[full] = np.add.reduceat(values, edges[full], axis=0)
    return out


def _features(texts: DataFrame) -> DataFrame:
    """(lang, key, buckets, shares) of labelled texts that have n-grams: 16-bit buckets and 32-bit shares as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in common.slices(batch, "text", PART):
                grams, edges = _grams(rows.column("text"))
                langs, keys, buckets, shares = [], [], [], []
                for lang, key, a, b in zip(rows.column("lang").to_pylist(), rows.column("key").to_pylist(), edges, edges[1:], strict=False):
                    c = np.bincount(grams[:, a:b].reshape(-1), minlength=BUCKETS + 1)[:BUCKETS]
                    at = np.flatnonzero(c)
                    if len(at):
                        langs.append(lang), keys.append(key), buckets.append(at.astype("<u2").tobytes()), shares.append((c[at] / c[at].sum()).astype("<f4").tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(langs, type=pa.string()), pa.array(keys, type=pa.int64()), pa.array(buckets, type=pa.binary()), pa.array(shares, type=pa.binary())], names=["lang", "key", "buckets", "shares"])

    return texts.mapInArrow(common.lean(run), "lang string, key long, buckets binary, shares binary")


@dataclass
class _Sample:
    """Texts as rows of one sparse matrix: row i has ``bucket`` and ``share`` from ``edges[i]`` to ``edges[i + 1]``."""

    bucket: np.ndarray
    share: np.ndarray
    edges: np.ndarray

    @classmethod
    def of(cls, table: pa.Table) -> _Sample:
        size = np.asarray(pc.binary_length(table.column("buckets")), dtype=np.int64) // 2
        bucket = np.frombuffer(b"".join(table.column("buckets").to_pylist()), dtype="<u2")
        return cls(bucket, np.frombuffer(b"".join(table.column("shares").to_pylist()), dtype="<f4"), np.concatenate(([0], np.cumsum(size))))

    def rows(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Buckets, shares and sizes of the rows ``at``, one after the other; none is empty."""
        size = self.edges[at + 1] - self.edges[at]
        index = np.repeat(self.edges[at] - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
        return self.bucket[index].astype(np.int64), self.share[index], size


def _descend(sample: _Sample, learn: np.ndarray, labels: np.ndarray, classes: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Embeddings, softmax weights and biases by stochastic gradient descent over the rows ``learn``."""
    rng = np.random.default_rng(seed)
    embed = rng.uniform(-0.5, 0.5, (BUCKETS, DIMENSIONS)).astype(np.float32)
    weight, bias = rng.uniform(-0.5, 0.5, (DIMENSIONS, classes)), np.zeros(classes)
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        order = rng.permutation(learn)
        for a in range(0, len(order), BATCH):
            at = order[a : a + BATCH]
            index, share, size = sample.rows(at)
            first = np.concatenate(([0], np.cumsum(size)[:-1]))
            mean = np.add.reduceat(embed[index] * share[:, None], first, axis=0).astype(np.float64)
            p = _softmax(mean @ weight + bias)
            p[np.arange(len(at)), labels[at]] -= 1
            back = (rate * 4 * (p @ weight.T)).astype(np.float32)
            weight -= rate * mean.T @ p / len(at)
            bias -= rate * p.mean(axis=0)
            np.subtract.at(embed, index, np.repeat(back, size, axis=0) * share[:, None])
    return embed, weight, bias


def _softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def train(docs: DataFrame, text_column: str = "text", lang_column: str = "lang", key_column: str = "doc_id") -> LanguageModel:
    """A model of all languages in ``docs``; rows without text or language teach nothing.

    The sample: of each language, rows by the hash of their key, PER_LANGUAGE at most in
    expectation, fewer of each where there are so many languages that IN_ALL would be exceeded;
    of each language every fifth text calibrates the temperature and the rejection, never the only one.
    Rows that share a key and language are drawn together. Without any labelled row the model knows
    no language and every text is ``und``.
    """
    none = LanguageModel([], np.zeros((BUCKETS + 1, 0)), np.zeros(0), 1.0, 1.0)
    rows = docs.select(docs[text_column].cast("string").alias("text"), docs[lang_column].cast("string").alias("lang"), F.xxhash64(docs[key_column]).alias("key")).where("text is not null and lang is not null")
    counts = common.written(rows.groupBy("lang").count(), "languages")
    languages = counts.count()
    if not languages:
        return none
    each = min(PER_LANGUAGE, max(5, IN_ALL // languages))
    counts = common.bounded_broadcast(counts, languages, 100_000)
    drawn = rows.join(counts, "lang").where(F.pmod("key", F.lit(1 << 30)) < F.least(F.lit(1.0), F.lit(float(each)) / F.col("count")) * (1 << 30))
    table = _features(drawn.select("lang", "key", "text")).toArrow().combine_chunks()
    if not table.num_rows:
        return none
    table = table.take(pc.sort_indices(table, sort_keys=[("lang", "ascending"), ("key", "ascending"), ("buckets", "ascending")]))
    coded = table.column("lang").combine_chunks().dictionary_encode()
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    languages, labels = coded.dictionary.to_pylist(), np.asarray(coded.indices, dtype=np.int64)
    sample = _Sample.of(table)
    del table
    place = np.arange(len(labels)) - np.searchsorted(labels, labels)  # within its language
    held = place % 5 == 4
    embed, weight, bias = _descend(sample, np.flatnonzero(~held), labels, len(languages))
    table = np.concatenate([embed @ weight, np.zeros((1, len(languages)))])
    temperature, reject_below = 1.0, 0.0
    if held.any() and len(languages) > 1:
        at = np.flatnonzero(held)
        right = labels[at]
        z = np.empty((len(at), len(languages)))
        for i, row in enumerate(at):
            bucket, share, _ = sample.rows(np.array([row]))
            z[i] = share @ table[bucket] + bias
        loss = lambda t: -np.log(_softmax(z / t)[np.arange(len(at)), right] + 1e-12).mean()
        temperature = min((0.1, 0.15, 0.2, 0.3, 0.5, 0.7, 1.0, 1.5, 2.0), key=loss)
        p = _softmax(z / temperature)
        sure = p.max(axis=1)[p.argmax(axis=1) == right]
        if len(sure):
            reject_below = float(min(ASKED, np.quantile(sure, GIVEN_UP)))
    return LanguageModel(languages, table.astype(np.float32), bias, temperature, reject_below)


def predict(docs: DataFrame, model: LanguageModel, text_column: str = "text") -> DataFrame:
    """``docs`` with lang_pred, lang_score and lang_rejected.

    lang_score: the calibrated probability of lang_pred. Rejected: a score below the one that
    calibration asks for. A null text, or one without a letter, is ``und`` with score 0 and
    rejected; equal probabilities go to the first language in order; existing columns of these
    names are replaced, all others stay; repeated rows are scored alike.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    new = {"lang_pred": pa.string(), "lang_score": pa.float64(), "lang_rejected": pa.bool_()}
    docs = docs.drop(*new)
    text = docs.columns.index(text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for rows in common.slices(batch, text, PART):
                column = rows.column(text)
                letters = np.asarray(pc.fill_null(pc.match_substring_regex(column, r"\p{L}"), False).to_numpy(zero_copy_only=False), dtype=bool)
                if not m.languages:
                    letters[:] = False
                grams, edges = _grams(column)
                z = sum(_by_text(m.table[g], edges) for g in grams)
                size = np.diff(edges)
                n = sum(np.maximum(0, size - w + 1) for w in WIDTHS)
                z = z / np.maximum(n, 1)[:, None] + m.bias
                if m.languages:
                    p = _softmax(z / m.temperature)
                    best, score = p.argmax(axis=1), p.max(axis=1)
                else:
                    best, score = np.zeros(len(size), dtype=int), np.zeros(len(size))
                score = np.where(letters, score, 0.0)
                names = [m.languages[b] if ok else "und" for b, ok in zip(best.tolist(), letters.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(names, type=pa.string()), pa.array(score), pa.array(~letters | (score < m.reject_below))], names=[*rows.schema.names, *new])

    return docs.mapInArrow(common.lean(run), common.extended(docs.schema, lang_pred="string", lang_score="double", lang_rejected="boolean"))
