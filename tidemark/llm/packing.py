"""Packing of documents into fixed-length training sequences by dynamic programming.

Each partition is a stream of documents in order. Cuts may fall at document ends (free), at
sentence ends (a small penalty) and, where no sentence ends for long, inside a sentence (a
larger one). ``best_cuts`` minimises padding plus penalties plus a fixed cost per sequence; as
the padding of a window from i to j is ``limit - (j - i)``, the best i is the smallest
``cost[i] + i`` within reach, which a monotone queue yields in constant time.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from . import common, tokens

LENGTH = 2048
#: Costs, in tokens of padding.
SENTENCE_CUT, INNER_CUT, PER_SEQUENCE = 4, 48, 16
#: Tokens between two possible cuts, at least; inside a long sentence, at most.
APART, INNER_STEP = 16, 128
#: Tokens over which the cuts are chosen at once; the last, open window is carried on.
RUN = 64 * LENGTH
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, sequence_length long"


def best_cuts(at: list[int], penalty: list[int], limit: int, open_end: bool) -> list[int]:
    """The chosen positions among ``at`` (rising, from 0 to the end), first and last included.

    ``open_end``: the last window is to be continued, so its padding costs nothing. Windows of
    a power of two from limit / 8 on need no padding.
    """
    powers, p = [], limit // 2
    while p >= max(1, limit // 8):
        powers.append(p)
        p //= 2
    where = {x: i for i, x in enumerate(at)}
    cost, came = [0], [0]
    queue: deque[int] = deque([0])
    key = [0]
    last = len(at) - 1
    for j in range(1, len(at)):
        x = at[j]
        while at[queue[0]] < x - limit:
            queue.popleft()
        i = queue[0]
        best = key[i] + limit - x
        if j == last and open_end:
            i = min(queue, key=cost.__getitem__)
            best = cost[i]
        else:
            for p in powers:
                k = where.get(x - p)
                if k is not None and cost[k] < best:
                    best, i = cost[k], k
        best += PER_SEQUENCE + penalty[j]
        cost.append(best)
        came.append(i)
        k = best + x
        key.append(k)
        while queue and key[queue[-1]] >= k:
            queue.pop()
        queue.append(j)
    out = [last]
    while out[-1]:
        out.append(came[out[-1]])
    return [at[i] for i in reversed(out)]


def cut_places(ids: np.ndarray, ends: np.ndarray, sentence_end: np.ndarray, limit: int) -> tuple[list[int], list[int]]:
    """Possible cuts in a run of ids: positions and penalties. ``ends``: where documents end."""
    total = len(ids)
    free = np.zeros(total + 1, dtype=bool)
    free[ends] = True
    free[0] = free[total] = True
    marks = np.zeros(total + 1, dtype=bool)
    marks[1:] = sentence_end[ids]
    places = np.flatnonzero(marks & ~free)
    # thin out sentence ends: one for each step of APART tokens
    if len(places):
        places = places[np.concatenate(([True], np.diff(places // APART) > 0))]
    docs = np.flatnonzero(free)
    base = np.union1d(places, docs)
    gaps = np.diff(base)
    step = min(INNER_STEP, limit)
    wide = np.flatnonzero(gaps > step)
    inner = [np.arange(base[k] + step, base[k + 1], step) for k in wide]
    every = np.concatenate([base, *inner])
    kind = np.concatenate([np.where(free[base], 0, SENTENCE_CUT), np.full(len(every) - len(base), INNER_CUT)])
    order = np.argsort(every, kind="stable")
    return every[order].tolist(), kind[order].tolist()


def halves(n: int) -> list[int]:
    """``n`` as falling powers of two."""
    return [1 << k for k in range(n.bit_length() - 1, -1, -1) if n >> k & 1]


class _Packer:
    """Packs one partition's stream. Pending documents: (id, ids so far given out, bytes, whole length)."""

    def __init__(self, limit: int, sentence_end: np.ndarray, first_id: int):
        self.limit, self.sentence_end, self.next_id = limit, sentence_end, first_id
        self.docs: deque[tuple[int | None, int, bytes, int]] = deque()
        self.size = 0
        self.rows: list[tuple] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        n = len(ids) // 4
        for a in range(0, n, RUN):  # a longer document comes in parts, so that a run stays bounded
            part = ids[4 * a : 4 * (a + RUN)]
            self.docs.append((doc_id, a, part, n))
            self.size += len(part) // 4
            if self.size >= RUN:
                self.settle(False)

    def settle(self, end: bool) -> None:
        if not self.size:
            return
        ids = np.frombuffer(b"".join(d[2] for d in self.docs), dtype="<u4")
        ends = np.cumsum([len(d[2]) // 4 for d in self.docs])
        whole = ends[[d[1] + len(d[2]) // 4 == d[3] for d in self.docs]]
        at, penalty = cut_places(ids, whole, self.sentence_end, self.limit)
        cuts = best_cuts(at, penalty, self.limit, True)
        for a, b in zip(cuts, cuts[1:-1], strict=False):
            self.emit(b - a)
        if end:
            rest = cuts[-1] - cuts[-2]
            for n in [rest] if rest == self.limit else halves(rest):
                self.emit(n)

    def emit(self, n: int) -> None:
        """The next ``n`` ids make a sequence."""
        self.size -= n
        offset, length = 0, n
        while n:
            doc_id, start, ids, whole = self.docs.popleft()
            take = min(n, len(ids) // 4)
            self.rows.append((doc_id, start, take, ids[: 4 * take], whole, self.next_id, offset, length))
            if 4 * take < len(ids):
                self.docs.appendleft((doc_id, start + take, ids[4 * take :], whole))
            n -= take
            offset += take
        self.next_id += 1

    def taken(self) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        columns = zip(*self.rows, strict=True) if self.rows else [[] for _ in names]
        self.rows, rows = [], columns
        return pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(rows, kinds, strict=True)], names=names)


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, length: int = LENGTH, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Packs every document's ids, then ``end_id``, into sequences of at most ``length`` ids.

    Returns one row per piece: doc_id, start (the document's ids before the piece), length, ids
    (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset (gapless from 0 within the
    sequence) and sequence_length. Order is kept within each input partition; no shuffle.

    Cases: a null or empty text is ``end_id`` alone; repeated rows are packed as often as they
    occur; a null doc_id is carried as null; a document longer than a sequence is cut at
    sentence ends where there are any; an empty table gives no rows; other columns, whatever
    their names, are not read. The rest of a partition becomes sequences of powers of two,
    which need no padding. Working memory of a task: one Arrow batch and one run of ids.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.encoder(tokenizer)
        names = encoder.tokenizer.get_vocab(with_added_tokens=True)
        sentence_end = np.zeros(max(max(names.values()), end_id) + 1, dtype=bool)
        sentence_end[[i for t, i in names.items() if t.removesuffix("</w>")[-1:] in (".", "!", "?", "…", "。")]] = True
        packer = _Packer(length, sentence_end, TaskContext.get().partitionId() << 40)
        for batch in batches:
            for part in common.slices(batch, "text"):
                ids, edges = encoder.encode(part.column("text"), end_id)
                raw, edges = ids.tobytes(), (edges * 4).tolist()
                for doc_id, a, b in zip(part.column("doc_id").to_pylist(), edges, edges[1:], strict=False):
                    packer.add(doc_id, raw[a:b])
                if packer.rows:
                    yield packer.taken()
        packer.settle(True)
        yield packer.taken()

    narrow = docs.select(docs[id_column].cast("long").alias("doc_id"), docs[text_column].cast("string").alias("text"))
    return narrow.mapInArrow(common.lean(pack), SCHEMA)
