"""Product codes of vectors in integers, their entries found by LAESA pivots.

Vectors become integers and are cut into parts; each part position has a codebook, refined by rounds of
assignment and means. The distances of every part to a few fixed pivots are computed once and stored; in
each round only the entries' own distances to the pivots are new. By the triangle inequality their
differences bound a part's distance to an entry from below: entries are tried in the order of these
bounds, and those whose bound reaches the best distance found are never evaluated. All arithmetic is
exact in 64-bit integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Pivots of each part position.
PIVOTS = 4
#: Rows that a worker handles at once.
ROWS = 8192
#: Largest integer component; twice it squared, over 128 components of a part, fits in 64 bits.
LARGEST = 1 << 27

#: length of the vectors -> for each part its entries, one a row.
Books = dict[int, list[np.ndarray]]


def edges(length: int, parts: int) -> list[int]:
    """Where the parts of a vector begin and end: equal ones, the first one longer where it does not divide."""
    size, more = divmod(length, parts)
    return np.concatenate(([0], np.cumsum([size + (i < more) for i in range(parts)]))).astype(int).tolist()


def roots(squares: np.ndarray) -> np.ndarray:
    """Square roots rounded down, exact in 64-bit integers."""
    r = np.sqrt(squares.astype(np.float64)).astype(np.int64)
    r -= r * r > squares
    return r + ((r + 1) * (r + 1) <= squares)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a - b
    return (d * d).sum(axis=-1)


def nearest(rows: np.ndarray, to_pivots: np.ndarray, entries: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of the entry nearest to each row, the lower index among equals.

    ``to_pivots``: the rows' distances to ``pivots``, rounded down, so that a row's distance to an entry is
    greater than the difference of the two rounded distances less one.
    """
    own = roots(squared(entries[:, None], pivots[None]))
    bound = np.abs(to_pivots[:, None, :] - own[None]).max(axis=2) - 1
    order = np.argsort(bound, axis=1, kind="stable")
    index = order[:, 0].copy()
    best = squared(rows, entries[index])
    left = np.arange(len(rows))
    for step in range(1, len(entries)):
        at = order[left, step]
        low = bound[left, at]
        left = left[(low < 0) | (low * low < best[left])]  # bounds only grow, the best only shrinks
        if not len(left):
            break
        at = order[left, step]
        d = squared(rows[left], entries[at])
        better = (d < best[left]) | (d == best[left]) & (at < index[left])
        index[left[better]], best[left[better]] = at[better], d[better]
    return index, best


def spread(entries: np.ndarray, most: int = PIVOTS) -> np.ndarray:
    """Up to ``most`` distinct rows of ``entries``, each the farthest from those before it."""
    chosen = [0]
    far = squared(entries, entries[0])
    while len(chosen) < most and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, squared(entries, entries[chosen[-1]]))
    return entries[chosen]


def _by_length(batch: pa.RecordBatch, column: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, their lists as a matrix) for each length of the lists in ``column``."""
    lists = batch.column(column)
    offsets = np.asarray(lists.offsets, dtype=np.int64)
    values = np.asarray(lists.values, dtype=np.int64)
    sizes = np.diff(offsets)
    for n in np.unique(sizes):
        at = np.flatnonzero(sizes == n)
        yield at, values[offsets[at][:, None] + np.arange(n)]


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for a in range(0, batch.num_rows, ROWS):
        yield batch.slice(a, ROWS)


def integers(df: DataFrame, vector_column: str, scale: int) -> DataFrame:
    """The rows whose vector is there and finite throughout, with __ints: floor(scale * x) of each component."""
    usable = F.col(vector_column).isNotNull() & ~F.exists(vector_column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    kept = df.where(F.coalesce(usable, F.lit(False)))
    whole = F.transform(vector_column, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    fits = F.forall(whole, lambda x: F.abs(x) <= LARGEST)
    return kept.withColumn("__ints", F.when(fits, whole.cast("array<int>")).otherwise(F.raise_error(F.lit(f"a component times {scale} is above {LARGEST}")).cast("array<int>")))


def first_books(kept: DataFrame, id_column: str, parts: int, entries: int) -> Books:
    """The parts of the rows with the smallest ids, for each length; missing ids last, equal ones by their vectors."""
    order = Window.partitionBy(F.size("__ints")).orderBy(F.col(id_column).asc_nulls_last(), "__ints")
    first = kept.select(id_column, "__ints").withColumn("__rank", F.row_number().over(order)).where(F.col("__rank") <= entries)
    of: dict[int, list[tuple[int, list[int]]]] = {}
    for r in first.select("__rank", "__ints").collect():  # as many rows a length as a codebook has entries
        of.setdefault(len(r["__ints"]), []).append((r["__rank"], r["__ints"]))
    books = {}
    for n, rows in of.items():
        whole = np.array([v for _, v in sorted(rows)], dtype=np.int64).reshape(len(rows), n)
        at = edges(n, parts)
        books[n] = [whole[:, a:b] for a, b in zip(at, at[1:])]
    return books


def with_pivots(kept: DataFrame, pivots: Books, columns: list[str]) -> DataFrame:
    """``columns`` and __ints with __far: each part's distances to its pivots, rounded down."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in _pieces(batch):
                far = [None] * piece.num_rows
                for at, rows in _by_length(piece, "__ints"):
                    told = pivots[rows.shape[1]]
                    cuts = edges(rows.shape[1], len(told))
                    wide = np.concatenate([roots(squared(rows[:, None, a:b], p[None])) for a, b, p in zip(cuts, cuts[1:], told)], axis=1)
                    for i, row in zip(at, wide.astype(np.int32)):
                        far[i] = row
                yield pa.RecordBatch.from_arrays([*[piece.column(c) for c in (*columns, "__ints")], pa.array(far, pa.list_(pa.int32()))], names=[*columns, "__ints", "__far"])

    schema = T.StructType([kept.schema[c] for c in (*columns, "__ints")]).add("__far", T.ArrayType(T.IntegerType()))
    return kept.select(*columns, "__ints").mapInArrow(common.lean(run), schema)


def _assigned(piece: pa.RecordBatch, books: Books, pivots: Books) -> Iterator[tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]]:
    """(row numbers, vectors, (index, squared distance) by part) for each length in ``piece``."""
    far = piece.column("__far")
    offsets, values = np.asarray(far.offsets, dtype=np.int64), np.asarray(far.values, dtype=np.int64)
    for at, rows in _by_length(piece, "__ints"):
        book, marks = books[rows.shape[1]], pivots[rows.shape[1]]
        cuts, width = edges(rows.shape[1], len(book)), np.concatenate(([0], np.cumsum([len(p) for p in marks])))
        told = values[offsets[at][:, None] + np.arange(width[-1])]
        yield at, rows, [nearest(rows[:, cuts[i] : cuts[i + 1]], told[:, width[i] : width[i + 1]], book[i], marks[i]) for i in range(len(book))]


def refined(stored: DataFrame, books: Books, pivots: Books) -> Books:
    """The books after one round: each entry the mean of the parts nearest to it, rounded down; unused ones stay.

    A task gives one row for each entry's component, whatever its rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {n: [np.zeros((len(e), e.shape[1] + 1), dtype=np.int64) for e in book] for n, book in books.items()}
        for batch in batches:
            for piece in _pieces(batch):
                for _, rows, told in _assigned(piece, books, pivots):
                    cuts = edges(rows.shape[1], len(told))
                    for i, (index, _) in enumerate(told):
                        total = sums[rows.shape[1]][i]
                        for e in np.unique(index):
                            mine = rows[index == e, cuts[i] : cuts[i + 1]]
                            total[e, :-1] += mine.sum(axis=0)
                            total[e, -1] += len(mine)
        out = [(n, i, e, j, int(v)) for n, book in sums.items() for i, total in enumerate(book) for e in np.flatnonzero(total[:, -1]).tolist() for j, v in enumerate(total[e].tolist())]
        yield pa.RecordBatch.from_pylist([dict(zip(("length", "part", "entry", "place", "v"), r)) for r in out], schema=pa.schema([("length", pa.int32()), ("part", pa.int32()), ("entry", pa.int32()), ("place", pa.int32()), ("v", pa.int64())]))

    parted = stored.select("__ints", "__far").mapInArrow(common.lean(run), "length int, part int, entry int, place int, v long")
    total = parted.groupBy("length", "part", "entry", "place").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v"))
    found: dict[tuple[int, int, int], dict[int, int]] = {}
    for r in total.collect():  # the codebooks' size
        found.setdefault((r["length"], r["part"], r["entry"]), {})[r["place"]] = int(r["v"])
    out = {n: [e.copy() for e in book] for n, book in books.items()}
    for (n, part, entry), at in found.items():
        size = out[n][part].shape[1]
        out[n][part][entry] = [at[j] // at[size] for j in range(size)]
    return out


def digest(book: list[np.ndarray]) -> str:
    """SHA-256 of all components in decimal, by part, entry and place."""
    return hashlib.sha256(",".join(str(x) for e in book for x in e.ravel().tolist()).encode()).hexdigest()


def compress(df: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label", parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> DataFrame:
    """(id, label, code, error, label_error, codebooks_sha256) of every usable vector; see the module.

    ``code``: two hex digits a part; ``error``: squared distances to the chosen entries, summed over the parts;
    ``label_error``: error summed over the rows of equal label, missing ones together.

    Cases: vectors that are null or hold null or non-finite components are dropped; vectors of another
    length have codebooks of their own, all lengths in the same jobs; parts of a length that does not divide differ
    by one component, an empty vector has code 0 and error 0; with fewer vectors than entries the
    codebooks are shorter; repeated rows each count, a missing id comes last among the first
    entries; components beyond LARGEST are an error (distances would not fit in 64 bits); an empty table gives no rows; other
    columns are not read.
    """
    if entries > 256 or parts < 1:
        raise ValueError("a code has two hex digits a part")
    kept = integers(df.select(F.col(id_column).alias("__id"), F.col(label_column).alias("__label"), F.col(vector_column).alias("__v")), "__v", scale).drop("__v")
    books = first_books(kept, "__id", parts, entries)
    pivots = {n: [spread(e) for e in book] for n, book in books.items()}
    stored = common.written(with_pivots(kept, pivots, ["__id", "__label"]), "parts")
    for _ in range(rounds):
        books = refined(stored, books, pivots)
    digests = {n: digest(book) for n, book in books.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in _pieces(batch):
                code, error, of = [None] * piece.num_rows, np.zeros(piece.num_rows, dtype=np.int64), [None] * piece.num_rows
                for at, rows, told in _assigned(piece, books, pivots):
                    wide = np.column_stack([index for index, _ in told]).astype(np.uint8)
                    error[at] = sum(d for _, d in told)
                    for i, row in zip(at, wide):
                        code[i], of[i] = row.tobytes().hex(), digests[rows.shape[1]]
                yield pa.RecordBatch.from_arrays([piece.column("__id"), piece.column("__label"), pa.array(code, pa.string()), pa.array(error), pa.array(of, pa.string())], names=["__id", "__label", "code", "error", "codebooks_sha256"])

    schema = T.StructType([stored.schema["__id"], stored.schema["__label"]]).add("code", "string").add("error", "long").add("codebooks_sha256", "string")
    told = common.written(stored.mapInArrow(common.lean(run), schema), "codes")
    totals = common.written(told.groupBy("__label").agg(F.sum("error").alias("label_error"), F.count("*").alias("__n")).withColumnRenamed("__label", "__of"), "labels")
    return with_totals(told, totals).select(F.col("__id").alias(id_column), F.col("__label").alias(label_column), "code", "error", "label_error", "codebooks_sha256")


def with_totals(told: DataFrame, totals: DataFrame, few: int = 1_000_000) -> DataFrame:
    """``told`` with its label's total. Up to ``few`` labels are broadcast; of more, only the frequent ones
    (fewer than 1,000 hold a thousandth of the rows or more), the rest is joined by shuffle."""
    same = F.col("__label").eqNullSafe(F.col("__of"))
    size = totals.agg(F.count("*").alias("labels"), F.sum("__n").alias("rows")).first()
    if size["labels"] <= few:
        return told.join(F.broadcast(totals), same)
    often = F.col("__n") * 1000 >= size["rows"]
    hot = F.broadcast(totals.where(often))
    return told.join(hot, same).unionByName(told.join(hot.select(F.col("__of").alias("__hot")), F.col("__label").eqNullSafe(F.col("__hot")), "left_anti").join(totals.where(~often), same))
