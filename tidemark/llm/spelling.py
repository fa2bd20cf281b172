"""Spelling variants: words one edit apart, found among sorted permuterm rotations.

Each word is marked by a terminator and rotated to every position. A rotation's last character stands right
before its first one in the word, so all rotations that share everything but the last character are
words that differ by one replacement there; and if the shared text is itself a whole rotation, it is the
word without that character. Sorted, such a group is one run of rows, no longer than the alphabet plus
one, and a scan tells for each member how many others there are and which is the most frequent: no
pair is ever written.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Maximal runs of these letters are words.
LETTERS = "[A-Za-zÀ-ÿ]+"
#: Marks a word's end in its rotations; no letter.
END = "$"


def runs(docs: DataFrame, text_column: str = "text", out: str = "run") -> DataFrame:
    """``docs`` with one row for each run of LETTERS of the text, A-Z lower-cased; without a text none."""
    found = F.explode(F.regexp_extract_all(F.col(text_column), F.lit(LETTERS), F.lit(0)))
    kept = docs.withColumn(out, found)
    return kept.withColumn(out, F.translate(out, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def vocabulary(words: DataFrame, column: str = "word", least_length: int = 5, least: int = 3) -> DataFrame:
    """(word, n) of the words of at least ``least_length`` code points that occur ``least`` times; counted before the shuffle."""
    counted = words.where(F.length(column) >= least_length).groupBy(F.col(column).alias("word")).agg(F.count("*").alias("n"))
    return counted.where(F.col("n") >= least)


def rotations(vocabulary_: DataFrame) -> DataFrame:
    """(shared, edited, n): every rotation whole, with nothing edited, and without its last character, which is
    the edited one; sorted, so that what shares a text stands together in one partition."""
    marked = vocabulary_.select("n", F.concat("word", F.lit(END)).alias("m"), F.explode(F.sequence(F.lit(0), F.length("word"))).alias("i"))
    turned = marked.select("n", F.concat(F.expr("substr(m, i + 1)"), F.expr("substr(m, 1, i)")).alias("r"))
    last = F.expr("right(r, 1)")
    both = F.array(F.struct(F.col("r").alias("shared"), F.lit("").alias("edited")), F.struct(F.expr("left(r, length(r) - 1)").alias("shared"), last.alias("edited")))
    rows = turned.select("n", F.explode(F.when(last == END, F.slice(both, 1, 1)).otherwise(both)).alias("x"))
    return rows.select("x.shared", "x.edited", "n").repartitionByRange("shared").sortWithinPartitions("shared", "edited")


NEAR = "word string, n_near long, near_n long, near string"


def _group(shared: str, members: list[tuple[str, int]]) -> Iterator[tuple[str, int, int, str]]:
    """(word, near words met here for the first time, count and text of the best of all others) of each member.

    A word that loses a letter of a double one does so at two places: only the last place counts.
    """
    after, _, before = shared.partition(END)
    words = [(-n, before + edited + after, edited) for edited, n in members]
    whole = any(not edited for edited, _ in members)
    counted = lambda edited: not after or after[0] != edited
    shorter_by_one = sum(1 for edited, _ in members if edited and counted(edited))
    order = sorted(words)
    for n, word, edited in words:
        met = len(members) - 1 - (whole and not counted(edited)) if edited else shorter_by_one
        other = order[1] if order[0][1] == word else order[0]
        yield word, met, -other[0], other[1]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near words from sorted rotations; a run of rows may go on in the next batch."""
    open_: tuple[str, list[tuple[str, int]]] | None = None
    for batch in batches:
        out: list[tuple[str, int, int, str]] = []
        size = batch.num_rows
        if not size:
            continue
        shared = batch.column("shared")
        if size > 2:  # what stands alone within the batch has no near word here
            same = pc.equal(shared.slice(1), shared.slice(0, size - 1))
            inner = pc.or_(same.slice(1), same.slice(0, size - 2))
            keep = pa.concat_arrays([pa.array([True]), inner, pa.array([True])])
            batch = batch.filter(keep)
        for text, edited, n in zip(batch.column("shared").to_pylist(), batch.column("edited").to_pylist(), batch.column("n").to_pylist()):
            if open_ is not None and open_[0] == text:
                open_[1].append((edited, n))
                continue
            if open_ is not None and len(open_[1]) > 1:
                out += _group(*open_)
            open_ = (text, [(edited, n)])
        yield _rows(out)
    if open_ is not None and len(open_[1]) > 1:
        yield _rows(list(_group(*open_)))


def _rows(out: list[tuple[str, int, int, str]]) -> pa.RecordBatch:
    columns = list(zip(*out)) if out else [[], [], [], []]
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.string())], names=["word", "n_near", "near_n", "near"])


def near_words(vocabulary_: DataFrame) -> DataFrame:
    """(word, n_near, near, near_n): how many words of the vocabulary are one edit away, and the most frequent of them."""
    met = rotations(vocabulary_).mapInArrow(common.lean(_scan), NEAR)
    best = F.min(F.struct((-F.col("near_n")).alias("o"), F.col("near").alias("w"))).alias("b")
    return met.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", F.col("b.w").alias("near"), (-F.col("b.o")).alias("near_n"))


def followed(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): forms followed to the last. Each round doubles the steps taken; the ends of
    chains that have arrived take no part in it any more."""
    start = common.written(forms.select("word", F.col("form").alias("to")), "forms")
    done, moving = None, start
    while True:
        ahead = moving.alias("a").join(start.select(F.col("word").alias("__at")), F.col("to") == F.col("__at"), "left")
        told = common.written(ahead.select("word", "to", F.col("__at").isNotNull().alias("on")), "chains")
        ended = told.where("not on").select("word", "to")
        done = ended if done is None else done.unionByName(ended)
        moving = told.where("on").select("word", "to")
        if moving.isEmpty():
            return done.withColumnRenamed("to", "root")
        reach = moving.unionByName(done).select(F.col("word").alias("__at"), F.col("to").alias("__to"))
        moving = common.written(moving.join(reach, F.col("to") == F.col("__at")).select("word", F.col("__to").alias("to")), "chains")


def variants(vocabulary_: DataFrame, factor: int = 2) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of ``vocabulary_`` (word, n), words distinct.

    ``form``: of the words one inserted, deleted or replaced code point away the most frequent, the
    smallest by code points among equals, if it occurs at least ``factor`` times as often; else null. ``root``: the
    last form of forms; the word itself without one.

    Cases: null words are left out; an empty word is near words of one letter; a word without near ones
    has n_near 0; an empty table gives no rows; other columns are not read. Words hold no END.
    """
    words = common.written(vocabulary_.where("word is not null").select("word", "n"), "vocabulary")
    near = near_words(words).withColumnRenamed("word", "__near_of")
    told = words.join(near, F.col("word") == F.col("__near_of"), "left")
    often = F.col("near_n") >= F.lit(factor) * F.col("n")
    told = told.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(often, F.col("near")).alias("form"), F.when(often, F.col("near_n")).alias("form_n"))
    told = common.written(told, "near")
    roots = followed(told.where("form is not null")).withColumnRenamed("word", "__of")
    out = told.join(roots, F.col("word") == F.col("__of"), "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
