"""Token ids as Parquet list columns, for selective reads of tokens and metadata.

The ids of a document are one list<int32> value. Spark's Parquet writer stores them with a
dictionary (the vocabulary fits one dictionary page) or, on request, with version 2's delta
encodings, in row groups and pages of a set size; page indexes let a reader skip to the pages
that hold the wanted documents.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, tokens

#: Pieces whose ids a worker keeps: most of its memory is free here.
KEPT = 1_000_000
FILE_SCHEMA = "doc_id long, part int, part_start long, n_tokens long, tokens array<int>"


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, encoding: str = "dictionary", row_group_bytes: int = 32 << 20, page_bytes: int = 256 << 10, page_rows: int = 512, id_column: str = "doc_id", text_column: str = "text") -> None:
    """Writes each document's ids and then ``end_id`` below ``path``, in ascending doc_id order.

    Files: doc_id, part (the file's rank in doc_id order), part_start (ids before the document
    in its part), n_tokens, tokens. ``encoding``: dictionary or delta.

    Cases: a null or empty text is ``end_id`` alone; null doc_ids come first; repeated doc_ids
    stand next to each other in some order; other columns are not read; an empty table gives
    files without rows.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, start = tokens.encoder(tokenizer, KEPT), TaskContext.get().partitionId(), 0
        for batch in batches:
            for rows in common.slices(batch, "text", 8 << 20):
                ids, edges = encoder.encode(rows.column("text"), end_id)
                lists = pa.ListArray.from_arrays(pa.array(edges, type=pa.int32()), pa.array(ids.view(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), pa.array(np.full(rows.num_rows, part, dtype=np.int32)), pa.array(start + edges[:-1]), pa.array(np.diff(edges)), lists],
                    names=["doc_id", "part", "part_start", "n_tokens", "tokens"],
                )
                start += int(edges[-1])

    narrow = docs.select(docs[id_column].cast("long").alias("doc_id"), docs[text_column].cast("string").alias("text"))
    ordered = narrow.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    options = {
        "parquet.enable.dictionary": str(encoding == "dictionary").lower(),
        "parquet.writer.version": "PARQUET_1_0" if encoding == "dictionary" else "PARQUET_2_0",
        "parquet.dictionary.page.size": str(1 << 20),
        "parquet.block.size": str(row_group_bytes),
        "parquet.page.size": str(page_bytes),
        "parquet.page.row.count.limit": str(page_rows),
        "compression": "zstd",
    }
    ordered.mapInArrow(common.lean(encode), FILE_SCHEMA).write.options(**options).parquet(path)


def read_token_files(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """The files' rows, of doc_ids from ``first`` to ``last``: Parquet's statistics and page
    indexes skip the rest. Select doc_id and n_tokens alone to leave the ids unread."""
    rows = spark.read.schema(FILE_SCHEMA).parquet(path)
    if first is not None:
        rows = rows.where(F.col("doc_id") >= first)
    if last is not None:
        rows = rows.where(F.col("doc_id") <= last)
    return rows


def with_global_start(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Adds start, the ids of all documents before, to ``rows`` of ``files``. Sums one number per
    part; the files' ids stay unread for that."""
    totals = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = totals.select(F.col("part").alias("of"), (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    return rows.join(before, rows["part"] == before["of"]).withColumn("start", F.col("before") + F.col("part_start")).drop("of", "before")


def with_crc32(rows: DataFrame) -> DataFrame:
    """(doc_id, part, part_start, n_tokens, ids_crc32) of read rows; ids as little-endian unsigned 32-bit."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("tokens")
            edges = np.asarray(lists.offsets, dtype=np.int64) * 4
            values = np.ascontiguousarray(np.asarray(lists.values, dtype="<i4"))
            raw = memoryview(values).cast("B")
            crc = [zlib.crc32(raw[a:b]) for a, b in zip(edges, edges[1:], strict=False)]
            keep = [batch.column(c) for c in ("doc_id", "part", "part_start")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(np.diff(edges) // 4), pa.array(crc, type=pa.int64())], names=["doc_id", "part", "part_start", "n_tokens", "ids_crc32"])

    return rows.select("doc_id", "part", "part_start", "tokens").mapInArrow(common.lean(check), "doc_id long, part int, part_start long, n_tokens long, ids_crc32 long")
