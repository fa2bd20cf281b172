"""Helpers that the corpus operators share: scratch tables, word arrays, components."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that a Python worker handles at once.
SLICE_BYTES = 4 << 20
#: Spark's setting that a query's shuffle files go with its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


# --------------------------------------------------------------- tables
def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of the data folder, read by Spark's reader."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: ``spark.checkpoint.dir`` of the session.

    Where it is unset, a local session (tests, a laptop) gets a temporary folder of this machine, removed at
    exit; a cluster, whose machines would not see it, gets an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        own = tempfile.mkdtemp(prefix="tidemark-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(f"file://{own}")
        root = spark.sparkContext.getCheckpointDir()
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{scratch_root(spark)}/tidemark-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, clean: bool = False) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts the lineage, survives lost executors.

    Spark deletes a shuffle's files when the driver's collector finds its plan, which on a heap with room it may
    not do for the rest of the job; so the driver is asked to collect what earlier tables left before a new one begins.
    That may leave the last table's; with ``clean`` Spark deletes this one's files as soon as it is written.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    spark.sparkContext._jvm.java.lang.System.gc()
    held = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, str(clean or held == "true").lower())
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, held)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Deletes the folders of tables that ``written`` made, which nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        own = f"/tidemark-{spark.sparkContext.applicationId}/"
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles() if own in f}:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def bounded_broadcast(df: DataFrame, rows: int, limit: int = 1_000_000) -> DataFrame:
    """``df`` marked for broadcast if its counted ``rows`` stay within ``limit``; else as it is."""
    return F.broadcast(df) if rows <= limit else df


def extended(schema: T.StructType, **more: str) -> T.StructType:
    """A copy of ``schema`` with further columns."""
    out = T.StructType(list(schema.fields))
    for name, kind in more.items():
        out = out.add(name, kind)
    return out


def fold(column: str, n: int) -> F.Column:
    """crc32 of the column as text, modulo ``n``."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(n))


# --------------------------------------------------------------- Python workers
def _returns_memory() -> ctypes.CDLL | None:
    """Makes this worker map large arrays one by one, so that each goes back when it is freed."""
    pa.set_memory_pool(pa.system_memory_pool())
    try:
        libc = ctypes.CDLL(None)
        libc.mallopt(-3, 2 << 20)  # M_MMAP_THRESHOLD: from 2 MB on, for good
        libc.malloc_trim  # noqa: B018
    except (OSError, AttributeError):  # not glibc
        return None
    return libc


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow in a worker that gives its memory back between large arrays and at the
    partition's end: workers are used again by later stages, whose memory adds to what is kept."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        libc = _returns_memory()
        yield from run(batches)
        if libc is not None:
            libc.malloc_trim(0)

    return wrapped


def lean_group(run: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """As ``lean``, for applyInArrow of groups."""

    def wrapped(rows: pa.Table) -> pa.Table:
        libc = _returns_memory()
        out = run(rows)
        if libc is not None:
            libc.malloc_trim(0)
        return out

    return wrapped


def lean_cogroup(run: Callable[[pa.Table, pa.Table], pa.Table]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """As ``lean``, for applyInArrow of pairs of groups."""

    def wrapped(left: pa.Table, right: pa.Table) -> pa.Table:
        libc = _returns_memory()
        out = run(left, right)
        if libc is not None:
            libc.malloc_trim(0)
        return out

    return wrapped


# --------------------------------------------------------------- Arrow slices and words
def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of ``batch`` with about ``most`` bytes in the string ``column``; a longer row stands alone."""
    size = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
    if not len(size):
        return
    part = np.cumsum(size) // most
    cuts = np.flatnonzero(np.diff(part)) + 1
    edges = [0, *cuts.tolist(), len(size)]
    for a, b in zip(edges, edges[1:], strict=False):
        yield batch.slice(a, b - a)


def strings(texts: pa.Array) -> list[str]:
    """As to_pylist, in a tenth of its time."""
    return texts.to_numpy(zero_copy_only=False).tolist()


def hash_words(words: list[str]) -> np.ndarray:
    """64-bit hashes of distinct words."""
    h = xxhash.xxh3_64_intdigest
    return np.fromiter((h(w) for w in words), dtype=np.uint64, count=len(words))


class Words:
    """The words of some texts: ASCII letters lower-cased, cut at ``[\\x20\\x09-\\x0D]+``.

    ``code`` holds an index into ``vocabulary`` for each word, ``bounds`` the texts' edges in it.
    A null text has no words.
    """

    def __init__(self, texts: pa.Array):
        texts = pc.fill_null(texts, "")
        lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
        offsets = np.asarray(lists.offsets, dtype=np.int64)
        flat = lists.values.slice(offsets[0], offsets[-1] - offsets[0])
        offsets = offsets - offsets[0]
        coded = flat.dictionary_encode()
        if isinstance(coded, pa.ChunkedArray):
            coded = coded.combine_chunks()
        code = np.asarray(coded.indices, dtype=np.int64)
        self.vocabulary = strings(coded.dictionary)
        if "" in self.vocabulary:
            keep = code != self.vocabulary.index("")
            kept = np.concatenate(([0], np.cumsum(keep)))
            offsets, code = kept[offsets], code[keep]
        self.code, self.bounds = code, offsets

    def __len__(self) -> int:
        return len(self.bounds) - 1


def mix(h: np.ndarray) -> np.ndarray:
    """Finishes a 64-bit hash."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def chain(hashes: list[np.ndarray]) -> np.ndarray:
    """One 64-bit hash of equally long columns of hashes, by order."""
    out = np.full(len(hashes[0]), 0x9E3779B97F4A7C15, dtype=np.uint64)
    for h in hashes:
        out = mix(out * np.uint64(0x100000001B3) + h)
    return out


# --------------------------------------------------------------- components
def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) of every node of ``edges`` (a, b): the smallest id reachable.

    Alternates star contractions: every node's neighbours are hung below its smallest
    neighbour until nothing moves. Each round writes its edges to the shared folder, so no
    lineage grows and nothing but two numbers comes to the driver.
    """
    both = edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).where("hi <> lo").distinct()
    now = written(both, "edges")
    seen = None
    while True:
        # larger neighbours go to the smallest neighbour of the node
        way = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(now.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        low = way.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = way.where("v > u").join(low, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
        large = large.where("hi <> lo").distinct()
        # a node's smaller neighbours and itself go to the smallest of them
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(low, "hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        now = written(small.unionByName(low.select("hi", F.col("m").alias("lo"))).where("hi <> lo").distinct(), "edges")
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
    roots = now.select(F.col("lo").alias("id"), F.col("lo").alias("component")).distinct()
    return now.select(F.col("hi").alias("id"), F.col("lo").alias("component")).unionByName(roots)
