"""WARC archives packaged in ZIP files: written by tasks, read back by ranges.

Each partition writes one ZIP file with two stored members: the WARC file, one gzip member for
each record, and an index of the records' offsets. The reader parses the end record, the ZIP64
records and the central directory, finds the stored members, and deals out ranges of records
from the index; tasks then read their ranges alone. Nothing is extracted. Files are opened through
pyarrow's file systems, by URI, below the shared folder.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.jsonl"
#: Payloads from this size on are stored once.
LEAST_REVISIT = 100
#: Bytes of records in a range.
RANGE = 4 << 20
#: Ranges that a task reads one after the other; tasks at most, beyond which they read more.
RANGES_A_TASK, MOST_TASKS = 2, 100_000
ID = "urn:page:"


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri) if ":" in uri else f"file://{uri}")


# --------------------------------------------------------------- writing
def mark_revisits(pages: DataFrame) -> DataFrame:
    """``pages`` (page_id, url, payload) with digest, record_type and refers_to.

    Of equal payloads of at least LEAST_REVISIT bytes the one with the smallest page_id is the
    response (each of them, if rows share that page_id or have none), the others revisit it.
    """
    told = pages.withColumn("digest", F.sha2("payload", 256))
    heads = told.where(F.octet_length("payload") >= LEAST_REVISIT).groupBy("digest").agg(F.count("*").alias("n"), F.min("page_id").alias("head")).where("n > 1 and head is not null").select(F.col("digest").alias("of"), "head")
    heads = common.written(heads, "heads")
    heads = common.bounded_broadcast(heads, heads.count(), 200_000)
    revisit = F.coalesce(F.col("head") != F.col("page_id"), F.col("head").isNotNull())
    return told.join(heads, F.col("digest") == F.col("of"), "left").select("page_id", "url", F.when(~revisit, F.col("payload")).alias("payload"), F.octet_length("payload").cast("long").alias("size"), "digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("head")).alias("refers_to"))


def _record(page_id: int | None, url: str | None, payload: bytes | None, size: int, digest: str, kind: str, refers_to: int | None) -> bytes:
    """One WARC record. A revisit's block is the HTTP head alone, with the payload's length."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{ID}{'' if page_id is None else page_id}>", "WARC-Date: 2024-01-01T00:00:00Z", f"WARC-Payload-Digest: sha256:{digest}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{ID}{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """Writes the marked records; returns the list of files (file, records, bytes).

    One archive a partition, under a name of its own for each attempt; the list is what counts:
    Spark commits it, so files of lost or repeated attempts are in no list. A partition without
    rows writes no file. Rows are written as they come; memory holds one Arrow batch and the index.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _open(folder)
        system.create_dir(base, recursive=True)
        name = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.wacz"
        pending = (rows for batch in batches for rows in common.slices(batch, "payload") if rows.num_rows)
        first = next(pending, None)
        if first is None:
            return
        index, n, at = [], 0, 0
        with system.open_output_stream(f"{base}/{name}") as out:
            with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True) as packed:
                with packed.open(zipfile.ZipInfo(ARCHIVE), "w", force_zip64=True) as member:
                    while first is not None:
                        for row in zip(*(first.column(c).to_pylist() for c in ("page_id", "url", "payload", "size", "digest", "record_type", "refers_to")), strict=True):
                            deflate = zlib.compressobj(1, zlib.DEFLATED, 31)
                            raw = deflate.compress(_record(*row)) + deflate.flush()
                            member.write(raw)
                            index.append(json.dumps({"offset": at, "length": len(raw)}))
                            at, n = at + len(raw), n + 1
                        first = next(pending, None)
                packed.writestr(zipfile.ZipInfo(INDEX), "\n".join(index))
        yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([n]), pa.array([at])], names=["file", "records", "bytes"])

    return common.written(records.mapInArrow(common.lean(write), "file string, records long, bytes long"), "archives")


# --------------------------------------------------------------- reading
def zip_members(source: pa.NativeFile) -> dict[str, tuple[int, int, int]]:
    """name -> (offset of the data, stored size, method) from the central directory."""
    size = source.size()
    tail = min(size, 22 + 65535 + 20)
    source.seek(size - tail)
    end = source.read(tail)
    at = end.rfind(b"PK\x05\x06")
    if at < 0:
        raise ValueError("no end of a ZIP directory")
    entries, length, offset = struct.unpack("<HII", end[at + 10 : at + 20])
    if (entries == 0xFFFF or length == 0xFFFFFFFF or offset == 0xFFFFFFFF) and at >= 20 and end[at - 20 : at - 16] == b"PK\x06\x07":
        source.seek(struct.unpack("<Q", end[at - 12 : at - 4])[0])
        wide = source.read(56)
        if wide[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end record where its locator points")
        entries, length, offset = struct.unpack("<QQQ", wide[32:56])
    source.seek(offset)
    directory, found, p = source.read(length), {}, 0
    for _ in range(entries):
        if directory[p : p + 4] != b"PK\x01\x02":
            raise ValueError("broken ZIP directory")
        flags, method = struct.unpack("<HH", directory[p + 8 : p + 12])
        packed, plain, n, m, k = struct.unpack("<IIHHH", directory[p + 20 : p + 34])
        local = struct.unpack("<I", directory[p + 42 : p + 46])[0]
        name = directory[p + 46 : p + 46 + n].decode("utf-8" if flags & 0x800 else "cp437")
        extra, q = directory[p + 46 + n : p + 46 + n + m], 0
        while q + 4 <= len(extra):
            tag, width = struct.unpack("<HH", extra[q : q + 4])
            if tag == 1:  # ZIP64: only the fields that overflow above, in this order
                body, r = extra[q + 4 : q + 4 + width], 0
                if plain == 0xFFFFFFFF:
                    plain, r = struct.unpack("<Q", body[r : r + 8])[0], r + 8
                if packed == 0xFFFFFFFF:
                    packed, r = struct.unpack("<Q", body[r : r + 8])[0], r + 8
                if local == 0xFFFFFFFF:
                    local = struct.unpack("<Q", body[r : r + 8])[0]
            q += 4 + width
        found[name] = (local, packed, method)
        p += 46 + n + m + k
    out = {}
    for name, (local, packed, method) in found.items():
        source.seek(local)
        head = source.read(30)
        if head[:4] != b"PK\x03\x04":
            raise ValueError(f"no local header of {name}")
        out[name] = (local + 30 + sum(struct.unpack("<HH", head[26:30])), packed, method)
    return out


def locate_ranges(files: DataFrame) -> DataFrame:
    """(file, start, length) of runs of whole records, about RANGE bytes each, for ``files`` (file).

    From the index where a file has one; a stored archive without index is one range, as its
    records are found only by reading on. Deflated members are an error: they cannot be ranged.
    """

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column("file").to_pylist():
                system, path = _open(file)
                with system.open_input_file(path) as source:
                    members = zip_members(source)
                    ranges = []
                    for name, (start, size, method) in sorted(members.items()):
                        if not re.fullmatch(r"archive/.*\.warc(\.gz)?", name):
                            continue
                        if method:
                            raise ValueError(f"{file}: {name} is not stored")
                        if INDEX not in members or name != ARCHIVE:
                            ranges += [(start, size)] if size else []
                            continue
                        source.seek(members[INDEX][0])
                        begin = length = 0
                        for line in source.read(members[INDEX][1]).decode().splitlines():
                            entry = json.loads(line)
                            if length and length + entry["length"] > RANGE:
                                ranges.append((start + begin, length))
                                begin, length = entry["offset"], 0
                            length += entry["length"]
                        ranges += [(start + begin, length)] if length else []
                yield pa.RecordBatch.from_arrays([pa.array([file] * len(ranges), type=pa.string()), pa.array([r[0] for r in ranges], type=pa.int64()), pa.array([r[1] for r in ranges], type=pa.int64())], names=["file", "start", "length"])

    return files.select("file").mapInArrow(common.lean(locate), "file string, start long, length long")


def _records(source: pa.NativeFile, start: int, length: int) -> Iterator[bytes]:
    """The WARC records of a range: gzip members, or plain records one after the other."""
    source.seek(start)
    left, raw, step = length, b"", 1 << 16

    def more() -> bool:
        nonlocal left, raw
        got = source.read(min(step, left))
        left -= len(got)
        raw += got
        return bool(got)

    more()
    while raw or (left and more()):
        while len(raw) < 2 and left and more():  # a read may end inside the two bytes that tell gzip
            pass
        if raw[:2] == b"\x1f\x8b":
            inflate, parts = zlib.decompressobj(31), []
            while True:
                parts.append(inflate.decompress(raw))
                raw = inflate.unused_data
                if inflate.eof:
                    break
                raw = b""
                if not left or not more():
                    raise ValueError("a record is cut off")
            yield b"".join(parts)
            continue
        while (at := raw.find(b"\r\n\r\n")) < 0 and left and more():
            pass
        size = re.search(rb"(?im)^Content-Length:\s*(\d+)\s*$", raw[:at])
        if at < 0 or not size:
            raise ValueError("not a WARC record")
        whole = at + 4 + int(size[1]) + 4
        while len(raw) < whole and left and more():
            pass
        yield raw[:whole]
        raw = raw[whole:]


def read_records(ranges: DataFrame) -> DataFrame:
    """The records in ``ranges``: page_id, url, record_type, refers_to, payload (null for
    revisits), and the payload's length and digest as the record declares them."""
    schema = "page_id long, url string, record_type string, refers_to long, payload binary, declared_length long, declared_digest string"
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.string()]

    def number(uri: str | None) -> int | None:
        digits = (uri or "").strip("<> ").removeprefix(ID)
        return int(digits) if digits.lstrip("-").isdigit() else None

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, start, length in zip(*(batch.column(c).to_pylist() for c in ("file", "start", "length")), strict=True):
                rows, held = [], 0
                system, path = _open(file)
                with system.open_input_file(path) as source:
                    for raw in _records(source, start, length):
                        head, _, block = raw.partition(b"\r\n\r\n")
                        lines = head.decode("utf-8", "replace").split("\r\n")
                        fields = dict((k.strip().lower(), v.strip()) for k, _, v in (x.partition(":") for x in lines[1:]))
                        kind = fields.get("warc-type")
                        if kind not in ("response", "revisit"):
                            continue
                        http, _, payload = block[: int(fields["content-length"])].partition(b"\r\n\r\n")
                        declared = re.search(rb"(?im)^Content-Length:\s*(\d+)\s*$", http)
                        rows.append((number(fields.get("warc-record-id")), fields.get("warc-target-uri"), kind, number(fields.get("warc-refers-to")), payload if kind == "response" else None, int(declared[1]) if declared else None, fields.get("warc-payload-digest", "").removeprefix("sha256:") or None))
                        held += len(raw)
                        if held >= common.SLICE_BYTES:
                            yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return ranges.mapInArrow(common.lean(read), schema)


def with_payloads(records: DataFrame) -> DataFrame:
    """(page_id, url, record_type, refers_to, payload_bytes, payload_digest) of records read back.

    Size and digest are measured on the payloads that were read. A revisit has none: it takes
    those of the response that it refers to, of the digest that it declares; where that response is
    in none of the archives, what its own header declares. The payloads are read once.
    """
    told = records.select("page_id", "url", "record_type", "refers_to", F.octet_length("payload").cast("long").alias("size"), F.sha2("payload", 256).alias("digest"), "declared_length", "declared_digest")
    told = common.written(told, "records")
    wanted = told.where("record_type = 'revisit'").select(F.col("refers_to").alias("page_id"), F.col("declared_digest").alias("digest")).distinct()
    heads = told.where("record_type = 'response'").join(wanted, ["page_id", "digest"], "left_semi").groupBy("page_id", "digest").agg(F.max("size").alias("head_size"))
    heads = common.written(heads.select(F.col("page_id").alias("of"), F.col("digest").alias("of_digest"), "head_size"), "responses")
    heads = common.bounded_broadcast(heads, heads.count(), 200_000)
    out = told.join(heads, (F.col("record_type") == "revisit") & (F.col("refers_to") == F.col("of")) & (F.col("declared_digest") == F.col("of_digest")), "left")
    return out.select("page_id", "url", "record_type", "refers_to", F.coalesce("size", "head_size", "declared_length").alias("payload_bytes"), F.coalesce("digest", "of_digest", "declared_digest").alias("payload_digest"))


def archive_pages(pages: DataFrame, folder: str, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """Writes ``pages`` as archives below ``folder`` and returns the records read back.

    Cases: null html is an empty payload; empty and small payloads are responses each; a null url
    has no target field, white space in urls is percent-encoded; repeated rows have a record
    each; a null page_id is a record without number; other columns are not read; an empty table
    writes no archive and gives no rows.
    """
    named = pages.select(pages[id_column].cast("long").alias("page_id"), pages[url_column].cast("string").alias("url"), F.coalesce(pages[html_column].cast("string"), F.lit("")).cast("binary").alias("payload"))
    files = write_archives(mark_revisits(named), folder)
    ranges = common.written(locate_ranges(files), "ranges")
    # a range is a small row but much work: a number of its own, which adaptive execution does not merge
    return read_records(ranges.repartition(min(max(1, -(-ranges.count() // RANGES_A_TASK)), MOST_TASKS)))
