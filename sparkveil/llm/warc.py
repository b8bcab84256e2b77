"""WARC files of gzip members, read in splits.

Any number of tasks read one file: each has a byte range, looks for the gzip magic in it and takes a
candidate for a member only if it inflates to a WARC header with a length and the block agrees. A task
owns the records that start in its range and reads past the end of it to finish the last one; from a
record's end it goes on to the next magic, so that a damaged member costs that record alone.

Defined cases: a null url leaves its header out and comes back null; a null payload is marked as such and
comes back null, an empty one empty; null page_id comes back null; line ends in a url and white space around
it are escaped, and it may be of any length; bytes of url or payload that are no UTF-8 come back as they are;
repeated rows are records of their own; empty files and an empty table give no records; a payload larger
than a split is read by its owner alone; magic bytes inside compressed data fail validation; damaged or
cut members are left out; extra columns are not written.
"""

from __future__ import annotations

import base64
import hashlib
import os
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import unquote_to_bytes

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir

SPLIT_BYTES = 4 << 20
READ = 1 << 18
MAGIC = b"\x1f\x8b\x08"
COLUMNS = "path string, at long, type string, record_id string, url binary, payload binary"


def open_fs(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def escaped(url: bytes) -> bytes:
    """url without line ends and outer white space, which unquote_to_bytes() restores."""
    inner = url.strip()
    at = url.find(inner)
    plain = lambda x: b"".join(b"%%%02X" % c for c in x)
    return plain(url[:at]) + inner.replace(b"%", b"%25").replace(b"\r", b"%0D").replace(b"\n", b"%0A") + plain(url[at + len(inner) :])


def record(page_id: int | None, url: bytes | str | None, html: bytes | str | None) -> bytes:
    """One WARC record."""
    url, html = (x.encode("utf-8", "surrogatepass") if isinstance(x, str) else x for x in (url, html))
    block = html or b""
    lines = [b"WARC/1.1", b"WARC-Type: resource", b"WARC-Date: 2020-01-01T00:00:00Z", b"Content-Type: text/html"]
    lines.append(b"WARC-Record-ID: <urn:uuid:%s>" % str(uuid.UUID(int=page_id & (1 << 64) - 1)).encode() if page_id is not None else b"WARC-Record-ID: <urn:none>")
    if url is not None:
        bent = url != url.strip() or b"\r" in url or b"\n" in url
        lines.append(b"WARC-Target-URI: " + (escaped(url) if bent else url))
        if bent:
            lines.append(b"X-Escaped: 1")
    if html is None:
        lines.append(b"X-Null: 1")
    lines += [b"WARC-Block-Digest: sha1:" + base64.b32encode(hashlib.sha1(block).digest()), b"Content-Length: %d" % len(block)]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes, level: int = 1) -> bytes:
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def write(pages: DataFrame, folder: str, level: int = 1) -> None:
    """A file for each partition of pages (page_id, url, html). A task writes under its own name and
    renames when it is done, so that attempts that are lost or run twice leave one whole file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        system, base = open_fs(folder)
        part = TaskContext.get().partitionId()
        own, n = f"{base}/.{part:05d}-{uuid.uuid4().hex}", 0
        with system.open_output_stream(own) as out:
            for b in batches:
                for row in zip(*(b.column(k) for k in range(3))):
                    out.write(gzip_member(record(*(x.as_py() for x in row)), level))
                    n += 1
        system.move(own, f"{base}/{part:05d}.warc.gz")
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    system, base = open_fs(folder)
    system.create_dir(base, recursive=True)
    pages.select("page_id", F.col("url").cast("binary"), F.col("html").cast("binary")).mapInArrow(run, "n long").agg({"n": "sum"}).collect()


def inflate(f, at: int) -> tuple[bytes, int] | None:
    """The content of the gzip member at a position and the position after it; None if it's none of a
    WARC record. What isn't one is found after the first block of input."""
    d, out, size, checked = zlib.decompressobj(31), [], 0, False
    f.seek(at)
    try:
        while not d.eof:
            block = f.read(READ if checked else 4096)
            if not block:
                return None
            at += len(block)
            out.append(d.decompress(block))
            size += len(out[-1])
            if not checked and size >= 5:
                if not b"".join(out)[:5] == b"WARC/":
                    return None
                checked = True
    except zlib.error:
        return None
    return (b"".join(out), at - len(d.unused_data)) if checked else None


def parse(data: bytes) -> tuple[dict[bytes, bytes], bytes] | None:
    """Headers by lower-case name and the block; None unless the length and any digest agree."""
    end = data.find(b"\r\n\r\n")
    if end < 0:
        return None
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in data[:end].split(b"\r\n")[1:])}
    length = headers.get(b"content-length", b"")
    block = data[end + 4 :]
    if not length.isdigit() or len(block) < int(length) or block[int(length) :].strip(b"\r\n"):
        return None
    block = block[: int(length)]
    digest = headers.get(b"warc-block-digest", b"")
    if digest.startswith(b"sha1:") and digest[5:] != base64.b32encode(hashlib.sha1(block).digest()):
        return None
    return headers, block


def members(f, start: int, end: int) -> Iterator[tuple[int, dict[bytes, bytes], bytes]]:
    """(position, headers, block) of the records that start in a range of bytes."""
    at = start
    while at < end:
        f.seek(at)
        block = f.read(min(READ, end - at) + len(MAGIC) - 1)
        k = block.find(MAGIC)
        if k < 0 or at + k >= end:
            at += max(1, len(block) - len(MAGIC) + 1) if len(block) >= len(MAGIC) else end - at
            continue
        at += k
        found = inflate(f, at)
        own = parse(found[0]) if found else None
        if own:
            yield at, *own
            at = found[1]
        else:
            at += 1


def splits(spark: SparkSession, folder: str, split_bytes: int) -> DataFrame:
    system, base = open_fs(folder)
    prefix = folder[: -len(base)] if folder.endswith(base) else ""
    files = [(prefix + x.path, x.size) for x in system.get_file_info(fs.FileSelector(base, recursive=True)) if x.type == fs.FileType.File and x.path.endswith(".warc.gz") and not os.path.basename(x.path).startswith(".")]
    rows = [(p, s, min(n, s + split_bytes)) for p, n in sorted(files) for s in range(0, n, split_bytes)]
    out = spark.createDataFrame(rows, "path string, start long, end long")
    return out.repartition(max(1, min(len(rows), 10_000)), "path", "start")


def read(spark: SparkSession, folder: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(path, at, type, record_id, url, payload) of the records of all .warc.gz files under a folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in COLUMNS.split(", ")]
        kinds = [{"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[x.split()[1]] for x in COLUMNS.split(", ")]
        text = lambda x: x if x is None else x.decode("utf-8", "replace")
        for b in batches:
            for path, start, end in zip(*(c.to_pylist() for c in b.columns)):
                system, own = open_fs(path)
                rows, size = [], 0
                with system.open_input_file(own) as f:
                    for at, h, block in members(f, start, end):
                        url = h.get(b"warc-target-uri")
                        if url is not None and h.get(b"x-escaped"):
                            url = unquote_to_bytes(url)
                        rows.append((path, at, text(h.get(b"warc-type")), text(h.get(b"warc-record-id")), url, None if h.get(b"x-null") else block))
                        size += len(block) + len(url or b"")
                        if size > 4_000_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for k, c in zip(kinds, zip(*rows))], names)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for k, c in zip(kinds, zip(*rows))], names)

    found = splits(spark, folder, split_bytes).mapInArrow(run, COLUMNS)
    return found.withColumns({c: F.col(c).cast("string") for c in ("url", "payload")})


def round_trip(pages: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """pages (page_id, url, html) written as WARC files to the shared folder and read again."""
    spark = pages.sparkSession
    folder = shared_dir(spark, "warc")
    write(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html"), folder)
    low = F.conv(F.right(F.regexp_replace(F.regexp_extract("record_id", "<urn:uuid:([0-9a-f-]{36})>", 1), "-", ""), F.lit(16)), 16, -10)
    return read(spark, folder, split_bytes).select(F.when(F.col("record_id").startswith("<urn:uuid:"), low.cast("long")).alias("page_id"), "url", F.col("payload").alias("html"))
