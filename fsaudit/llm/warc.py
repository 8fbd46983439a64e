"""WARC files: an index first, then coalesced byte-range reads of what is selected.

``write`` stores pages as WARC/1.1 response records, each a gzip member of its own. ``index`` walks the files once and writes (file, offset, length, record_id, url, digest) of each record as Parquet
in the shared folder; offset and length are of the compressed member. ``read`` takes selected index rows, sorts those of each file by offset, joins ranges whose gap is at most
``GAP`` bytes into reads of at most ``READ`` bytes (one record at least), and cuts the records out; payloads are held against their digests.

Defined results: null pages columns become empty ones and a null URL stays null in the index; bytes that can't be inflated are one index row (error true; url, digest and record_id null) from where they begin to the next gzip
member that can, from which the index goes on; a member that is inflated but is no record is such a row by itself; a file that can't be opened is one error row with null offset and length; an empty file has no rows. A record
without a payload digest gets the digest of its payload in the index, and is ok when read. A record that is no longer in its file is not ok and has nulls. Rows that are selected twice are read once and returned twice; a null file is left out; empty tables give empty results; other columns are never looked at.

Scale: files are written by tasks under their final name by one atomic rename, so a task that runs again leaves the same file. No file is inflated twice for its index: selections read the index that was written; it has no payloads, so selecting costs
no read; reads are grouped by file and stretch of ``TASK`` bytes, so that one large file is read by many tasks.
"""

from __future__ import annotations

import base64
import hashlib
import mmap
import os
import uuid
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fsaudit.llm import _frames

GAP, READ, TASK, CHUNK = 64 << 10, 8 << 20, 64 << 20, 32 << 10
INDEX = "file string, offset long, length long, record_id string, url string, digest string, error boolean"
RECORDS = "file string, offset long, record_id string, url string, payload binary, digest string, ok boolean"
_INDEX = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("record_id", pa.string()), ("url", pa.string()), ("digest", pa.string()), ("error", pa.bool_())])
_RECORDS = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("record_id", pa.string()), ("url", pa.string()), ("payload", pa.binary()), ("digest", pa.string()), ("ok", pa.bool_())])


def _digest(payload: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(record_id: str, url: str | None, payload: bytes, digest: bool = True) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    head = ["WARC/1.1", "WARC-Type: response", f"WARC-Record-ID: <{record_id}>", "WARC-Date: 2024-01-01T00:00:00Z", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: {_digest(payload)}", f"Content-Length: {len(http) + len(payload)}"]
    if not digest:
        del head[5]
    if url is not None:
        head.insert(3, "WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    return "\r\n".join(head).encode() + b"\r\n\r\n" + http + payload + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[str | None, str | None, str | None, bytes]:
    """(record_id, url, digest, payload) of an inflated record; raises ValueError if it isn't one."""
    head, sep, body = raw.partition(b"\r\n\r\n")
    if not sep or not head.startswith(b"WARC/"):
        raise ValueError("no WARC record")
    named = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])}
    body = body[: int(named.get("content-length", len(body)))]
    payload = body.partition(b"\r\n\r\n")[2] if "application/http" in named.get("content-type", "") else body
    rid = named.get("warc-record-id")
    return rid.strip("<>") if rid else None, named.get("warc-target-uri"), named.get("warc-payload-digest"), payload


def write(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write pages (page_id, url, html) to WARC files of the folder; (file) of each, checkpointed."""
    _frames.bounded_batches(pages.sparkSession)
    path = _frames.local_path(folder or _frames.own_folder(pages.sparkSession, "warc"))
    os.makedirs(path, exist_ok=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f"{path}/part-{TaskContext.get().partitionId():05d}.warc.gz"
        tmp, some = f"{name}.{uuid.uuid4().hex}.partial", False
        with open(tmp, "wb") as f:
            for b in batches:
                for i, u, h in zip(b["page_id"].to_pylist(), b["url"].to_pylist(), b["html"].to_pylist()):
                    z = zlib.compressobj(6, zlib.DEFLATED, 31)
                    f.write(z.compress(record(f"urn:page:{'' if i is None else i}", u, (h or "").encode())) + z.flush())
                    some = True
        os.replace(tmp, name) if some else os.remove(tmp)
        if some:
            yield pa.RecordBatch.from_pydict({"file": [name]})

    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return _frames.keep(own.transform(_frames.mapped, run, "file string"))


def _inflate(m: mmap.mmap, at: int) -> tuple[bytes | None, int]:
    """The gzip member that begins at a place, and where it ends; None if there is no whole one."""
    z, out = zlib.decompressobj(31), []
    try:
        while not z.eof:
            data = m[at : at + CHUNK]
            if not data:
                return None, at
            out.append(z.decompress(data))
            at += len(data) - len(z.unused_data)
    except zlib.error:
        return None, at
    return b"".join(out), at


def _members(m: mmap.mmap) -> Iterator[tuple[int, int, bytes | None]]:
    """(offset, length, inflated) of the gzip members of a mapped file, with None for what lies between those that can be inflated."""
    at = lost = 0
    while at < len(m):
        raw, end = _inflate(m, at)
        if raw is None:
            at = m.find(b"\x1f\x8b\x08", at + 1)
            at = len(m) if at < 0 else at
            continue
        if lost < at:
            yield lost, at - lost, None
        yield at, end - at, raw
        at = lost = end
    if lost < at:
        yield lost, at - lost, None


def _index_rows(name: str) -> Iterator[dict]:
    try:
        with open(name, "rb") as f:
            if not os.fstat(f.fileno()).st_size:
                return
            with mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) as m:
                for offset, length, raw in _members(m):
                    try:
                        rid, url, digest, payload = parse(raw or b"")
                        yield {"file": name, "offset": offset, "length": length, "record_id": rid, "url": url, "digest": digest or _digest(payload), "error": False}
                    except ValueError:
                        yield {"file": name, "offset": offset, "length": length, "error": True}
    except OSError:
        yield {"file": name, "error": True}


def index(files: DataFrame, folder: str | None = None) -> DataFrame:
    """One row per record of the files in column ``file``, written as Parquet to a folder (one of its own in the shared folder by default) and read from there."""
    _frames.bounded_batches(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name in b["file"].to_pylist():
                rows = _index_rows(name)
                while some := list(islice(rows, 10_000)):
                    yield pa.RecordBatch.from_pylist(some, _INDEX)

    # As many tasks as there are files: a task's time goes with its file, not with the row that names it.
    folder = folder or _frames.own_folder(files.sparkSession, "warc-index")
    files = files.select("file").filter("file IS NOT NULL")
    files.repartitionByRange(max(1, files.count()), "file").transform(_frames.mapped, run, INDEX).write.parquet(folder)
    return files.sparkSession.read.parquet(folder)


def ranges(offset: np.ndarray, length: np.ndarray, gap: int = GAP, most: int = READ) -> Iterator[tuple[int, int, int, int]]:
    """(i, j, start, end): the records i..j of sorted offsets are read by one read."""
    i = 0
    while i < len(offset):
        j, end = i + 1, int(offset[i] + length[i])
        while j < len(offset) and offset[j] - end <= gap and offset[j] + length[j] - offset[i] <= most:
            end = max(end, int(offset[j] + length[j]))
            j += 1
        yield i, j, int(offset[i]), end
        i = j


def read(selected: DataFrame, task: int = TASK) -> DataFrame:
    """The records of selected index rows."""
    _frames.bounded_batches(selected.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, span in zip(b["file"].to_pylist(), b["at"].to_pylist()):
                offset, length = np.array([x["offset"] for x in span]), np.array([x["length"] for x in span])
                if not os.path.exists(name):  # it was there when the index was made
                    yield pa.RecordBatch.from_pylist([{"file": name, "offset": x["offset"], "ok": False} for x in span for _ in range(x["n"])], _RECORDS)
                    continue
                with open(name, "rb") as f:
                    for i, j, start, end in ranges(offset, length):
                        f.seek(start)
                        data, rows = f.read(end - start), []
                        for k in range(i, j):
                            try:
                                rid, url, digest, payload = parse(zlib.decompress(data[offset[k] - start : offset[k] - start + length[k]], 31))
                                own = _digest(payload)
                                row = {"record_id": rid, "url": url, "payload": payload, "digest": digest or own, "ok": digest in (None, own)}
                            except (ValueError, zlib.error):
                                row = {"ok": False}
                            rows += [row | {"file": name, "offset": int(offset[k])}] * span[k]["n"]
                        yield pa.RecordBatch.from_pylist(rows, _RECORDS)

    own = selected.filter("NOT error").groupBy("file", "offset", "length").agg(F.count("*").alias("n"))
    own = own.groupBy("file", F.expr(f"offset div {task}").alias("stretch")).agg(F.sort_array(F.collect_list(F.struct("offset", "length", "n"))).alias("at"))
    own = _frames.keep(own)
    # One task per stretch: its rows are few, but stand for up to TASK bytes to read.
    return own.repartitionByRange(max(1, own.count()), "file", "stretch").transform(_frames.mapped, run, RECORDS)


def first_of_digest(entries: DataFrame) -> DataFrame:
    """One index row per payload digest: that with the least page number in its record_id. Rows with errors go."""
    page = F.expr("try_cast(regexp_extract(record_id, 'urn:page:([0-9]+)', 1) AS BIGINT)")
    least = F.min_by(F.struct("file", "offset", "length", "record_id", "url", "error"), F.struct(page.isNull(), page, "file", "offset"))
    return entries.filter("NOT error").groupBy("digest").agg(least.alias("x")).select("x.file", "x.offset", "x.length", "x.record_id", "x.url", "digest", "x.error")


ORACLE = """SELECT page_id, url, CAST(octet_length(encode(html)) AS BIGINT) AS n_bytes, md5(html) AS md5, true AS ok
FROM (SELECT *, row_number() OVER (PARTITION BY html ORDER BY page_id) AS k FROM pages) WHERE k = 1"""
