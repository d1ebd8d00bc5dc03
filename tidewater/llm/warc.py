"""WARC archives through a chunked record table.

A page becomes rows of (record, chunk number, bytes) of at most ``CHUNK`` bytes.
The writer takes those rows as they come and keeps one open record: a gzip
member that grows chunk by chunk and a running SHA-1. The reader streams an
archive the same way and gives the chunk table back, each row with the digest
and the length of the payload up to its end, so a record is whole when its last
row agrees with its header; neither side ever holds a record. Both sides work
on many archives at once: a task writes files of its own, and the manifest lists
segments of about ``SEGMENT_BYTES`` that start at a record, which the reader's
tasks open by offset.

Archives are WARC/1.1, one gzip member a record: a ``warcinfo`` record, then
``response`` records (an HTTP head and the payload) and ``revisit`` records of
the profile identical-payload-digest (the HTTP head alone), which refer to the
response with the smallest page id of all that have the same payload. Payloads
are the same when SHA-256, SHA-1 and length are. Files are written under names
of their own and count only when the manifest, a written table, lists them, so a
task that ran twice or was lost leaves nothing behind that is read.

Defined results: a null html is an empty payload; a null page id comes after all
others (it is a response only if no other id has its payload); rows that share
the smallest page id of a payload are all responses; a null url is left out of
the header; an empty table gives no record; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import urllib.parse
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import read, short_batches
from tidewater.llm.registry import register
from tidewater.operators.common import materialize, salted_join
from tidewater.session import scratch_path

#: Bytes of one row of the chunk table.
CHUNK = 1 << 18
#: Compressed bytes after which a segment, and after which a file, ends.
SEGMENT_BYTES = 32 << 20
FILE_BYTES = 1 << 30
#: Payloads of fewer bytes are all written out.
REVISIT_BYTES = 0
LEVEL = 3
#: The tables give no time of capture.
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

MANIFEST = "path string, start bigint, stop bigint, records bigint"
CHUNKS = ("page_id bigint, record_type string, refers_to bigint, header_digest string, header_bytes bigint, chunk_no bigint, "
          "data binary, bytes_so_far bigint, digest_so_far string, last boolean")


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def open_folder(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder that a session names, and the folder in it."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path)


# ---- pages to chunk rows


def roles(pages: DataFrame, at_least: int = REVISIT_BYTES) -> DataFrame:
    """page_id, url, payload (binary), size, sha1 (hex) and refers_to: null, or
    the page whose response has the same payload."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", payload.alias("payload")).withColumns({
        "size": F.octet_length("payload").cast("bigint"), "sha1": F.sha1("payload"), "sha2": F.sha2("payload", 256)})
    key = ["sha2", "sha1", "size"]
    # written, so that its size is known before the payloads are planned
    shared = materialize(rows.groupBy(*key).agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter(
        (F.col("n") > 1) & (F.col("size") >= at_least)), "warc-shared")
    met = salted_join(rows, shared, key, ["page_id", "url"], how="left", weight="n")
    return met.select("page_id", "url", "payload", "size", "sha1", F.when(
        F.col("page_id").isNull() | (F.col("page_id") > F.col("first")), F.col("first")).alias("refers_to"))


def to_chunks(records: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The chunk rows to write; those of a record stand together, in order. A
    revisit has one, without bytes."""
    whole = records.withColumn("payload", F.when(F.col("refers_to").isNull(), F.col("payload")).otherwise(F.lit(b"")))
    last = F.greatest(F.ceil(F.octet_length("payload") / chunk), F.lit(1)).cast("int") - 1
    rows = whole.withColumn("last_no", last).select("*", F.explode(F.sequence(F.lit(0), F.col("last_no"))).alias("chunk_no"))
    return rows.select("page_id", "url", "size", "sha1", "refers_to", "chunk_no", (F.col("chunk_no") == F.col("last_no")).alias("last"),
                       F.substring("payload", F.col("chunk_no") * chunk + 1, F.lit(chunk)).alias("data"))


# ---- writing


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}:{digest}>"


def page_of(record: str) -> int | None:
    """The page id in a record id."""
    found = record.strip("<>").split(":")[2]
    return int(found) if found else None


def _head(fields: list[tuple[str, object]], block: int) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in [*fields, ("Content-Length", block)])]
    return ("\r\n".join(lines) + "\r\n\r\n").encode()


def _printable(url: str) -> str:
    """A url without what would end its header line or is no ASCII."""
    return urllib.parse.quote(url, safe="".join(chr(c) for c in range(33, 127)))


class _Archives:
    """The files of one task."""

    def __init__(self, folder: str):
        self.fs, self.folder = open_folder(folder)
        self.fs.create_dir(self.folder, recursive=True)
        self.out, self.done = None, []
        self.member, self.at, self.start, self.records = None, 0, 0, 0

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def begin(self, head: bytes) -> None:
        if self.out is None:
            self.name = f"{self.folder}/{uuid.uuid4().hex}.warc.gz"
            self.out, self.at, self.start, self.records = self.fs.open_output_stream(self.name, compression=None), 0, 0, 0
            info = b"format: WARC File Format 1.1\r\n"
            self.begin(_head([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", DATE),
                              ("Content-Type", "application/warc-fields")], len(info)))
            self.add(info)
            self.end()
        self.member = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
        self.add(head)

    def add(self, data) -> None:
        self._write(self.member.compress(data))

    def end(self) -> None:
        self.add(b"\r\n\r\n")
        self._write(self.member.flush())
        self.records += 1
        if self.at >= FILE_BYTES:
            self.close()
        elif self.at - self.start >= SEGMENT_BYTES:
            self._segment()

    def _segment(self) -> None:
        if self.records:
            self.done.append((self.name, self.start, self.at, self.records))
        self.start, self.records = self.at, 0

    def close(self) -> None:
        if self.out is not None:
            self._segment()
            self.out.close()
            self.out = None


def _begin(archives: _Archives, page_id, url, size, sha1, refers_to) -> None:
    digest = base32(bytes.fromhex(sha1))
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    revisit = refers_to is not None
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page_id, digest)), ("WARC-Date", DATE)]
    if url is not None:
        fields.append(("WARC-Target-URI", _printable(url)))
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, digest))]
    fields += [("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http;msgtype=response")]
    archives.begin(_head(fields, len(http) + (0 if revisit else size)) + http)


def _write_rows(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    archives = _Archives(folder)
    for b in batches:
        data = b.column("data")
        cols = [b.column(c).to_pylist() for c in ("page_id", "url", "size", "sha1", "refers_to", "chunk_no", "last")]
        for i, (page_id, url, size, sha1, refers_to, chunk_no, last) in enumerate(zip(*cols, strict=True)):
            if chunk_no == 0:
                _begin(archives, page_id, url, size, sha1, refers_to)
                hashed = hashlib.sha1()
            piece = data[i].as_buffer()
            hashed.update(piece)
            archives.add(piece)
            if last:
                if refers_to is None and hashed.hexdigest() != sha1:
                    raise ValueError(f"page {page_id}: the chunks are not its payload")
                archives.end()
    archives.close()
    rows = list(zip(*archives.done, strict=True)) or [[], [], [], []]
    yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.string()), *[pa.array(r, pa.int64()) for r in rows[1:]]],
                                     names=["path", "start", "stop", "records"])


def write_archives(pages: DataFrame, folder: str | None = None, at_least: int = REVISIT_BYTES, chunk: int = CHUNK) -> DataFrame:
    """Write the pages as archives below ``folder`` (one that all machines
    share; a fresh one in the checkpoint folder if not given) and return the
    manifest: path, start, stop, records of each segment."""
    short_batches(pages.sparkSession)
    folder = folder or scratch_path(pages.sparkSession, "warc")
    rows = to_chunks(roles(pages, at_least), chunk)
    return materialize(rows.mapInArrow(lambda b: _write_rows(b, folder), MANIFEST), "warc-manifest")


# ---- reading


class _Stream:
    """Bytes of the gzip members between two offsets of a file, a piece at a
    time."""

    PIECE = 1 << 17

    def __init__(self, file, start: int, stop: int):
        self.file, self.left = file, stop - start
        file.seek(start)
        self.member, self.raw, self.held = zlib.decompressobj(31), b"", b""

    def _more(self) -> bool:
        """Decompress one piece more; false at the end of the segment."""
        while True:
            if self.member.eof:
                self.raw, self.member = self.member.unused_data, zlib.decompressobj(31)
            elif not self.raw:
                self.raw = self.member.unconsumed_tail
            if not self.raw and self.left:
                self.raw = self.file.read(min(self.PIECE, self.left))
                if not self.raw:
                    raise EOFError("the archive ends inside a segment")
                self.left -= len(self.raw)
            if not self.raw:
                return False
            got = self.member.decompress(self.raw, self.PIECE)
            self.raw = b""
            if got:
                self.held += got
                return True

    def read(self, n: int) -> bytes:
        """Exactly ``n`` bytes."""
        parts, missing = [], n
        while missing:
            if not self.held and not self._more():
                raise EOFError("a record ends too early")
            parts.append(self.held[:missing])
            self.held = self.held[missing:]
            missing -= len(parts[-1])
        return b"".join(parts)

    def head(self) -> list[str] | None:
        """Lines up to an empty one; none at the end of the segment."""
        while (end := self.held.find(b"\r\n\r\n")) < 0:
            if not self._more():
                if self.held:
                    raise EOFError("a header ends too early")
                return None
        lines, self.held = self.held[:end].decode().split("\r\n"), self.held[end + 4:]
        return lines


def _fields(lines: list[str]) -> dict[str, str]:
    return {k.lower(): v for k, v in (x.split(": ", 1) for x in lines[1:])}


def _chunks_of(stream: _Stream, chunk: int) -> Iterator[tuple]:
    """The chunk rows of every page record of a segment."""
    while (lines := stream.head()) is not None:
        warc = _fields(lines)
        block, kind = int(warc["content-length"]), warc["warc-type"]
        if kind in ("response", "revisit"):
            http = stream.head()
            size = block - sum(len(x.encode()) + 2 for x in http) - 2
            digest = warc["warc-payload-digest"].removeprefix("sha1:")
            told = int(_fields(http)["content-length"])
            page = page_of(warc["warc-record-id"])
            refers = page_of(warc["warc-refers-to"]) if kind == "revisit" else None
            hashed, done, no = hashlib.sha1(), 0, 0
            while True:
                data = stream.read(min(chunk, size - done))
                hashed.update(data)
                done += len(data)
                yield page, kind, refers, digest, told, no, data, done, base32(hashed.digest()), done == size
                no += 1
                if done == size:
                    break
            if kind == "response" and (base32(hashed.digest()), done) != (digest, told):
                raise ValueError(f"page {page}: the payload does not have the digest in its header")
        else:
            left = block
            while left:
                left -= len(stream.read(min(chunk, left)))
        if stream.read(4) != b"\r\n\r\n":
            raise ValueError("a record does not end where its length says")


def _read_rows(batches: Iterator[pa.RecordBatch], chunk: int, with_data: bool) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in CHUNKS.split(", ")]
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.bool_()]

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    for b in batches:
        for path, start, stop in zip(*(b.column(c).to_pylist() for c in ("path", "start", "stop")), strict=True):
            folder, _, name = path.rpartition("/")
            system, root = open_folder(folder)
            with system.open_input_file(f"{root}/{name}") as file:
                rows, held = [], 0
                for row in _chunks_of(_Stream(file, start, stop), chunk):
                    held += len(row[6]) + 200 if with_data else 200
                    rows.append(row if with_data else (*row[:6], None, *row[7:]))
                    if held >= 8 << 20:
                        yield batch(rows)
                        rows, held = [], 0
                if rows:
                    yield batch(rows)


def read_chunks(spark: SparkSession, manifest: DataFrame, with_data: bool = True, chunk: int = CHUNK) -> DataFrame:
    """The chunk table of the archives that a manifest lists: page_id,
    record_type, refers_to, chunk_no, data (null without
    ``with_data``), bytes_so_far, digest_so_far and last, with the digest and the
    length in the header. A payload that differs
    from its header is an error."""
    segments = max(1, manifest.count())
    return manifest.repartition(segments).mapInArrow(lambda b: _read_rows(b, chunk, with_data), CHUNKS)


def records(chunks: DataFrame) -> DataFrame:
    """One row for each record: page_id, payload_bytes, payload_digest,
    record_type, refers_to. Those of a response are what its chunks came to; a
    revisit's are in its headers, which hold the length and the digest of the
    payload it refers to."""
    whole = F.col("record_type") == "response"
    return chunks.filter("last").select(
        "page_id", F.when(whole, F.col("bytes_so_far")).otherwise(F.col("header_bytes")).alias("payload_bytes"),
        F.when(whole, F.col("digest_so_far")).otherwise(F.col("header_digest")).alias("payload_digest"), "record_type", "refers_to")


def dangling(chunks: DataFrame) -> DataFrame:
    """Revisits (page_id, refers_to) whose response is not in the archives, or
    has another payload than they say."""
    ends = chunks.filter("last")
    there = ends.filter("record_type = 'response'").select(
        F.col("page_id").alias("refers_to"), F.col("digest_so_far").alias("header_digest"), F.col("bytes_so_far").alias("header_bytes"))
    wanted = ends.filter("record_type = 'revisit'")
    key = ["refers_to", "header_digest", "header_bytes"]
    lost = wanted.select(*key).distinct().join(there, key, "left_anti")
    return wanted.join(lost, key, "left_semi").select("page_id", "refers_to")


_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
SQL = f"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, MIN(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages),
d AS (
  SELECT *, list_transform(range(0, 8), lambda i: CAST('0x' || substr(sha1(html), CAST(5 * i + 1 AS INT), 5) AS INT)) AS v FROM p)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(v, lambda x: substr('{_LETTERS}', (x >> 15) % 32 + 1, 1) || substr('{_LETTERS}', (x >> 10) % 32 + 1, 1)
         || substr('{_LETTERS}', (x >> 5) % 32 + 1, 1) || substr('{_LETTERS}', x % 32 + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id > first OR (page_id IS NULL AND first IS NOT NULL) THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id > first OR page_id IS NULL THEN first END AS refers_to
FROM d
"""


@register("op12_warc", SQL)
def op12_warc(spark, sf_dir):
    """Every page written to archives and read back."""
    manifest = write_archives(read(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return records(read_chunks(spark, manifest, with_data=False))
