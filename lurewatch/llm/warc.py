"""WARC archives: one gzip member per record, written and read as streams.

Writing: payload digests come first and elect, per distinct payload, the page with the largest id; that page gets a
``response`` record, pages with the same payload get ``revisit`` records that refer to it and carry no body. Each
task writes the files of its rows into the shared folder, under names that no other attempt uses, and returns a manifest row
per finished file; the manifest is stored by Spark, so files of lost or repeated attempts are simply not listed.

Reading: a task opens a listed file as a stream and goes through it member by member with incremental zlib
decompression, so it holds a chunk and one record at a time. The header block ends at the first empty line, the
content length frames the block, and the block and payload digests are verified. Anything that does not fit raises
``WarcError`` with file and offset.

Edge cases: a null payload is an empty one; empty payloads equal each other like any others. Rows that repeat
the elected id with the same payload are all responses; a null id is elected only if all ids of its payload are null,
and then they are responses. A url that is null or holds spaces or control characters is percent-encoded or
replaced by ``urn:page:ID``. Extra columns are ignored; an empty table gives no files and an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, functions as F

from lurewatch.llm.common import materialize, shared_path, string_of

FILE_BYTES = 256 << 20
CHUNK = 1 << 18
LEVEL = 6
_DATE = "1970-01-01T00:00:00Z"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


class WarcError(ValueError):
    """An archive that does not follow the format or fails a digest."""


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _target(url: str | None, page_id: int | None) -> str:
    if not url:
        return record_id(page_id)[1:-1]
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def make_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One record, compressed as a gzip member of its own."""
    http = _HTTP % len(payload)
    block = http if revisit else http + payload
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page_id)),
              ("WARC-Date", _DATE), ("WARC-Target-URI", _target(url, page_id)),
              ("WARC-Payload-Digest", f"sha1:{base32_sha1(payload)}"), ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}")]
    if revisit:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                   ("WARC-Refers-To", record_id(refers_to))]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(head.encode() + block + b"\r\n\r\n") + packer.flush()


class Record(NamedTuple):
    """One record as read: its headers, its HTTP payload (of a revisit: none) and its payload's full length."""

    headers: dict[str, str]
    payload: bytes
    payload_bytes: int
    offset: int


def members(stream, chunk: int = CHUNK) -> Iterator[tuple[int, bytes]]:
    """(offset, content) of each gzip member of a stream, read front to back."""
    offset, data = 0, b""
    while True:
        if not data:
            data = stream.read(chunk)
            if not data:
                return
        unpacker, parts, start = zlib.decompressobj(31), [], offset
        while not unpacker.eof:
            if not data:
                data = stream.read(chunk)
                if not data:
                    raise WarcError(f"member at {start} is cut short")
            try:
                parts.append(unpacker.decompress(data))
            except zlib.error as e:
                raise WarcError(f"member at {start}: {e}") from e
            offset += len(data) - len(unpacker.unused_data)
            data = unpacker.unused_data
        yield start, b"".join(parts)


def parse(content: bytes, offset: int = 0) -> Record:
    """A record from one member's content, framed by its content length and with both digests verified."""
    end = content.find(b"\r\n\r\n")
    version, *lines = content[:max(end, 0)].decode("utf-8", "replace").split("\r\n")
    if end < 0 or not version.startswith("WARC/"):
        raise WarcError(f"no record header at {offset}")
    headers = {}
    for line in lines:
        name, colon, value = line.partition(":")
        if not colon:
            raise WarcError(f"broken header line at {offset}")
        headers[name.strip().lower()] = value.strip()
    length = headers.get("content-length", "")
    if not length.isdigit() or content[end + 4 + int(length):] != b"\r\n\r\n":
        raise WarcError(f"content length of the record at {offset} does not frame it")
    block = content[end + 4:end + 4 + int(length)]
    if headers.get("warc-block-digest") != f"sha1:{base32_sha1(block)}":
        raise WarcError(f"block digest of the record at {offset} differs")
    http, _, payload = block.partition(b"\r\n\r\n")
    full = re.search(rb"(?im)^content-length:\s*(\d+)\s*$", http.replace(b"\r", b""))
    size = int(full[1]) if full else len(payload)
    if headers.get("warc-type") == "response" and (
            size != len(payload) or headers.get("warc-payload-digest") != f"sha1:{base32_sha1(payload)}"):
        raise WarcError(f"payload of the record at {offset} differs from its digest or length")
    return Record(headers, payload, size, offset)


def read_records(stream) -> Iterator[Record]:
    for offset, content in members(stream):
        yield parse(content, offset)


def _filesystem(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def elected(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, html, revisit, refers_to: which record every page gets."""
    df = pages.select(F.col(f"`{page_id}`").cast("long").alias("page_id"), F.col(f"`{url}`").alias("url"),
                      string_of(f"`{html}`").alias("html"))
    body = F.encode("html", "UTF-8")
    leaders = df.select("page_id", F.sha1(body).alias("_digest"), F.octet_length("html").alias("_size")).groupBy(
        "_digest", "_size").agg(F.max("page_id").alias("_leader"))
    leaders = materialize(leaders, "warc-leaders")
    df = df.withColumns({"_digest": F.sha1(body), "_size": F.octet_length("html")})
    revisit = ~F.col("page_id").eqNullSafe(F.col("_leader"))
    return df.join(leaders, ["_digest", "_size"]).select(
        "page_id", "url", "html", revisit.alias("revisit"), F.when(revisit, F.col("_leader")).alias("refers_to"))


def _writer(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _filesystem(folder)
        out, path, size, n, done = None, "", 0, 0, []
        for batch in batches:
            for row in zip(*(batch.column(c) for c in ("page_id", "url", "html", "refers_to", "revisit"))):
                page_id, url, html, refers_to, revisit = (v.as_py() for v in row)
                if out is None:
                    path, size, n = f"{base}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    system.create_dir(base, recursive=True)
                    out = system.open_output_stream(path, compression=None)
                record = make_record(page_id, url, html.encode(), refers_to, revisit)
                out.write(record)
                size, n = size + len(record), n + 1
                if size >= FILE_BYTES:
                    out.close()
                    done.append((path, size, n))
                    out = None
        if out is not None:
            out.close()
            done.append((path, size, n))
        yield pa.RecordBatch.from_pylist(
            [{"file": f"{folder}/{p.rpartition('/')[2]}", "bytes": s, "records": n} for p, s, n in done],
            schema=pa.schema([("file", pa.string()), ("bytes", pa.int64()), ("records", pa.int64())]))

    return run


def write_archives(rows: DataFrame, folder: str) -> DataFrame:
    """Write ``elected`` rows to ``folder``; file, bytes, records of every archive. Storing the manifest is what
    commits the files, so it is written before it is returned."""
    written = rows.select("page_id", "url", "html", "refers_to", "revisit").mapInArrow(
        _writer(folder), "file string, bytes long, records long")
    return materialize(written, "warc-manifest")


def _page_of(identifier: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", identifier or "")
    return int(found[1]) if found else None


_READ = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("page_id", pa.int64()), ("record_type", pa.string()),
                   ("target_uri", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                   ("refers_to", pa.int64()), ("payload", pa.binary())])


def _reader(with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, records in zip(batch.column("file").to_pylist(), batch.column("records").to_pylist()):
                system, path = _filesystem(file)
                rows, held, n = [], 0, 0
                with system.open_input_stream(path, compression=None) as stream:
                    for r in read_records(stream):
                        h = r.headers
                        rows.append({"file": file, "offset": r.offset, "page_id": _page_of(h.get("warc-record-id")),
                                     "record_type": h.get("warc-type"), "target_uri": h.get("warc-target-uri"),
                                     "payload_bytes": r.payload_bytes,
                                     "payload_digest": h.get("warc-payload-digest", "").removeprefix("sha1:"),
                                     "refers_to": _page_of(h.get("warc-refers-to")),
                                     "payload": r.payload if with_payload else None})
                        n += 1
                        held += len(r.payload) if with_payload else 300
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema=_READ)
                            rows, held = [], 0
                if n != records:
                    raise WarcError(f"{file} holds {n} records, its manifest says {records}")
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=_READ)

    return run


def read_archives(manifest: DataFrame, with_payload: bool = True) -> DataFrame:
    """One row per record of the listed archives, in file order within a file; digests are verified on the way."""
    parts = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    types = {pa.string(): "string", pa.int64(): "long", pa.binary(): "binary"}
    schema = ", ".join(f"{f.name} {types[f.type]}" for f in _READ)
    return manifest.select("file", "records").repartition(parts, "file").mapInArrow(_reader(with_payload), schema)


def archive(pages: DataFrame) -> DataFrame:
    """Write every page to archives in the shared folder and return their manifest."""
    return write_archives(elected(pages), shared_path(pages.sparkSession, "warc"))
