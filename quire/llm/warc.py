"""WARC archives: deduplicating writer and sequential reader.

Every page is a record of its own gzip member. Of pages with equal payloads of
at least ``MIN_REVISIT`` bytes, the one with the smallest page_id is a
``response`` record and the others are ``revisit`` records that refer to it;
a revisit keeps the HTTP header with the payload's length but not the payload.
A task writes one archive under a name of its own attempt; only archives named
in the stored manifest are read, so a lost executor leaves no trace.

The reader takes an archive from front to back in chunks: zlib decompresses
incrementally, a member's end is where the decompressor ends, the block is cut
by Content-Length, and block and payload digests are verified.

Defined results: null html counts as empty; smaller payloads are all
responses; rows that share the smallest page_id of a payload are responses
each; a null page_id is never the smallest (where a payload has no other, its
rows are responses each); an empty table gives no archives and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, new_folder, open_fs

MIN_REVISIT = 100
CHUNK = 1 << 20                       # bytes read at once
LEVEL = 4
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
STAMP = "2000-01-01T00:00:00Z"        # fixed, so that archives of equal pages are equal


def _member(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = [("WARC-Type", kind), ("WARC-Date", STAMP), *headers,
            ("WARC-Block-Digest", "sha256:" + hashlib.sha256(block).hexdigest()), ("Content-Length", str(len(block)))]
    record = b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(record) + z.flush()


def _uri(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes | None, size: int, digest: str,
           refers_to: int | None, revisit: bool) -> bytes:
    """One gzip member: a response with its payload, or a revisit without."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    url = "" if url is None else "".join(url.split("\n")).replace("\r", "")
    headers = [("WARC-Record-ID", _uri(page_id)), ("WARC-Target-URI", url),
               ("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    if revisit:
        return _member("revisit", [*headers, ("WARC-Profile", PROFILE), ("WARC-Refers-To", _uri(refers_to))], http)
    return _member("response", headers, http + (payload or b""))


def write(pages: DataFrame, folder: str | None = None, min_revisit: int = MIN_REVISIT) -> str:
    """Write all ``pages`` (page_id, url, html) as archives; returns the folder with its manifest."""
    spark = pages.sparkSession
    folder = folder or new_folder(spark, "warc")
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    first = (rows.where(F.octet_length("payload") >= min_revisit).groupBy("digest")
             .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first"))
    marked = rows.join(first, "digest", "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    marked = marked.select(
        "page_id", "url", F.when(~revisit, F.col("payload")).alias("payload"), F.octet_length("payload").alias("size"),
        "digest", revisit.alias("revisit"), F.when(revisit, F.col("first")).alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, out, n = f"pages-{uuid.uuid4().hex}.warc.gz", None, 0
        for b in batches:
            for r in zip(*(column(b, k).to_pylist() for k in
                           ("page_id", "url", "payload", "size", "digest", "refers_to", "revisit")), strict=True):
                if out is None:
                    files, top = open_fs(folder)
                    out = files.open_output_stream(f"{top}/{name}")
                    out.write(_member("warcinfo", [("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"),
                                                   ("Content-Type", "application/warc-fields")], b"format: WARC/1.1\r\n"))
                out.write(record(*r))
                n += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], names=["file", "n"])

    marked.mapInArrow(run, "file string, n long").write.parquet(f"{folder}/manifest")
    return folder


class BadRecord(ValueError):
    """A record that is cut off, not framed as its header says, or fails a digest."""


def _digest_is(header: str | None, data: bytes) -> bool:
    if not header:
        return True
    kind, _, value = header.partition(":")
    if kind.lower() not in ("sha1", "sha256", "md5"):
        return True                                        # of a kind that can't be checked
    d = hashlib.new(kind.lower(), data)
    return value.lower() == d.hexdigest() or value.upper().rstrip("=") == base64.b32encode(d.digest()).decode().rstrip("=")


def members(stream, chunk: int = CHUNK) -> Iterator[bytes]:
    """The content of each gzip member of a stream, read from front to back."""
    z, parts, data = zlib.decompressobj(31), [], b""
    while True:
        if not data:
            data = stream.read(chunk)
            if not data:
                break
        parts.append(z.decompress(data, chunk))
        data = z.unconsumed_tail
        if z.eof:
            yield b"".join(parts)
            data = z.unused_data
            z, parts = zlib.decompressobj(31), []
    if any(parts):
        raise BadRecord("the archive ends inside a gzip member")


def records(stream, chunk: int = CHUNK) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers with lower-case names, block) of every record, framing and digests checked."""
    for m in members(stream, chunk):
        head, sep, rest = m.partition(b"\r\n\r\n")
        lines = head.decode("utf-8").split("\r\n")
        if not sep or not lines[0].startswith("WARC/"):
            raise BadRecord("no WARC header")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        n = int(headers.get("content-length", -1))
        block, tail = rest[:n], rest[n:]
        if n < 0 or len(block) != n or tail != b"\r\n\r\n":
            raise BadRecord("the block is not as long as Content-Length says")
        if not _digest_is(headers.get("warc-block-digest"), block):
            raise BadRecord("wrong block digest")
        if headers["warc-type"] == "response" and not _digest_is(headers.get("warc-payload-digest"),
                                                                  block.partition(b"\r\n\r\n")[2]):
            raise BadRecord("wrong payload digest")
        yield headers, block


def _page(uri: str | None) -> int | None:
    x = (uri or "").removeprefix("<urn:page:").removesuffix(">")
    return int(x) if x else None


def read(spark: SparkSession, folder: str, with_payload: bool = False) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to per
    page record of the folder's archives (and payload, null for revisits). An
    archive is read by one task."""
    files = spark.read.parquet(f"{folder}/manifest").select("file")
    files = files.repartition(max(1, spark.sparkContext.defaultParallelism * 4))
    schema = ("page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
              + (", payload binary" if with_payload else ""))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in schema.split(", ")]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        for b in batches:
            for name in column(b, "file").to_pylist():
                fs, path = open_fs(folder)
                rows, size = [], 0
                with fs.open_input_stream(f"{path}/{name}") as f:
                    for h, block in records(f):
                        if h["warc-type"] not in ("response", "revisit"):
                            continue
                        http, _, payload = block.partition(b"\r\n\r\n")
                        n = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
                        if h["warc-type"] == "response" and n != len(payload):
                            raise BadRecord("the payload is not as long as its HTTP header says")
                        r = [_page(h["warc-record-id"]), h["warc-target-uri"], n, h["warc-payload-digest"].partition(":")[2],
                             h["warc-type"], _page(h.get("warc-refers-to"))]
                        rows.append([*r, payload if h["warc-type"] == "response" else None] if with_payload else r)
                        size += len(block)
                        if size > 32 << 20 or len(rows) == 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds)],
                                                             names=names)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds)], names=names)

    return files.mapInArrow(run, schema)
