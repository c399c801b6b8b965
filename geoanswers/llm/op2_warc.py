"""WARC archives: a writer that marks repeated payloads as revisits, and a splittable reader.

Each record is a gzip member of its own, so a reader can start anywhere: a task gets a byte range, looks for gzip magic
from its start, takes a candidate as a member when it decodes to a WARC version line with a parsable header (read to its
end, however long), and then follows member after member; it owns the records that start inside its range and reads past the end to finish the last.

Archives go to a folder that all executors share, through pyarrow's file systems. A task writes a file of a fresh name
and reports it as a row; only the files of tasks that succeeded are in the manifest, so lost executors and second attempts
leave nothing that is read.

Defined results: a null html is an empty payload; equal payloads (of ``least_bytes`` or more) refer to the smallest
page_id; rows that repeat that page_id are responses too; rows with a null page_id and no non-null twin are responses;
a null url has no target header; characters that a header can't hold are percent-encoded in the url; an empty table
gives no files and no rows; other columns are ignored. Payloads are text, so gzip magic never stands inside a stored one.
"""

from __future__ import annotations

import base64
import hashlib
import urllib.parse
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geoanswers.llm import common

MAGIC = b"\x1f\x8b\x08"
#: Bytes of a range, and of one read.
RANGE, READ = 8 << 20, 1 << 18
_VERSION = b"WARC/"
_EDGE = b"\r\n\r\n"
_URL_SAFE = "".join(chr(c) for c in range(33, 127))


def _file_system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One gzip member: a response, or a revisit of refers_to that keeps the HTTP header (so the payload's length)."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 2024-01-01T00:00:00Z"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {urllib.parse.quote(url, safe=_URL_SAFE)}")
    lines.append(f"WARC-Payload-Digest: sha1:{digest(payload)}")
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress("\r\n".join(lines).encode() + _EDGE + block + _EDGE) + squeeze.flush()


def _written(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _file_system(folder)
        path = f"{root}/{uuid.uuid4().hex}.warc.gz"
        out, size, count = None, 0, 0
        for batch in batches:
            for page_id, url, html, refers in zip(*(batch.column(c) for c in ("page_id", "url", "html", "refers_to"))):
                member = record(page_id.as_py(), url.as_py(), (html.as_py() or "").encode(), refers.as_py())
                out = out or fs.open_output_stream(path, compression=None)
                out.write(member)
                size, count = size + len(member), count + 1
        if out:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "bytes": [size], "records": [count]})

    return run


def write_warc(pages: DataFrame, folder: str, least_bytes: int = 0) -> DataFrame:
    """Write the pages (page_id, url, html) and return the manifest (path, bytes, records), already written too.

    Only ids and digests are gathered by payload; pages meet their mark by id, so a payload that very many pages share
    is no large task and no large archive."""
    fs, root = _file_system(folder)
    fs.create_dir(root)
    html = F.col("html").cast("string")
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"), F.sha1(F.coalesce(html, F.lit(""))).alias("sha1"))
    slim = base.filter(F.octet_length(F.coalesce("html", F.lit(""))) >= least_bytes).select("page_id", "sha1")
    first = slim.groupBy("sha1").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1 and first is not null").select("sha1", "first")
    # written, so that the join's skewed side can be split
    again = slim.join(common.stored(first, "first"), "sha1").filter(~F.col("page_id").eqNullSafe(F.col("first"))).distinct()
    marks = again.select(F.col("page_id").alias("_id"), F.col("sha1").alias("_sha1"), F.col("first").alias("refers_to"))
    marked = base.join(marks, F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("sha1") == F.col("_sha1")), "left")
    return common.stored(marked.select("page_id", "url", "html", "refers_to").mapInArrow(_written(folder), "path string, bytes long, records long"), "manifest")


class _Bytes:
    """Forward reading of a file from an offset, with what was read kept until it is passed."""

    def __init__(self, handle, at: int):
        self.handle, self.at, self.kept, self.done = handle, at, bytearray(), False
        handle.seek(at)

    def more(self) -> bool:
        new = b"" if self.done else self.handle.read(READ)
        self.done = not new
        self.kept += new
        return bool(new)

    def skip(self, n: int) -> None:
        del self.kept[:n]
        self.at += n


def _headers(block: bytes) -> dict[str, str]:
    lines = block.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in lines[1:] if ":" in x)}


def _is_head(head: bytes) -> bool:
    """Whether the header of a record can be parsed: it names a type and a length."""
    h = _headers(head)
    return head.startswith(_VERSION) and "warc-type" in h and h.get("content-length", "").isdigit()


def _record(data: _Bytes) -> tuple[bytes, int] | None:
    """The record of the gzip member at the current place and the member's length; None where there is none. The
    version line is looked at as soon as it is decoded and the header as soon as it ends, however long it is."""
    unzip = zlib.decompressobj(31)
    out, fed, known = bytearray(), 0, False
    try:
        while not unzip.eof:
            if fed == len(data.kept) and not data.more():
                return None
            piece = bytes(data.kept[fed : fed + (READ if known else 4096)])
            searched = max(0, len(out) - len(_EDGE))
            out += unzip.decompress(piece)
            fed += len(piece)
            if not known:
                if not out.startswith(_VERSION[: len(out)]):
                    return None
                end = out.find(_EDGE, searched)
                known = end >= 0
                if known and not _is_head(bytes(out[:end])):
                    return None
    except zlib.error:
        return None
    return (bytes(out), fed - len(unzip.unused_data)) if known else None


def members(handle, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(offset, record) of the members that start in [start, end)."""
    data = _Bytes(handle, start)
    while data.at < end:
        at = data.kept.find(MAGIC)
        if at < 0:
            data.skip(max(0, len(data.kept) - len(MAGIC) + 1))
            if not data.more():
                return
            continue
        data.skip(at)
        if data.at >= end:
            return
        found = _record(data)
        if found is None:
            data.skip(1)
            continue
        yield data.at, found[0]
        data.skip(found[1])


def parsed(member: bytes) -> dict:
    """What a decoded record says, whoever wrote it. The payload of an HTTP block is what follows its header, of other
    blocks all of it, of revisits null. A revisit's length and digest are those it states, else null."""
    head, _, rest = member.partition(_EDGE)
    h = _headers(head)
    block = rest[: int(h["content-length"])]
    http, _, body = block.partition(_EDGE)
    is_http = h.get("content-type", "").lower().replace(" ", "").startswith("application/http") and http.startswith(b"HTTP/")
    payload = body if is_http else block
    revisit = h["warc-type"].lower() == "revisit"
    stated = _headers(http).get("content-length", "") if is_http else ""
    said = h.get("warc-payload-digest", "")
    return {
        "record_id": h.get("warc-record-id"), "record_type": h["warc-type"].lower(), "target_uri": h.get("warc-target-uri"), "refers_to": h.get("warc-refers-to"),
        "payload_bytes": (int(stated) if stated.isdigit() else None) if revisit else len(payload),
        "payload_digest": (said.split(":", 1)[-1] or None) if revisit else digest(payload), "payload": None if revisit else payload,
    }


_SCHEMA = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()), ("refers_to", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])


def _read(folder: str, with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = _file_system(folder)
        for batch in batches:
            for path, start, end in zip(*(batch.column(c).to_pylist() for c in ("path", "start", "end"))):
                rows, size = [], 0
                with fs.open_input_file(path) as handle:
                    for _, member in members(handle, start, end):
                        row = parsed(member)
                        size += 200 + (len(row["payload"] or b"") if with_payload else 0)
                        rows.append(row if with_payload else row | {"payload": None})
                        if size > 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, _SCHEMA)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, _SCHEMA)

    return run


def read_warc(manifest: DataFrame, folder: str, range_bytes: int = RANGE, with_payload: bool = True) -> DataFrame:
    """The records of the manifest's archives, a task for each few byte ranges: record_id, record_type, target_uri,
    refers_to, payload_bytes, payload_digest, payload. The archives (path, bytes) may be anyone's."""
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(range_bytes).cast("long")))
    ranges = manifest.filter("bytes > 0").select("path", "bytes", starts.alias("start")).select("path", "start", F.least(F.col("start") + range_bytes, F.col("bytes")).alias("end"))
    n = manifest.agg(F.sum(F.ceil(F.col("bytes") / range_bytes))).first()[0] or 1
    schema = "record_id string, record_type string, target_uri string, refers_to string, payload_bytes long, payload_digest string, payload binary"
    return ranges.repartition(max(1, int(n)), "path", "start").mapInArrow(_read(folder, with_payload), schema)


def page_of(record_id: str) -> Column:
    """The page_id in a record id of ``write_warc``; null for those of others."""
    return F.regexp_extract(record_id, r"^<urn:page:(-?[0-9]+)>$", 1).try_cast("long")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{common.shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    manifest = write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"), folder)
    records = read_warc(manifest, folder, with_payload=False)
    return records.select(page_of("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page_of("refers_to").alias("refers_to"))


QUERIES = {"op2_warc": op2_warc}
ORACLES: dict[str, str] = {}
