"""WARC archives compressed record by record with a Zstandard dictionary built from the records.

An archive is a skippable frame holding the dictionary, then one Zstandard frame per WARC record,
so a record can be read alone.  Payloads seen before are written as ``revisit`` records.  Tasks
write archives of a bounded size under names of their own, and only archives named in the
manifest (rows of tasks that ended well) count; a task that is run again leaves no half archive
behind that a reader would see.

Nulls: a null html is an empty payload, a null url an empty target, a null page_id stays null and
is never referred to.  Rows equal in page_id and payload are all responses where one is.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard as zstd
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged, workspace

SKIPPABLE = 0x184D2A5D
#: Dictionary: at most so many sample records of at most so many bytes, and its own size.
SAMPLES, SAMPLE_BYTES, DICT_BYTES = 400, 8192, 32 << 10
ARCHIVE_BYTES = 64 << 20
LEVEL = 3
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
ID_PREFIX = "urn:x-page:"
RECORD_SCHEMA = ("page_id long, payload_bytes long, payload_digest string, record_type string, "
                 "refers_to long, target_uri string, payload binary")
MANIFEST_SCHEMA = "path string, records long, bytes long"


def roles(pages: DataFrame, min_bytes: int = 1000) -> DataFrame:
    """page_id, url, html with payload_bytes, payload_digest, refers_to (null: a response)."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html",
                        F.octet_length(payload).cast("long").alias("payload_bytes"),
                        F.sha1(payload).alias("payload_digest"))
    heads = (rows.filter(F.col("payload_bytes") >= min_bytes)
             .groupBy(F.col("payload_digest").alias("h_digest"))
             .agg(F.max("page_id").alias("head"), F.count("*").alias("n"))
             .filter("n > 1").select("h_digest", "head"))
    other = F.col("head").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("head"))
    return (rows.join(heads, (F.col("payload_digest") == F.col("h_digest"))
                      & (F.col("payload_bytes") >= min_bytes), "left")
            .select(*rows.columns, F.when(other, F.col("head")).alias("refers_to")))


def dictionary(pages: DataFrame) -> bytes:
    """A dictionary from the ``SAMPLES`` records of least hash among those of fitting size."""
    hashed = F.xxhash64(F.col("page_id"), F.lit("dictionary"))
    fit = pages.filter(F.octet_length("html").between(64, SAMPLE_BYTES)).select("html", hashed.alias("h"))
    lowest = [r.h for r in fit.select("h").orderBy("h").limit(SAMPLES).collect()]
    if not lowest:
        return HTTP_HEAD
    rows = fit.filter(F.col("h") <= lowest[-1]).limit(2 * SAMPLES).collect()
    samples = [record_bytes(i, "http://sample/", r.html.encode(), "response", None,
                            hashlib.sha1(r.html.encode()).hexdigest()) for i, r in enumerate(rows)]
    try:
        return zstd.train_dictionary(DICT_BYTES, samples).as_bytes()
    except zstd.ZstdError:  # too little to train on: the records themselves are the dictionary
        return b"".join(samples)[-DICT_BYTES:]


def _loaded(data: bytes) -> zstd.ZstdCompressionDict:
    return zstd.ZstdCompressionDict(data)


def record_bytes(page_id: int | None, url: str, payload: bytes, kind: str, refers: int | None,
                 digest: str) -> bytes:
    """One WARC record, uncompressed."""
    name = "" if page_id is None else page_id
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    body = HTTP_HEAD + (payload if kind == "response" else b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{ID_PREFIX}{name}>",
            f"WARC-Target-URI: {target}", "WARC-Date: 1970-01-01T00:00:00Z",
            "WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)).decode(),
            f"X-Payload-Length: {len(payload)}",
            "Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    if kind == "revisit":
        head += [f"WARC-Refers-To: <{ID_PREFIX}{refers}>", "WARC-Profile: "
                 "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    body = rest[:int(fields["Content-Length"])]
    payload = body.partition(b"\r\n\r\n")[2]
    kind, cut = fields["WARC-Type"], len(ID_PREFIX) + 1
    number = lambda v: int(v[cut:-1]) if v and v[cut:-1] else None
    stated = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    if kind == "response" and hashlib.sha1(payload).hexdigest() != stated:
        raise ValueError("a payload differs from its digest")
    return {"page_id": number(fields["WARC-Record-ID"]),
            "payload_bytes": int(fields["X-Payload-Length"]), "payload_digest": stated,
            "record_type": kind, "refers_to": number(fields.get("WARC-Refers-To")),
            "target_uri": fields["WARC-Target-URI"],
            "payload": payload if kind == "response" else None}


def write_archives(pages: DataFrame, folder: str | None = None, min_bytes: int = 1000,
                   archive_bytes: int = ARCHIVE_BYTES, level: int = LEVEL) -> DataFrame:
    """Write all pages; the manifest (path, records, bytes), one row per archive."""
    folder = folder or workspace(pages.sparkSession)
    data = dictionary(pages)

    def write(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = pafs.FileSystem.from_uri(folder)
        press = zstd.ZstdCompressor(level=level, dict_data=_loaded(data))
        out, path, size, count = None, "", 0, 0

        def close():
            out.close()
            return pa.RecordBatch.from_pylist(
                [{"path": f"{folder}/{path}", "records": count, "bytes": size}], manifest)

        manifest = pa.schema([("path", pa.string()), ("records", pa.int64()),
                              ("bytes", pa.int64())])
        for batch in parts:
            for r in batch.to_pylist():
                if out is None:
                    store.create_dir(base, recursive=True)
                    path, count = f"{uuid.uuid4().hex}.warc.zst", 0
                    out = store.open_output_stream(f"{base}/{path}")
                    out.write(struct.pack("<II", SKIPPABLE, len(data)) + data)
                    size = 8 + len(data)
                kind = "response" if r["refers_to"] is None else "revisit"
                frame = press.compress(record_bytes(
                    r["page_id"], r["url"], (r["html"] or "").encode(), kind, r["refers_to"],
                    r["payload_digest"]))
                out.write(frame)
                size, count = size + len(frame), count + 1
                if size >= archive_bytes:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    return staged(roles(pages, min_bytes).mapInArrow(write, MANIFEST_SCHEMA))


def frames(stream, chunk: int = 1 << 16) -> Iterator[bytes]:
    """The records of an open archive, one at a time."""
    magic, length = struct.unpack("<II", stream.read(8))
    if magic != SKIPPABLE:
        raise ValueError("no dictionary frame")
    reader = zstd.ZstdDecompressor(dict_data=_loaded(stream.read(length)))
    rest = stream.read(chunk)
    while rest:
        frame, pieces = reader.decompressobj(), []
        while True:
            pieces.append(frame.decompress(rest))
            if frame.eof:
                break
            rest = stream.read(chunk)
            if not rest:
                raise ValueError("an archive ends within a record")
        yield b"".join(pieces)
        rest = frame.unused_data or stream.read(chunk)


def read_archives(manifest: DataFrame) -> DataFrame:
    """The records of all archives, payloads checked against their digests."""
    n = max(1, manifest.count())

    def read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([
            ("page_id", pa.int64()), ("payload_bytes", pa.int64()),
            ("payload_digest", pa.string()), ("record_type", pa.string()),
            ("refers_to", pa.int64()), ("target_uri", pa.string()), ("payload", pa.binary())])
        rows, size = [], 0
        for batch in parts:
            for uri in batch.column(0).to_pylist():
                store, path = pafs.FileSystem.from_uri(uri)
                with store.open_input_stream(path) as stream:
                    for data in frames(stream):
                        rows.append(parse_record(data))
                        size += len(data)
                        if size > 4 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    return manifest.select("path").repartition(n).mapInArrow(read, RECORD_SCHEMA)
