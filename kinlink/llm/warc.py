"""Operator 7: WARC writing, and the normaliser of monolithic gzip archives.

``write_monolithic`` makes archives whose records share one gzip stream. ``normalise`` inflates
such a stream once, in pieces, rewrites every record as its own gzip member and returns a
sidecar index (offset and length of every member). ``read_records`` reads members by the index.
Archives are rows of Parquet tables in the shared folder, of at most ARCHIVE_BYTES of payload and
one record more, so that Spark commits them and any task can be run again.

Records with equal payloads of at least LEAST bytes: the one of the largest page_id is the
response and the others revisit it (SHA-1 of the payload). Defined results: null html is empty;
rows equal in page_id and payload to the response are responses too; null page_id sorts lowest; a page of any length is written whole;
an empty table gives no archive; extra columns, whatever their names, are not read. A stream that is cut off or broken raises an error.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage

LEAST = 1000
ARCHIVE_BYTES = 8 << 20
LEVEL = 1
_DATE = "2024-01-01T00:00:00Z"


def record(page_id: int | None, url: str | None, payload: bytes, sha1: str, refers: int | None) -> bytes:
    """One WARC/1.1 record; a revisit has no body, but the digest and length of the full payload."""
    kind = "revisit" if refers is not None else "response"
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {re.sub(r'[\x00-\x20]', lambda m: f'%{ord(m[0]):02X}', url or '')}",
        f"WARC-Date: {_DATE}",
        f"WARC-Payload-Digest: sha1:{sha1}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if refers is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    body = b"" if refers is not None else payload
    return "\r\n".join([*head, f"Content-Length: {len(body)}"]).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:] if ": " in x)
    return fields, rest[: int(fields["Content-Length"])]


def deflate(data: bytes) -> bytes:
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def split_stream(data: bytes, piece: int = 1 << 20) -> Iterator[bytes]:
    """Records of a gzip stream (of one member or more), inflated once; memory holds a record and a piece."""
    held = bytearray()
    need, open_member = None, False
    z = zlib.decompressobj(31)
    while data:
        held += z.decompress(data, piece)
        data, open_member = z.unconsumed_tail, not z.eof
        if z.eof:
            data, z = z.unused_data, zlib.decompressobj(31)
        at = 0
        while True:
            if need is None:
                end = held.find(b"\r\n\r\n", at)
                if end < 0:
                    break
                size = re.search(rb"(?i)\r\ncontent-length: *(\d+)", held[at:end])
                if not held.startswith(b"WARC/", at) or size is None:
                    raise ValueError("the archive holds something that is no record")
                need = end + 4 - at + int(size[1]) + 4
            if len(held) - at < need:
                break
            yield bytes(held[at : at + need])
            at, need = at + need, None
        del held[:at]
    if held or open_member:
        raise ValueError("the archive ends inside a record")


def normalise_archive(data: bytes) -> tuple[bytes, list[tuple[int, int]]]:
    """The archive with a member for each record, and their offsets and lengths."""
    out, index = bytearray(), []
    for r in split_stream(data):
        member = deflate(r)
        index.append((len(out), len(member)))
        out += member
    return bytes(out), index


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    z, out, held, n = None, [], 0, 0

    def done() -> pa.RecordBatch:
        data = b"".join([*out, z.flush()])
        return pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([data], pa.binary())], ["n_records", "archive"])

    for b in batches:
        for p, u, h, s, r in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html", "sha1", "refers")), strict=True):
            z = z or zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
            payload = h.encode()
            out.append(z.compress(record(p, u, payload, s, r)))
            held += len(payload)
            n += 1
            if held >= ARCHIVE_BYTES:
                yield done()
                z, out, held, n = None, [], 0, 0
    if n:
        yield done()


def write_monolithic(pages: DataFrame) -> DataFrame:
    """Archives of one gzip stream each, in the shared folder."""
    html = F.coalesce(F.col("html"), F.lit(""))
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"), F.sha1(F.encode(html, "UTF-8")).alias("sha1"))
    long = F.octet_length("html") >= LEAST
    top = stage(p.filter(long).groupBy("sha1").agg(F.max("page_id").alias("top"), F.count("*").alias("n")).filter("n > 1").select("sha1", "top"), "winners")
    # Only long records with a twin look for it; those and the rest are joined by digest, which Spark may deal anew if one is hot.
    r = p.join(top, "sha1", "left").withColumn("refers", F.when(long & (~F.col("page_id").eqNullSafe(F.col("top"))), F.col("top")))
    return stage(r.select("page_id", "url", "html", "sha1", "refers").mapInArrow(_write, "n_records long, archive binary"), "warc-mono")


def _normalise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for a in b.column("archive"):
            data, index = normalise_archive(a.as_py())
            yield pa.RecordBatch.from_arrays([pa.array([data], pa.binary()), pa.array([[{"offset": o, "length": n} for o, n in index]], pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64())])))], ["archive", "index"])


def normalise(archives: DataFrame) -> DataFrame:
    """Archives of one member per record with their sidecar index, in the shared folder."""
    return stage(archives.select("archive").mapInArrow(_normalise, "archive binary, index array<struct<offset:bigint,length:bigint>>"), "warc")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for a, index in zip(b.column("archive"), b.column("index").to_pylist(), strict=True):
            view, rows = a.as_buffer(), []
            for x in index:
                fields, body = parse(zlib.decompress(view[x["offset"] : x["offset"] + x["length"]], 31))
                kind = fields["WARC-Type"]
                sha1 = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                if kind == "response" and hashlib.sha1(body).hexdigest() != sha1:
                    raise ValueError(f"payload of {fields['WARC-Record-ID']} does not match its digest")
                number = lambda s: int(m[1]) if (m := re.fullmatch(r"<urn:page:(-?\d+)>", s)) else None
                rows.append((number(fields["WARC-Record-ID"]), int(fields["X-Payload-Length"]), sha1, kind, number(fields.get("WARC-Refers-To", "")), body))
            cols = list(zip(*rows, strict=True)) or [()] * 6
            types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])


def read_records(archives: DataFrame) -> DataFrame:
    """Every record of the normalised archives, read by the sidecar index; revisits have an empty payload."""
    return archives.select("archive", "index").mapInArrow(_read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")
