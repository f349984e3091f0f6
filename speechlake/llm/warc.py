"""WARC archives: one gzip member per record, written from pages and read back in sequence.

The reader feeds compressed bytes to zlib piece by piece, ends a record where its gzip member ends, frames head and block by
Content-Length, and verifies block and payload digests.  A payload that repeats is stored once: the record with the largest
page_id is the response, the others are revisits of it with the HTTP head only.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from speechlake.llm.common import settle

#: Payloads of fewer bytes are stored each time.
LEAST_BYTES = 1000
#: Compressed bytes after which a writer begins another archive.
ARCHIVE_BYTES = 4 << 20
#: Compressed bytes that are fed to zlib at once.
FEED = 1 << 16
LEVEL = 1
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: The date that stands in every record: archives of equal pages are equal.
DATE = "2020-01-01T00:00:00Z"


class Malformed(ValueError):
    """An archive that isn't well-formed, or a digest that doesn't fit."""


@dataclass
class Record:
    kind: str
    fields: dict[str, str]
    block: bytes
    offset: int
    length: int

    def http(self) -> tuple[dict[str, str], bytes]:
        """Fields of the HTTP head, and the payload after it."""
        head, mark, payload = self.block.partition(b"\r\n\r\n")
        if not mark:
            raise Malformed("no end of the HTTP head")
        return _fields(head.split(b"\r\n")[1:]), payload


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def hex_digest(field: str) -> str:
    return base64.b32decode(field.removeprefix("sha1:")).hex()


def _fields(lines: Iterable[bytes]) -> dict[str, str]:
    out = {}
    for line in lines:
        name, mark, value = line.partition(b":")
        if not mark:
            raise Malformed(f"field without a colon: {line[:40]!r}")
        out[name.strip().decode("ascii", "replace").lower()] = value.strip().decode("utf-8", "replace")
    return out


def _one_line(s: str | None) -> str:
    return " ".join((s or "about:blank").split()) or "about:blank"


def write_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One gzip member: a response, or a revisit of ``refers_to`` without the payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_one_line(url)}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: {digest(payload)}",
        f"WARC-Block-Digest: {digest(block)}",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        lines[3:3] = [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def read_records(archive: bytes, verify: bool = True) -> Iterator[Record]:
    """The records of an archive in sequence; raises Malformed at the first that doesn't fit."""
    at, view = 0, memoryview(archive)
    while at < len(archive):
        z, parts, start = zlib.decompressobj(31), [], at
        try:
            while not z.eof:
                if at >= len(archive):
                    raise Malformed(f"gzip member at {start} is cut off")
                piece = view[at : at + FEED]
                parts.append(z.decompress(piece))
                at += len(piece) - len(z.unused_data)
        except zlib.error as e:
            raise Malformed(f"gzip member at {start}: {e}") from e
        yield _record(b"".join(parts), start, at - start, verify)


def _record(raw: bytes, offset: int, length: int, verify: bool) -> Record:
    end = raw.find(b"\r\n\r\n")
    lines = raw[: max(end, 0)].split(b"\r\n")
    if end < 0 or not lines[0].startswith(b"WARC/1."):
        raise Malformed(f"no record head at {offset}")
    fields = _fields(lines[1:])
    if not fields.get("content-length", "").isdigit():
        raise Malformed(f"no Content-Length at {offset}")
    block, rest = raw[end + 4 : end + 4 + int(fields["content-length"])], raw[end + 4 + int(fields["content-length"]) :]
    if len(block) < int(fields["content-length"]) or rest != b"\r\n\r\n":
        raise Malformed(f"Content-Length doesn't frame the record at {offset}")
    record = Record(fields.get("warc-type", ""), fields, block, offset, length)
    if verify and "warc-block-digest" in fields and digest(block) != fields["warc-block-digest"]:
        raise Malformed(f"block digest at {offset}")
    if verify and record.kind == "response" and "warc-payload-digest" in fields and digest(record.http()[1]) != fields["warc-payload-digest"]:
        raise Malformed(f"payload digest at {offset}")
    return record


def write_archives(pages: DataFrame) -> DataFrame:
    """(archive) binary rows of about ARCHIVE_BYTES from (page_id, url, payload, refers_to)."""

    def rows(batches):
        parts, size = [], 0
        for batch in batches:
            for page, url, payload, refers_to in zip(*(batch.column(c) for c in range(4)), strict=True):
                parts.append(write_record(page.as_py(), url.as_py(), payload.as_py(), refers_to.as_py()))
                size += len(parts[-1])
                if size >= ARCHIVE_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(parts)], pa.binary())], ["archive"])
                    parts, size = [], 0
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(parts)], pa.binary())], ["archive"])

    return pages.select("page_id", "url", "payload", "refers_to").mapInArrow(rows, "archive binary")


def _page(urn: str) -> int | None:
    name = urn.removeprefix("<urn:page:").removesuffix(">")
    return int(name) if name else None


def read_archives(archives: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, url, record_bytes) of every record of every archive."""

    def rows(batches):
        for batch in batches:
            for archive in batch.column(0):
                out = []
                for r in read_records(archive.as_py()):
                    head, payload = r.http()
                    n = len(payload) if r.kind == "response" else int(head["content-length"])
                    refers_to = _page(r.fields["warc-refers-to"]) if r.kind == "revisit" else None
                    out.append((_page(r.fields["warc-record-id"]), n, hex_digest(r.fields["warc-payload-digest"]), r.kind, refers_to, r.fields["warc-target-uri"], r.length))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "record_bytes"])

    return archives.select("archive").mapInArrow(rows, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, record_bytes long")


def with_revisits(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """(page_id, url, payload, refers_to) of ``pages`` (page_id, url, html): the page that holds an equal payload, else null.

    The largest page_id of a payload holds it; a null page_id refers to the holder, and without any id each row holds its own.
    A null html is an empty payload.  Rows that repeat the holder's id are responses too.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    large = F.length("payload") >= least_bytes
    alone = F.concat(F.lit("-"), F.xxhash64("page_id", "url").cast("string"))  # meets no holder, and isn't one key for all small pages
    pages = pages.withColumn("digest", F.when(large, F.sha1("payload")).otherwise(alone))
    holders = pages.where(large).groupBy("digest").agg(F.max("page_id").alias("holder"), F.count("*").alias("n")).where("n > 1")
    joined = pages.join(settle(holders.select("digest", "holder"), "holders").hint("shuffle_hash"), "digest", "left")
    return joined.select("page_id", "url", "payload", F.when(~F.col("page_id").eqNullSafe(F.col("holder")), F.col("holder")).alias("refers_to"))


def archive_round_trip(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Writes ``pages`` to archives in the shared folder and returns what ``read_archives`` finds in them."""
    return read_archives(settle(write_archives(with_revisits(pages, least_bytes)), "archives"))


ORACLE_SQL = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload, sha1(coalesce(html, '')) AS digest FROM pages),
q AS (SELECT *, octet_length(payload) AS n, max(page_id) OVER (PARTITION BY digest) AS holder FROM p)
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
       CASE WHEN n >= {LEAST_BYTES} AND holder <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= {LEAST_BYTES} AND holder <> page_id THEN holder END AS refers_to
FROM q"""
