"""Content-addressed web archives.

An archive is two tables: ``payloads`` holds each distinct payload once, compressed, under its SHA-256; ``records``
holds the exact header of every record and the digest of its payload. A record is rebuilt by a join. Of records with
equal payloads the one with the largest page_id is a response and the others are revisits that refer to it.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from libraryloom.llm.common import cut, fresh_path, runs_by_size, utf8_of

#: Fixed values of the format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HEADER_END = RECORD_END = b"\r\n\r\n"
#: The capture time that headers name; a parameter, so that archives can be made again byte by byte.
DATE = "2024-01-01T00:00:00Z"


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def page_of(urn: str) -> int | None:
    name = urn.rpartition(":")[2].rstrip(">")
    return None if name == "none" else int(name)


def header(page_id: int | None, url: str | None, kind: str, sha1: str, length: int, refers_to: int | None, date: str) -> bytes:
    """The header of one record with the empty line that ends it."""
    safe = "".join(c if c.isprintable() and c != " " else "".join(f"%{b:02X}" for b in c.encode()) for c in url or "")
    lines = [VERSION, f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {date}", f"WARC-Target-URI: {safe}", f"WARC-Payload-Digest: sha1:{sha1}"]
    if kind == "revisit":
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {length if kind == 'response' else 0}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n"


def parse_header(raw: bytes) -> dict[str, str]:
    lines = raw.decode().split("\r\n")
    if lines[0] != VERSION or lines[-2:] != ["", ""]:
        raise ValueError("not the header of a record")
    return dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:-2])


def digests(pages: DataFrame) -> DataFrame:
    """(page_id, url, digest, sha1, length): SHA-256 as bytes and SHA-1 in base32 of each page's UTF-8 bytes (null: none)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            body = utf8_of(batch.column(2))
            sha1 = [base64.b32encode(hashlib.sha1(x).digest()).decode() for x in body]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([hashlib.sha256(x).digest() for x in body], pa.binary()), pa.array(sha1, pa.string()), pa.array(list(map(len, body)), pa.int64())], names=["page_id", "url", "digest", "sha1", "length"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, digest binary, sha1 string, length long")


def payloads(pages: DataFrame) -> DataFrame:
    """(digest, packed): each distinct payload once, compressed; each task drops its own repeats before the shuffle."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            body = utf8_of(batch.column(0))
            for i, j in runs_by_size([len(x) for x in body], 8_000_000):
                own = {}
                for x in body[i:j]:
                    if (k := hashlib.sha256(x).digest()) not in seen:
                        seen.add(k)
                        own[k] = zlib.compress(x, 5)
                yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.binary()), pa.array(list(own.values()), pa.binary())], names=["digest", "packed"])

    return pages.select("html").mapInArrow(run, "digest binary, packed binary").dropDuplicates(["digest"])


def write_archive(spark: SparkSession, pages: DataFrame, path: str, date: str = DATE, least: int = 0) -> None:
    """Write the archive of ``pages`` (page_id, url, html) to ``path``.

    Payloads of fewer than ``least`` bytes are never revisited. Rows that repeat a page are responses alike and share
    the stored payload. A null page_id is smaller than any other; where all of a group are null, all are responses.
    """
    payloads(pages).write.option("compression", "snappy").parquet(f"{path}/payloads")
    rows = digests(pages)
    top = rows.groupBy("digest").agg(F.max("page_id").alias("top"), F.min("sha1").alias("a"), F.max("sha1").alias("b"))
    top = cut(top, "top")  # so that the join below may split the rows of a payload that very many pages have
    same = F.when(F.col("a") != F.col("b"), F.raise_error(F.lit("two payloads under one digest"))).otherwise(F.col("top"))
    rows = rows.join(top.select("digest", same.alias("top")), "digest")
    response = (F.col("length") < least) | F.col("page_id").eqNullSafe(F.col("top"))
    rows = rows.select("page_id", "url", "digest", "sha1", "length", response.alias("response"), "top")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = batch.to_pydict()
            heads = [
                header(p, u, "response" if r else "revisit", s, n, None if r else t, date)
                for p, u, s, n, r, t in zip(c["page_id"], c["url"], c["sha1"], c["length"], c["response"], c["top"], strict=True)
            ]
            yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(c["response"], pa.bool_()), pa.array(heads, pa.binary())], names=["digest", "response", "header"])

    rows.mapInArrow(run, "digest binary, response boolean, header binary").write.parquet(f"{path}/records")


def _rebuilt(batch: pa.RecordBatch) -> Iterator[tuple[bytes, bytes]]:
    """(record, payload) of joined rows of digest, response, header and packed payload; each payload's SHA-256 is tested."""
    last, body = None, b""
    for digest, response, head, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
        if digest != last:  # rows of one payload follow each other after the join
            last, body = digest, zlib.decompress(packed)
            if hashlib.sha256(body).digest() != digest:
                raise ValueError(f"the payload stored under {digest.hex()} is damaged")
        yield head + (body if response else b"") + RECORD_END, body


def _joined(spark: SparkSession, path: str) -> DataFrame:
    records, stored = spark.read.parquet(f"{path}/records"), spark.read.parquet(f"{path}/payloads")
    return records.join(stored, "digest").select("digest", "response", "header", "packed")


def rebuild(spark: SparkSession, path: str) -> DataFrame:
    """(record, payload): every record as the bytes of a WARC file, revisits without a body, and its full payload."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.binary()) for k in range(2)], names=["record", "payload"])

        for batch in batches:
            rows, size = [], 0
            for row in _rebuilt(batch):
                rows.append(row)
                size += len(row[0]) + len(row[1])
                if size > 8_000_000:
                    yield out(rows)
                    rows, size = [], 0
            yield out(rows)

    return _joined(spark, path).mapInArrow(run, "record binary, payload binary")


def read_record(record: bytes, payload: bytes) -> tuple[int | None, int, str, str, int | None]:
    """page_id, payload bytes, payload SHA-1 in base32, kind and page referred to, of a record's bytes and its full payload.

    Everything comes from the bytes: a body must be as long as its header says, a response's body must be its payload,
    and the SHA-1 of the payload must be the header's; else an error is raised.
    """
    split = record.index(HEADER_END) + len(HEADER_END)
    h = parse_header(record[:split])
    body, end = record[split : split + int(h["Content-Length"])], record[split + int(h["Content-Length"]) :]
    kind = h["WARC-Type"]
    sha1 = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    if end != RECORD_END or h["WARC-Payload-Digest"] != f"sha1:{sha1}" or body != (payload if kind == "response" else b""):
        raise ValueError(f"record {h['WARC-Record-ID']} does not fit its payload")
    return page_of(h["WARC-Record-ID"]), len(payload), sha1, kind, page_of(h["WARC-Refers-To"]) if kind == "revisit" else None


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: page_id, payload_bytes, payload_digest, record_type and refers_to.

    Every record is put together again, header and payload, and read as ``read_record`` does.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(zip(*(read_record(*x) for x in _rebuilt(batch)), strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return _joined(spark, path).mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive_roundtrip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write the archive of ``pages`` to the shared folder and read it back; an empty table gives an empty result.

    A null html is an empty payload; payloads of any length are stored, rebuilt and measured whole; pages of equal
    payload are ordered by page_id, and rows that share the largest one are all responses.
    """
    path = fresh_path(spark, "archive")
    write_archive(spark, pages, path)
    return read_archive(spark, path)


#: The result of ``archive_roundtrip``; base32 is spelled out, five hex digits to four letters.
ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS h FROM pages),
     r AS (SELECT *, max(page_id) OVER (PARTITION BY t) AS top FROM p)
SELECT page_id, CAST(strlen(t) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 8), lambda g: array_to_string(list_transform([15, 10, 5, 0], lambda k:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(h, CAST(g * 5 + 1 AS INTEGER), 5) AS INTEGER) >> k) & 31 AS INTEGER) + 1, 1)), '')), '') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to
FROM r
"""
