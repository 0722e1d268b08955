"""Media columns: payloads as PNG images in binary columns, read back with checksum tests, and cosine-transform hashes."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from libraryloom.llm.common import runs_by_size, utf8_of

WIDTH = 64
#: Fixed values of the format.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
NONE, SUB, UP, AVERAGE, PAETH = range(5)
CHUNK = 1 << 20


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_png(samples: bytes, width: int = WIDTH, filter_type: int = UP, level: int = 1) -> bytes:
    """8-bit grey samples, a multiple of ``width`` of them, as a PNG file. ``filter_type``: none, sub or up."""
    image = np.frombuffer(samples, dtype=np.uint8).reshape(-1, width)
    rows = np.empty((len(image), width + 1), dtype=np.uint8)
    rows[:, 0] = filter_type
    rows[:, 1:] = image
    if filter_type == UP:
        rows[1:, 1:] -= image[:-1]
    elif filter_type == SUB:
        rows[:, 2:] -= image[:, :-1]
    elif filter_type != NONE:
        raise ValueError(f"filter type {filter_type} is only read, not written")
    body = zlib.compress(rows.tobytes(), level)
    data = b"".join(_chunk(b"IDAT", body[i : i + CHUNK]) for i in range(0, len(body), CHUNK))
    return SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", width, len(image), 8, 0, 0, 0, 0)) + data + _chunk(b"IEND", b"")


def _unfilter(kinds: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Undo the row filters in place. Runs of rows of one kind (none, sub, up) are undone at once."""
    bounds = np.flatnonzero(np.concatenate([[True], kinds[1:] != kinds[:-1], [True]]))
    zero = np.zeros(rows.shape[1], dtype=np.uint8)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        kind = int(kinds[a])
        above = rows[a - 1] if a else zero
        if kind == SUB:
            np.cumsum(rows[a:b], axis=1, dtype=np.uint8, out=rows[a:b])
        elif kind == UP:
            rows[a] += above
            np.cumsum(rows[a:b], axis=0, dtype=np.uint8, out=rows[a:b])
        elif kind in (AVERAGE, PAETH):
            for r in range(a, b):  # each sample needs the one before it
                up, line, left, corner = (rows[r - 1] if r else zero).tolist(), rows[r].tolist(), 0, 0
                for x, over in enumerate(up):
                    if kind == AVERAGE:
                        guess = (left + over) >> 1
                    else:
                        p = left + over - corner
                        guess = min(((abs(p - left), 0, left), (abs(p - over), 1, over), (abs(p - corner), 2, corner)))[2]
                    left, corner = (line[x] + guess) & 255, over
                    line[x] = left
                rows[r] = line
        elif kind != NONE:
            raise ValueError(f"unknown filter type {kind}")
    return rows


def decode_png(file: bytes) -> np.ndarray:
    """The samples (height x width) of an 8-bit grey PNG without interlace; every chunk's checksum is tested."""
    if file[:8] != SIGNATURE:
        raise ValueError("not a PNG file")
    at, body, size, ended = 8, [], None, False
    while at < len(file) and not ended:
        (n,), kind = struct.unpack_from(">I", file, at), file[at + 4 : at + 8]
        data = file[at + 8 : at + 8 + n]
        if len(file) < at + 12 + n or zlib.crc32(kind + data) != struct.unpack_from(">I", file, at + 8 + n)[0]:
            raise ValueError(f"chunk {kind!r} at byte {at} is damaged")
        if kind == b"IHDR":
            width, height, *rest = struct.unpack(">IIBBBBB", data)
            if rest != [8, 0, 0, 0, 0]:
                raise ValueError("only 8-bit grey samples without interlace are read")
            size = height, width
        elif kind == b"IDAT":
            body.append(data)
        ended = kind == b"IEND"
        at += 12 + n
    if size is None or not ended:
        raise ValueError("the file has no header or no end")
    raw = np.frombuffer(bytearray(zlib.decompress(b"".join(body))), dtype=np.uint8).reshape(size[0], size[1] + 1)
    return _unfilter(raw[:, 0], np.ascontiguousarray(raw[:, 1:]))


SIDE, LOW = 32, 8
_k = np.arange(SIDE)
COSINES = np.cos(np.pi / SIDE * (_k[None, :] + 0.5) * _k[:LOW, None])


def cosine_hash(image: np.ndarray) -> str:
    """64 bits as 16 hex digits: the image as 32 x 32 means, its 8 x 8 lowest cosine coefficients, each over their median."""
    small = image
    for axis in (0, 1):
        n = small.shape[axis]
        edges = np.arange(SIDE + 1) * n // SIDE
        first = np.minimum(edges[:-1], n - 1)
        sums = np.add.reduceat(small, first, axis=axis, dtype=np.float64)
        if n >= SIDE:
            counts = np.diff(edges)
        else:
            sums, counts = np.take(small, first, axis=axis).astype(np.float64), np.ones(SIDE)
        small = sums / (counts[:, None] if axis == 0 else counts)
    low = np.round(COSINES @ small @ COSINES.T, 6).ravel()
    return np.packbits(low > np.median(low[1:])).tobytes().hex()


def to_media(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each text's UTF-8 bytes (null: none), zero-padded to a positive multiple of 64, as a PNG.

    Texts of any length are stored whole, equal ones alike; nulls in doc_id and repeated rows are handed on, other columns
    are left out, and an empty table gives an empty result.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = utf8_of(batch.column(1))
            for i, j in runs_by_size([len(t) for t in texts], 8_000_000):
                media = [encode_png(t.ljust(max(WIDTH, -(-len(t) // WIDTH) * WIDTH), b"\0")) for t in texts[i:j]]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array([len(t) for t in texts[i:j]], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


def describe_media(media: DataFrame) -> DataFrame:
    """Read a binary column of PNG files back: digests of the payload and of the stored file, and the cosine hash.

    A damaged file raises an error. Rows are independent, so nulls in doc_id, repeated rows and empty tables need no care.
    """
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for file in batch.column(2).to_pylist():
                image = decode_png(file)
                payload = image.tobytes()
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(file), hashlib.sha256(file).hexdigest(), cosine_hash(image)))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=names)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, schema)
