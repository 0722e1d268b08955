"""Byte-level BPE by monoid tree reduction, exact to the rank file.

A piece (a match of the splitting pattern) is encoded in halves, recursively down to single bytes, and neighbours are
joined. A join is exact because of a property of merging by (rank, place): a sequence of tokens is the encoding of its
bytes if and only if each two adjacent tokens, taken alone, are the encoding of their own bytes. For: as long as no
merge has crossed a boundary, the merges on its two sides come in the same order in the whole and in the two tokens
alone, so the first merge that crosses in one of them would cross in the other. Hence a join encodes a window around the
boundary anew, and the window grows until the pairs at its edges are such encodings; no token beyond it can change then.
The window doubles, so a join costs no more than a few times what it changes.

Texts are reduced by the same tree: they are halved where white space follows something else, where every match of the
pattern ends, and ids of neighbouring leaves are concatenated. Decoding concatenates the bytes of ids up the tree.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from libraryloom.llm.common import slices, texts_of

#: Characters of a leaf of a text's tree, unless it has no place to be cut.
LEAF = 1 << 16
#: Distinct pieces, fragments and pairs that a worker remembers, each, before it starts anew.
MEMO = 300_000
#: Bytes of the longest fragment that is remembered.
FRAGMENT = 12
#: Bytes of UTF-8 turned into Python strings at a time.
SLICE = 4_000_000

#: Letters, then numbers, that Unicode has had only since its version 17 and the tokenizer's library, at
#: version 16, holds for neither; the pattern module here may know them.
LATER_LETTERS = "558 58B-58C 88F C5C CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7 10ED9-10EEE 11B0A 11DB0-11DDB 11DF1 16EA0-16EB8 16EBB-16ED3 16FF2-16FF3 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F"
LATER_NUMBERS = "11DE0-11DE9 1246F 12475-1247F 12550-12686 16FF4-16FF6"

_CUT = regex.compile(r"(?<=\S)(?=\s)")


def read_ranks(raw: bytes) -> dict[bytes, int]:
    """Ranks by token of a file of lines ``base64 rank``; a vocabulary without all 256 bytes is an error."""
    ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(None, raw.splitlines()))}
    if any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError("the rank file has no token for some byte")
    return ranks


def _set_of(runs: str) -> str:
    return "".join("-".join(f"\\U{int(c, 16):08X}" for c in run.split("-")) for run in runs.split())


_LATER = regex.compile(f"[{_set_of(LATER_LETTERS)}{_set_of(LATER_NUMBERS)}]")


def older_pattern(pattern: str) -> str:
    r"""The pattern with \p{L} and \p{N} as version 16 has them; slower, so only for texts that hold later characters."""
    return pattern.replace(r"\p{L}", rf"[\p{{L}}--[{_set_of(LATER_LETTERS)}]]").replace(r"\p{N}", rf"[\p{{N}}--[{_set_of(LATER_NUMBERS)}]]")


def cut_places(text: str, most: int = LEAF) -> list[int]:
    """Ends of the leaves of a text's tree, in order: halves are halved until they have at most ``most`` characters.

    A half ends before the white space nearest after its middle that follows something else; a text that has no such
    place in its second half is cut in its first, and one without any is a leaf, whatever its length.
    """
    ends, stack = [], [(0, len(text))]
    while stack:
        at, end = stack.pop()
        if end - at > most:
            middle = (at + end) // 2
            found = _CUT.search(text, middle, end) or _CUT.search(text, at + 1, middle)
            if found and at < found.start() < end:
                stack += [(found.start(), end), (at, found.start())]
                continue
        ends.append(end)
    return ends


class TreeEncoder:
    """Encodes and decodes by the ranks of one file; what it remembers is bounded and does not change results."""

    def __init__(self, raw: bytes, pattern: str) -> None:
        self.rank = read_ranks(raw)
        self.token = {rank: token for token, rank in self.rank.items()}
        self.decimal = {rank: str(rank) for rank in self.token}
        self.pattern = regex.compile(pattern)
        self.older = regex.compile(older_pattern(pattern), regex.V1)
        self.known: dict[str, tuple[int, ...]] = {}
        self.fragments: dict[bytes, tuple[int, ...]] = {}
        self.pairs: dict[tuple[int, int], tuple[int, ...]] = {}

    def merged(self, piece: bytes) -> tuple[int, ...]:
        """Plain merging of one window: the adjacent pair of least rank, leftmost first, until none has a rank."""
        rank = self.rank
        parts: list[bytes | None] = [piece[i : i + 1] for i in range(len(piece))]
        if len(parts) <= 40:
            while len(parts) > 1:
                ranks = [rank.get(a + b, 1 << 62) for a, b in zip(parts, parts[1:], strict=False)]
                least = min(ranks)
                if least == 1 << 62:
                    break
                at = ranks.index(least)
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            return tuple([rank[p] for p in parts])
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap = [(r, i, i + 1) for i in range(len(parts) - 1) if (r := rank.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, j = heapq.heappop(heap)
            if parts[i] is None or j >= len(parts) or after[i] != j or parts[j] is None or rank.get(parts[i] + parts[j]) != r:
                continue
            parts[i], parts[j] = parts[i] + parts[j], None
            after[i] = after[j]
            if after[i] < len(parts):
                before[after[i]] = i
                if (r := rank.get(parts[i] + parts[after[i]])) is not None:
                    heapq.heappush(heap, (r, i, after[i]))
            if before[i] >= 0 and (r := rank.get(parts[before[i]] + parts[i])) is not None:
                heapq.heappush(heap, (r, before[i], i))
        return tuple([rank[p] for p in parts if p is not None])

    def pair(self, a: int, b: int) -> tuple[int, ...]:
        """The encoding of the bytes of two tokens; it is (a, b) where no merge crosses between them."""
        found = self.pairs.get((a, b))
        if found is None:
            if len(self.pairs) >= MEMO:
                self.pairs.clear()
            found = self.pairs[a, b] = self.merged(self.token[a] + self.token[b])
        return found

    def join(self, left: tuple[int, ...], right: tuple[int, ...]) -> tuple[int, ...]:
        """The encoding of the bytes of two encodings."""
        if not left or not right:
            return left or right
        window = self.pair(left[-1], right[0])
        if window == (left[-1], right[0]):
            return left + right
        i, j = 1, 1
        while True:
            settled = i >= len(left) or self.pair(left[-i - 1], window[0]) == (left[-i - 1], window[0])
            ended = j >= len(right) or self.pair(window[-1], right[j]) == (window[-1], right[j])
            if settled and ended:
                return left[: len(left) - i] + window + right[j:]
            i, j = (i if settled else min(2 * i, len(left))), (j if ended else min(2 * j, len(right)))
            window = self.merged(b"".join([self.token[t] for t in (*left[len(left) - i :], *right[:j])]))

    def reduced(self, piece: bytes) -> tuple[int, ...]:
        """The encoding of a piece: both halves', joined."""
        found = self.fragments.get(piece)
        if found is None:
            half = len(piece) // 2
            if half:
                left, right = self.fragments.get(piece[:half]) or self.reduced(piece[:half]), self.fragments.get(piece[half:]) or self.reduced(piece[half:])
                middle = (left[-1], right[0])
                found = left + right if self.pairs.get(middle) == middle else self.join(left, right)
            else:
                found = (self.rank[piece],)
            if len(piece) <= FRAGMENT:
                if len(self.fragments) >= MEMO:
                    self.fragments.clear()
                self.fragments[piece] = found
        return found

    def encode_leaf(self, text: str) -> list[int]:
        """Ids of a part of a text that begins and ends where matches do; a match that is a token is that token."""
        pieces = (self.older if not text.isascii() and _LATER.search(text) else self.pattern).findall(text)
        if len(self.known) >= MEMO:
            self.known.clear()
        known = self.known
        for piece in set(pieces).difference(known):
            raw = piece.encode()
            whole = self.rank.get(raw)
            known[piece] = self.reduced(raw) if whole is None else (whole,)
        return list(chain.from_iterable(map(known.__getitem__, pieces)))

    def leaves(self, text: str) -> Iterator[list[int]]:
        """The ids of the leaves of a text's tree, in order; their concatenation is the encoding of the text."""
        at = 0
        for end in cut_places(text):
            yield self.encode_leaf(text[at:end])
            at = end

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(self.leaves(text)))

    def decode(self, ids: Iterable[int]) -> bytes:
        """The bytes of ids; an id that the file does not have is a KeyError."""
        return b"".join(map(self.token.__getitem__, ids))

    def digests(self, text: str) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the decimal ids joined by commas and of the decoded bytes, leaf by leaf."""
        count, ids_sha, decoded_sha = 0, hashlib.sha256(), hashlib.sha256()
        for ids in self.leaves(text):
            if ids:
                ids_sha.update((b"," if count else b"") + ",".join(map(self.decimal.__getitem__, ids)).encode())
                decoded_sha.update(self.decode(ids))
                count += len(ids)
        return count, ids_sha.hexdigest(), decoded_sha.hexdigest()


_encoders: dict[tuple[str, str], TreeEncoder] = {}


def encoder(raw: bytes, pattern: str) -> TreeEncoder:
    """This worker's encoder for a rank file; what it remembers lives on from task to task."""
    key = (hashlib.sha256(raw).hexdigest(), pattern)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = TreeEncoder(raw, pattern)
    return _encoders[key]


def _file(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode_documents(spark: SparkSession, docs: DataFrame, rank_file: str, pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """``docs`` with one more column, ``out``: the ids of ``text`` as array<int>.

    A null text counts as empty and has no ids; texts of any length are encoded whole; repeated rows have equal ids and
    all other columns stay as they are. A column that already has the name ``out`` is replaced.
    """
    shared = spark.sparkContext.broadcast(_file(rank_file))  # the vocabulary: about 1 MB whatever the data
    docs = docs.drop(out)
    place = docs.columns.index(text)
    schema = T.StructType(docs.schema.fields.copy()).add(out, T.ArrayType(T.IntegerType(), False), False)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(shared.value, pattern)
        for batch in batches:
            for i, j in slices(batch.column(place), SLICE):
                part = batch.slice(i, j - i)
                flat = [np.array(enc.encode(t), dtype=np.int32) for t in texts_of(part.column(place))]
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in flat])]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(flat)))
                yield pa.RecordBatch.from_arrays([*part.columns, ids], names=[*part.schema.names, out])

    return docs.mapInArrow(run, schema)


def decode_documents(spark: SparkSession, encoded: DataFrame, rank_file: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``encoded`` with one more column, ``out``: the bytes of its ids (no ids or null: no bytes). An unknown id fails."""
    shared = spark.sparkContext.broadcast(_file(rank_file))
    encoded = encoded.drop(out)
    place = encoded.columns.index(ids)
    schema = T.StructType(encoded.schema.fields.copy()).add(out, "binary", False)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(shared.value, "")
        for batch in batches:
            raw = [enc.decode(row.as_py() or ()) for row in batch.column(place)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(raw, pa.binary())], names=[*batch.schema.names, out])

    return encoded.mapInArrow(run, schema)


def ids_digest(ids: Column) -> Column:
    """SHA-256 of decimal ids joined by commas."""
    return F.sha2(F.array_join(ids.cast("array<string>"), ","), 256)


def roundtrip_digests(spark: SparkSession, docs: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """Per document the number of ids, the digest of its decimal ids joined by commas and of the bytes that they decode to.

    One row per input row (repeated rows and null ids included); a null or empty text has 0 ids and digests of no bytes.
    A text is encoded, decoded and digested leaf by leaf of its tree, so no text's ids are held at once.
    """
    shared = spark.sparkContext.broadcast(_file(rank_file))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(shared.value, pattern)
        for batch in batches:
            for i, j in slices(batch.column(1), SLICE):
                rows = [enc.digests(t) for t in texts_of(batch.column(1).slice(i, j - i))]
                n, ids_sha, decoded_sha = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
