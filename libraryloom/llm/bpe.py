"""BPE encoding and decoding with a minimal acyclic transducer as lexicon.

Whole words of the vocabulary, the words frequent enough to own an id, are compiled into a minimal acyclic automaton:
words share prefixes and suffixes, and each edge carries the number of words that sort before it, so the sum along a
path is the word's index into an array of ids. The automaton is a few flat arrays in one memory map. Words that it does
not hold are merged by the byte-pair rules, many at once. Both give the ids of the tokenizer file itself.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import mmap
import os
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from libraryloom.llm.common import slices, texts_of

#: White space as the tokenizer's normaliser knows it (str.split() also takes U+001C to U+001F).
SPACE_CHARS = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Distinct words that a worker remembers before it starts anew.
MEMO = 400_000


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def build_automaton(words: list[bytes]) -> dict[str, np.ndarray]:
    """Minimal acyclic automaton of sorted distinct words, as arrays.

    ``first[s]`` to ``first[s + 1]`` are the edges of state s; each has a ``label``, a ``target`` and ``before``, the
    number of words that leave s by a smaller label or end in s. ``final[s]`` is 1 where a word may end.
    """
    registry: dict[tuple, int] = {}
    states: list[tuple] = []

    def register(node: list) -> int:
        key = (node[0], tuple(node[1]))
        if key not in registry:
            registry[key] = len(states)
            states.append(key)
        return registry[key]

    path: list[list] = [[0, []]]  # open states from the root: [final, edges]
    last = b""

    def close(depth: int) -> None:
        while len(path) - 1 > depth:
            done = register(path.pop())
            path[-1][1][-1] = (path[-1][1][-1][0], done)

    for word in words:
        common = len(os.path.commonprefix((last, word)))
        close(common)
        for byte in word[common:]:
            path[-1][1].append((byte, -1))
            path.append([0, []])
        path[-1][0] = 1
        last = word
    close(0)
    root = register(path[0])
    counts = [0] * len(states)
    first, label, target, before = [0], [], [], []
    for s, (final, edges) in enumerate(states):  # targets are registered before the states that lead to them
        total = final
        for byte, to in edges:
            label.append(byte)
            target.append(to)
            before.append(total)
            total += counts[to]
        counts[s] = total
        first.append(len(label))
    arrays = {"first": first, "label": label, "target": target, "before": before, "final": [f for f, _ in states], "root": [root]}
    return {k: np.asarray(v, dtype=np.int32) for k, v in arrays.items()}


def pack(arrays: dict[str, np.ndarray]) -> bytes:
    """One buffer of a JSON header and the arrays, each of int64 or int32, 8-byte aligned."""
    head, body, at = {}, [], 0
    for name, a in arrays.items():
        raw = a.tobytes() + b"\0" * (-a.nbytes % 8)
        head[name] = [a.dtype.str, len(a), at]
        body.append(raw)
        at += len(raw)
    text = json.dumps(head).encode()
    text += b" " * (-len(text) % 8)
    return len(text).to_bytes(8, "little") + text + b"".join(body)


def unpack(buffer) -> dict[str, np.ndarray]:
    """The arrays of ``pack`` as views of the buffer."""
    n = int.from_bytes(buffer[:8], "little")
    head = json.loads(bytes(buffer[8 : 8 + n]))
    return {name: np.frombuffer(buffer, dtype=kind, count=count, offset=8 + n + at) for name, (kind, count, at) in head.items()}


def mapped(raw: bytes) -> mmap.mmap:
    """A memory map of ``raw`` that needs no folder: an anonymous file of the operating system."""
    handle = os.memfd_create("lexicon")
    try:
        os.write(handle, raw) if len(raw) < 2**30 else [os.write(handle, raw[i : i + 2**20]) for i in range(0, len(raw), 2**20)]
        return mmap.mmap(handle, len(raw), prot=mmap.PROT_READ)
    finally:
        os.close(handle)


def compile_lexicon(tokenizer_json: str) -> bytes:
    """Compile a tokenizer file (byte-level BPE with a word-end mark) to one buffer: merges, automaton and ids.

    The size is bounded by the vocabulary file, a few MB, so it is broadcast whole.
    """
    with open(tokenizer_json, encoding="utf-8") as f:
        spec = json.load(f)
    model, end = spec["model"], spec["model"]["end_of_word_suffix"]
    vocab = model["vocab"]
    letters = _byte_letters()
    size = max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
    rank_of: dict[int, int] = {}
    for rank, (a, b) in enumerate(model["merges"]):
        rank_of.setdefault(vocab[a] * size + vocab[b], rank)
    slots, places = pair_table(np.array(list(rank_of), dtype=np.int64))
    ranks = np.array([*rank_of.values(), NO_RANK], dtype=np.int32)
    arrays = {
        "size": np.array([size], dtype=np.int64), "slots": slots, "slot_rank": ranks[places], "made": np.array([vocab[a + b] for a, b in model["merges"]], dtype=np.int64),
        "inner": np.array([vocab[x] for x in letters], dtype=np.int64), "last": np.array([vocab[x + end] for x in letters], dtype=np.int64),
    }
    byte_of = {x: i for i, x in enumerate(letters)}
    whole = sorted((bytes(byte_of[c] for c in w[: -len(end)]), i) for w, i in vocab.items() if w.endswith(end) and len(w) > len(end))
    merged = merge_words([w for w, _ in whole], arrays)  # an id is an output only where the merges really reach it
    whole = [(w, i) for (w, i), ids in zip(whole, merged, strict=True) if ids == i.to_bytes(4, "little")]
    arrays |= build_automaton([w for w, _ in whole]) | {"ids": np.array([i for _, i in whole], dtype=np.int32)}
    tokens = [""] * size
    for w, i in [*vocab.items(), *((t["content"], t["id"]) for t in spec["added_tokens"])]:
        tokens[i] = w
    text = [t.encode() for t in tokens]
    arrays["token_at"] = np.cumsum([0, *map(len, text)]).astype(np.int64)
    arrays["token_bytes"] = np.frombuffer(b"".join(text), dtype=np.uint8)
    special = [t["id"] for t in spec["added_tokens"] if t["special"]]
    return pack(arrays | {"special": np.array(special, dtype=np.int32), "kinds": letter_classes()})


def merge_words(words: list[bytes], a: dict[str, np.ndarray]) -> list[bytes]:
    """Byte-pair merges of each word; the ids as little-endian 32-bit integers."""
    out = [b""] * len(words)
    by_length: dict[int, list[int]] = {}
    for i, n in enumerate(map(len, words)):
        by_length.setdefault(n, []).append(i)
    by_length.pop(0, None)
    for width, rows in by_length.items():
        raw = np.frombuffer(b"".join([words[i] for i in rows]), dtype=np.uint8).reshape(len(rows), width)
        for live, ids in merge_rows(raw, a):
            done, size = ids.astype("<u4").tobytes(), 4 * ids.shape[1]
            for k, i in enumerate(live.tolist()):
                out[rows[i]] = done[k * size : k * size + size]
    return out


NO_RANK = np.int32(2**31 - 1)
#: Words of up to so many bytes are merged many at once, round by round; longer ones each by a heap.
ROWS_UP_TO = 64


def pair_table(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Open-addressing table of pair keys, and the place of each key in ``pairs``; empty slots hold -1."""
    bits = max(10, int(len(pairs)).bit_length() + 2)
    slots, places = np.full(2**bits, -1, dtype=np.int64), np.full(2**bits, -1, dtype=np.int32)
    left = np.arange(len(pairs))
    at = _slot(pairs, bits)
    while len(left):
        free = slots[at[left]] < 0
        slots[at[left[free]]] = pairs[left[free]]  # of several keys for one slot the last stays
        places[at[left[free]]] = left[free]
        left = left[slots[at[left]] != pairs[left]]
        at[left] = (at[left] + 1) & (2**bits - 1)
    return slots, places


def _slot(key: np.ndarray, bits: int) -> np.ndarray:
    return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


def _ranks(left: np.ndarray, right: np.ndarray, a: dict[str, np.ndarray]) -> np.ndarray:
    """The rank of each pair, or NO_RANK."""
    key = left * a["size"][0] + right
    slots = a["slots"]
    at = _slot(key, len(slots).bit_length() - 1)
    found = slots[at]
    out = np.where(found == key, a["slot_rank"][at], NO_RANK)
    odd = np.flatnonzero((found != key) & (found >= 0))
    while len(odd):
        at[odd] = (at[odd] + 1) & (len(slots) - 1)
        found = slots[at[odd]]
        hit = found == key[odd]
        out[odd[hit]] = a["slot_rank"][at[odd[hit]]]
        odd = odd[~hit & (found >= 0)]
    return out


def merge_rows(raw: np.ndarray, a: dict[str, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Merge words of one length, the rows of ``raw``: the pair of the lowest rank first, the leftmost of equal ones.

    Each round merges one pair in every row that still has one, so rows stay of one length and need no padding. Yields
    the numbers of the rows that are done and a matrix of their ids.
    """
    step = max(1, 200_000 // raw.shape[1])
    for at in range(0, len(raw), step):
        part = raw[at : at + step]
        n, width = part.shape
        ids = a["inner"][part]
        ids[:, -1] = a["last"][part[:, -1]]
        rank = _ranks(ids[:, :-1].ravel(), ids[:, 1:].ravel(), a).reshape(n, width - 1)
        rows = np.arange(at, at + n)
        while ids.shape[1] > 1 and len(rows):
            best = rank.argmin(axis=1)
            least = rank[np.arange(len(rows)), best]
            more = least != NO_RANK
            if not more.all():
                yield rows[~more], ids[~more]
                rows, ids, rank, best, least = rows[more], ids[more], rank[more], best[more], least[more]
            m, width = ids.shape
            here = np.arange(m)
            made = a["made"][least]
            ids[here, best] = made
            keep = np.ones((m, width), dtype=bool)
            keep[here, best + 1] = False
            ids = ids[keep].reshape(m, width - 1)
            keep = np.ones((m, width - 1), dtype=bool)
            keep[here, best] = False
            rank = rank[keep].reshape(m, width - 2)
            on = np.flatnonzero(best < width - 2)
            rank[on, best[on]] = _ranks(made[on], ids[on, best[on] + 1], a)
            on = np.flatnonzero(best > 0)
            rank[on, best[on] - 1] = _ranks(ids[on, best[on] - 1], made[on], a)
        if len(rows):
            yield rows, ids


def automaton_depth(a: dict[str, np.ndarray]) -> int:
    """The bytes of the longest word of an automaton; targets come before the states that lead to them."""
    first, target = a["first"].tolist(), a["target"].tolist()
    height = [0] * (len(first) - 1)
    for s in range(len(height)):
        height[s] = max((1 + height[t] for t in target[first[s] : first[s + 1]]), default=0)
    return height[int(a["root"][0])]


#: Masks of the first bytes of a word in its two numbers, by its length.
LOW_MASK = np.array([(1 << 8 * min(n, 8)) - 1 for n in range(16)], dtype=np.uint64)
HIGH_MASK = np.array([(1 << 8 * max(0, n - 8)) - 1 for n in range(16)], dtype=np.uint64)


class WordTable:
    """Ids of words of up to 15 bytes, found many at once: open addressing on the word's own bytes, so nothing collides.

    A word is two 64-bit numbers, its bytes in order and its length in the last byte.
    """

    def __init__(self, bits: int = 20) -> None:
        self.bits = bits
        self.clear()

    def clear(self) -> None:
        self.low, self.high = np.zeros(2**self.bits, dtype=np.uint64), np.zeros(2**self.bits, dtype=np.uint64)
        self.at = np.full(2**self.bits, -1, dtype=np.int32)
        self.words, self.used = 0, 0
        self.ids = np.zeros(2**20, dtype=np.uint32)
        self.start, self.count = np.zeros(2**self.bits // 2, dtype=np.int64), np.zeros(2**self.bits // 2, dtype=np.int32)

    def slot(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        x = (low * np.uint64(0x9E3779B97F4A7C15)) ^ (high * np.uint64(0xC2B2AE3D27D4EB4F))
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        return (x >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The number of each word, -1 for those that are not here."""
        at = self.slot(low, high)
        out = self.at[at]
        odd = np.flatnonzero((out >= 0) & ((self.low[at] != low) | (self.high[at] != high)))
        while len(odd):
            at[odd] = (at[odd] + 1) & (2**self.bits - 1)
            out[odd] = self.at[at[odd]]
            odd = odd[(out[odd] >= 0) & ((self.low[at[odd]] != low[odd]) | (self.high[at[odd]] != high[odd]))]
        return out

    def add(self, low: np.ndarray, high: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> None:
        """Distinct words that are not here yet; ids: those of all words, in their order."""
        n = len(low)
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : self.used + len(ids)] = ids
        self.start[self.words : self.words + n] = self.used + np.cumsum(counts) - counts
        self.count[self.words : self.words + n] = counts
        left, at = np.arange(n), self.slot(low, high)
        while len(left):
            free = left[self.at[at[left]] < 0]
            self.at[at[free]] = self.words + free  # of several words for one slot the last stays
            won = free[self.at[at[free]] == self.words + free]
            self.low[at[won]], self.high[at[won]] = low[won], high[won]
            left = left[self.at[at[left]] != self.words + left]
            at[left] = (at[left] + 1) & (2**self.bits - 1)
        self.words += n
        self.used += len(ids)


#: First and last code points of letters and of numbers, and capitals with the distance to their small
#: letters, that the tokenizer's Unicode version knows and Python's does not.
YOUNG_LETTERS = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5),
    (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
)
YOUNG_NUMBERS = ((0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA))
YOUNG_CAPITALS = ((0x1C89, 0x1C89, 1), (0xA7CB, 0xA7CB, 0x264 - 0xA7CB), (0xA7CC, 0xA7CC, 1), (0xA7CE, 0xA7CE, 1), (0xA7D2, 0xA7D2, 1), (0xA7D4, 0xA7D4, 1), (0xA7DA, 0xA7DA, 1), (0xA7DC, 0xA7DC, 0x19B - 0xA7DC), (0x10D50, 0x10D65, 0x20), (0x16EA0, 0x16EB8, 0x1B))
LOWER = {c: chr(c + by) for first, last, by in YOUNG_CAPITALS for c in range(first, last + 1)}
YOUNG = re.compile("[" + "".join(map(chr, LOWER)) + "]")


def lowered(text: str) -> str:
    """The text as the tokenizer's normaliser gives it, but for white space: composed, and lower-case letter by letter."""
    if text.isascii():
        return text.lower()
    try:
        text.encode("latin-1")
        return text.lower()  # composed already
    except UnicodeEncodeError:
        pass
    text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # so that no final sigma comes out
    return (text.translate(LOWER) if YOUNG.search(text) else text).lower()


@lru_cache(maxsize=1)
def letter_classes() -> np.ndarray:
    """Of each code point: 0 white space, 1 letter, 2 number, 3 anything else."""
    of = {"L": 1, "N": 2}
    kinds = np.fromiter((of.get(unicodedata.category(chr(c))[0], 3) for c in range(0x110000)), dtype=np.uint8, count=0x110000)
    for kind, ranges in ((1, YOUNG_LETTERS), (2, YOUNG_NUMBERS)):
        for first, last in ranges:
            kinds[first : last + 1] = kind
    kinds[[ord(c) for c in SPACE_CHARS]] = 0
    return kinds


class Encoder:
    """Encodes texts to the ids of the tokenizer file that ``compile_lexicon`` read, and decodes ids."""

    def __init__(self, raw: bytes) -> None:
        self.a = unpack(mapped(raw))
        self.tokens: list[str] = []  # made when something is decoded
        self.special = {self.token(i): int(i).to_bytes(4, "little") for i in self.a["special"].tolist()}
        self.is_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.marks = tuple({s[:2] for s in self.special})
        self.kinds = self.a["kinds"]
        self.table = WordTable()
        self.depth = automaton_depth(self.a)
        self.wide: dict[bytes, bytes] = {}  # ids of words of more than 15 bytes
        self.rank_of: dict[int, int] | None = None
        # edges by (state, label), for lookups of many words at once
        first, label = self.a["first"].astype(np.int64), self.a["label"].astype(np.int64)
        self.edges = np.repeat(np.arange(len(first) - 1), np.diff(first)) * 256 + label

    def token(self, i: int) -> str:
        return self.a["token_bytes"][self.a["token_at"][i] : self.a["token_at"][i + 1]].tobytes().decode()

    def lookup(self, raw: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The id of each word (a row of bytes) that the automaton holds as a whole, else -1; all words step together."""
        out = np.full(len(raw), -1, dtype=np.int64)
        state, index = np.full(len(raw), int(self.a["root"][0])), np.zeros(len(raw), dtype=np.int64)
        on = np.flatnonzero(lengths > 0)
        for k in range(raw.shape[1]):
            ended = on[lengths[on] == k]
            ended = ended[self.a["final"][state[ended]] == 1]
            out[ended] = self.a["ids"][index[ended]]
            on = on[lengths[on] > k]
            if not len(on):
                return out
            key = state[on] * 256 + raw[on, k]
            at = np.minimum(np.searchsorted(self.edges, key), len(self.edges) - 1)
            hit = self.edges[at] == key
            on, at = on[hit], at[hit]
            state[on] = self.a["target"][at]
            index[on] += self.a["before"][at]
        ended = on[self.a["final"][state[on]] == 1]
        out[ended] = self.a["ids"][index[ended]]
        return out

    def learn(self, low: np.ndarray, high: np.ndarray) -> None:
        """Put new words into the table; a word may come more than once."""
        by = np.lexsort((low, high))
        low, high = low[by], high[by]
        new = np.concatenate([[True], (low[1:] != low[:-1]) | (high[1:] != high[:-1])])
        low, high = low[new], high[new]
        raw = np.stack([low, high], axis=1).astype("<u8").view(np.uint8)
        lengths = raw[:, 15].astype(np.int64)
        ids = self.lookup(raw[:, :15], lengths)
        unseen = np.flatnonzero(ids < 0)
        order, counts, found = [np.flatnonzero(ids >= 0)], [np.ones((ids >= 0).sum(), dtype=np.int64)], [ids[ids >= 0]]
        for width in np.unique(lengths[unseen]).tolist():
            rows = unseen[lengths[unseen] == width]
            for live, merged in merge_rows(raw[rows, :width], self.a):
                order.append(rows[live])
                counts.append(np.full(len(live), merged.shape[1]))
                found.append(merged.ravel())
        order = np.concatenate(order)
        self.table.add(low[order], high[order], np.concatenate(counts), np.concatenate(found))

    def ids_of_words(self, raw: bytes, buffer: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of ids of each word of ``raw``, at most MEMO words, and all their ids in order."""
        wide = buffer.view("<u8")
        word, bit = starts >> 3, (starts & 7).astype(np.uint64) * np.uint64(8)
        first, second, third = wide[word], wide[word + 1], wide[word + 2]
        left = (np.uint64(64) - bit) & np.uint64(63)
        none = bit == 0
        low = np.where(none, first, first >> bit | second << left)
        high = np.where(none, second, second >> bit | third << left)
        size = np.minimum(lengths, 15)
        low &= LOW_MASK[size]
        high &= HIGH_MASK[size]
        high |= size.astype(np.uint64) << np.uint64(56)
        long = np.flatnonzero(lengths > 15)
        low[long], high[long] = 0, 0
        known = self.table.find(low, high)
        known[long] = -2
        new = np.flatnonzero(known == -1)
        if len(new):
            if self.table.words + len(new) > MEMO:
                self.table.clear()
                new = np.flatnonzero(known != -2)
            self.learn(low[new], high[new])
            known[new] = self.table.find(low[new], high[new])
        counts, begin, store = self.table.count[known].astype(np.int64), self.table.start[known], self.table.ids[: self.table.used]
        if len(long):
            extra = self.ids_of_long([raw[i : i + n] for i, n in zip(starts[long].tolist(), lengths[long].tolist(), strict=True)])
            counts[long] = [len(x) // 4 for x in extra]
            begin[long] = 0
        ends = np.cumsum(counts)
        at = np.repeat(begin - (ends - counts), counts) + np.arange(ends[-1])
        if not len(long):
            return counts, store[at].astype("<u4")
        wide = np.zeros(len(counts), dtype=bool)
        wide[long] = True
        wide = np.repeat(wide, counts)
        out = np.empty(len(at), dtype="<u4")
        out[~wide], out[wide] = store[at[~wide]], np.frombuffer(b"".join(extra), dtype="<u4")
        return counts, out

    def ids_of_long(self, words: list[bytes]) -> list[bytes]:
        """The ids of words of more than 15 bytes: by the automaton where it is deep enough, else merged."""
        if len(self.wide) > MEMO // 8:
            self.wide.clear()
        known = self.wide
        new = list({w for w in words if w not in known})
        deep = [w for w in new if len(w) <= self.depth]
        own: dict[bytes, bytes] = {}
        if deep:
            lengths = np.array([len(w) for w in deep])
            raw = np.frombuffer(b"".join(w.ljust(self.depth, b"\0") for w in deep), dtype=np.uint8).reshape(len(deep), self.depth)
            own = {w: int(i).to_bytes(4, "little") for w, i in zip(deep, self.lookup(raw, lengths).tolist(), strict=True) if i >= 0}
        left = [w for w in new if w not in own]
        short = [w for w in left if len(w) <= ROWS_UP_TO]
        own.update(zip(short, merge_words(short, self.a), strict=True))
        own.update((w, self.merge_long(w)) for w in left if len(w) > ROWS_UP_TO)
        known.update((w, ids) for w, ids in own.items() if len(w) <= ROWS_UP_TO)
        return [known[w] if w in known else own[w] for w in words]

    def merge_long(self, word: bytes) -> bytes:
        """Byte-pair merges of one word of any length in n log n steps: a heap of pairs over a linked list of ids."""
        if self.rank_of is None:
            at = np.flatnonzero(self.a["slots"] >= 0)
            self.rank_of = dict(zip(self.a["slots"][at].tolist(), self.a["slot_rank"][at].tolist(), strict=True))
        rank_of, size, made = self.rank_of.get, int(self.a["size"][0]), self.a["made"].tolist()
        raw = np.frombuffer(word, dtype=np.uint8)
        ids = self.a["inner"][raw]
        ids[-1] = self.a["last"][raw[-1]]
        n = len(ids)
        first = _ranks(ids[:-1], ids[1:], self.a).astype(np.int64)
        heap = (first * n + np.arange(n - 1))[first != NO_RANK].tolist()  # rank, then place: the leftmost of equal ranks
        heapq.heapify(heap)
        ids, after, before = ids.tolist(), list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            rank, at = divmod(heapq.heappop(heap), n)
            right = after[at]
            if right >= n or ids[at] < 0 or rank_of(ids[at] * size + ids[right]) != rank:
                continue  # one of the two is part of a larger id by now
            ids[at] = made[rank]
            ids[right] = -1
            after[at] = follow = after[right]
            if follow < n:
                before[follow] = at
                if (r := rank_of(ids[at] * size + ids[follow])) is not None:
                    heapq.heappush(heap, r * n + at)
            if (prior := before[at]) >= 0 and (r := rank_of(ids[prior] * size + ids[at])) is not None:
                heapq.heappush(heap, r * n + prior)
        return np.array([i for i in ids if i >= 0], dtype="<u4").tobytes()

    def encode_plain(self, texts: list[str]) -> list[bytes]:
        """Texts that are normalised and without special tokens.

        Words are runs of letters, single numbers and runs of anything else but white space; an apostrophe that is such a
        run alone takes the letters of a contraction (s, t, m, d, re, ve, ll) with it.
        """
        raw = "\n".join(texts).encode()
        # a last white space ends the last word; 24 more bytes so that each word can be read as 16
        buffer = np.frombuffer(raw + b"\n" + b" " * (24 + -len(raw) % 8 + 7), dtype=np.uint8)
        buffer = buffer[: len(buffer) // 8 * 8]
        b = buffer[: len(raw) + 1]
        kinds = self.kinds[:256][b]
        lead = b >= 0xC0
        if lead.any():
            at = np.flatnonzero(lead)
            three = at[b[at] >= 0xE0]
            four = three[b[three] >= 0xF0]
            three = three[b[three] < 0xF0]
            two = at[b[at] < 0xE0]
            kinds[two] = kinds[two + 1] = self.kinds[(b[two].astype(np.int32) & 31) << 6 | b[two + 1] & 63]
            kinds[three] = kinds[three + 1] = kinds[three + 2] = self.kinds[(b[three].astype(np.int32) & 15) << 12 | (b[three + 1].astype(np.int32) & 63) << 6 | b[three + 2] & 63]
            if len(four):
                code = b[four].astype(np.int32) & 7
                for k in range(1, 4):
                    code = code << 6 | b[four + k] & 63
                for k in range(4):
                    kinds[four + k] = self.kinds[code]
        change = np.empty(len(b), dtype=bool)
        change[0] = True
        np.not_equal(kinds[1:], kinds[:-1], out=change[1:])
        change |= (kinds == 2) & ((b & 0xC0) != 0x80)
        bounds = np.flatnonzero(change)
        starts = bounds[:-1]
        lengths = np.diff(bounds)
        words = kinds[starts] != 0
        mark = np.flatnonzero((lengths == 1) & (b[starts] == 39))
        one, two = buffer[starts[mark] + 1], buffer[starts[mark] + 2]
        single = np.isin(one, np.frombuffer(b"stmd", dtype=np.uint8))
        double = ((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108)
        mark, taken = mark[single | double], (single + 2 * double)[single | double]
        lengths[mark] += taken
        starts[mark + 1] += taken
        lengths[mark + 1] -= taken
        words &= lengths > 0
        starts, lengths = starts[words], lengths[words]
        # a slice holds at most MEMO distinct words, so the table has room for them whatever the text
        parts = [self.ids_of_words(raw, buffer, starts[k : k + MEMO], lengths[k : k + MEMO]) for k in range(0, len(starts), MEMO)]
        counts = np.concatenate([c for c, _ in parts]) if parts else np.zeros(0, dtype=np.int64)
        ends = np.cumsum(counts)
        sizes = np.fromiter((len(t) if t.isascii() else len(t.encode()) for t in texts), dtype=np.int64, count=len(texts))
        cuts = np.searchsorted(starts, np.cumsum(sizes + 1))
        ends = np.concatenate([[0], ends])[cuts] * 4
        out, at = b"".join([ids.tobytes() for _, ids in parts]), [0, *ends.tolist()]
        return [out[i:j] for i, j in zip(at, at[1:], strict=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit integers."""
        out: list[bytes] = [b""] * len(texts)
        plain, rows = [], []
        for i, t in enumerate(texts):
            if not t:
                continue
            if self.is_special and any(m in t for m in self.marks) and self.is_special.search(t):
                out[i] = b"".join(self.special[p] if p in self.special else self.encode([p])[0] for p in self.is_special.split(t))
                continue
            t = lowered(t)
            plain.append(t)
            rows.append(i)
        if plain:
            for i, ids in zip(rows, self.encode_plain(plain), strict=True):
                out[i] = ids
        return out

    def decode(self, ids: bytes) -> str:
        """The text of ids as the tokenizer file's own decoding gives it: token strings joined by one space."""
        if not self.tokens:
            at, text = self.a["token_at"].tolist(), self.a["token_bytes"].tobytes()
            self.tokens = [text[i:j].decode() for i, j in zip(at, at[1:], strict=False)]
        return " ".join(map(self.tokens.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


_encoders: dict[str, Encoder] = {}


def encoder(raw: bytes) -> Encoder:
    """This worker's encoder for a compiled lexicon; its memo lives on from task to task."""
    key = hashlib.sha256(raw).hexdigest()
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(raw)
    return _encoders[key]


def runs_of_texts(column: pa.Array, most: int = 1_000_000) -> Iterator[tuple[int, int, list[str]]]:
    """(first row, end, texts) of runs of rows of a bounded number of bytes, so that memory does not follow the Arrow batch."""
    for i, j in slices(column, most):
        yield i, j, texts_of(column.slice(i, j - i))


def encode_documents(spark: SparkSession, docs: DataFrame, tokenizer_json: str, text: str = "text", out: str = "ids") -> DataFrame:
    """``docs`` with a binary column of ids (little-endian 32-bit) in place of nothing: all columns stay, one is added.

    A null text counts as empty and gives no ids; texts of any length are encoded whole; repeated rows give equal ids.
    A column that already has the name ``out`` is replaced.
    """
    shared = spark.sparkContext.broadcast(compile_lexicon(tokenizer_json))
    docs = docs.drop(out)
    place = docs.columns.index(text)
    schema = T.StructType(docs.schema.fields.copy()).add(out, "binary", True)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(shared.value)
        for batch in batches:
            ids = [x for _, _, texts in runs_of_texts(batch.column(place)) for x in enc.encode(texts)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.binary())], names=[*batch.schema.names, out])

    return docs.mapInArrow(run, schema)


def roundtrip_digests(spark: SparkSession, docs: DataFrame, tokenizer_json: str) -> DataFrame:
    """Per document the number of ids, the digest of the ids and the digest of their decoded text.

    One row per input row (repeated rows and null ids included); a null or empty text has 0 ids, and both digests are
    those of no bytes.
    """
    shared = spark.sparkContext.broadcast(compile_lexicon(tokenizer_json))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(shared.value)
        for batch in batches:
            counts, ids_sha, decoded_sha = [], [], []
            for _, _, texts in runs_of_texts(batch.column(1)):
                for ids in enc.encode(texts):
                    counts.append(len(ids) // 4)
                    ids_sha.append(hashlib.sha256(ids).hexdigest())
                    decoded_sha.append(hashlib.sha256(enc.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
