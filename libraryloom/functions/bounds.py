"""Bounds on the longest-blocks ratio for whole blocks of texts at once, as products of small matrices.

Matching blocks of two texts of a and b letters that sum to m leave a + b - 2m letters without match, and two blocks that
follow each other have one of these between them. So there are at most a + b - 2m + 1 blocks, and at least
3m - a - b - 1 neighbouring pairs of letters lie inside them. Both bounds may count too much, never too little.
"""

from __future__ import annotations

import numpy as np

from libraryloom.functions.similarity import common_subsequence

#: Kinds of letters (others share the last few), occurrences of one that are told apart, and kinds of neighbouring pairs.
KINDS, TIMES, PAIRS = 40, 3, 512
#: Texts of a side that are compared at once, texts of a run of like ones, and pairs whose common subsequence is looked for at once.
TILE, NARROW, CHUNK = 1024, 128, 65_536
#: Tiles of the left whose vectors are held at once.
TOGETHER = 16
#: Kinds of lengths for e times the length.
LENGTHS = 8
#: Letters of texts that are turned into numbers at once.
AT_ONCE = 4_000_000


def _kinds(texts: list[str]) -> np.ndarray:
    """Numbers of the texts' letters, -1 behind a text's end."""
    width = max(map(len, texts))
    code = np.array(texts, dtype=f"U{width}").view(np.uint32).reshape(len(texts), width).astype(np.int64)
    kind = np.where(code == 32, 0, 37 + code % (KINDS - 37))
    kind = np.where((code >= 48) & (code <= 57), code - 47, kind)
    kind = np.where((code >= 97) & (code <= 122), code - 86, kind)
    return np.where(np.arange(width) < np.array([len(t) for t in texts])[:, None], kind, -1)


def _counted(at: np.ndarray, kinds: int) -> np.ndarray:
    """How often each number from 0 occurs in each row."""
    rows = np.arange(len(at), dtype=np.int64)[:, None] * (kinds + 1)
    return np.bincount((rows + at + 1).ravel(), minlength=len(at) * (kinds + 1)).reshape(len(at), kinds + 1)[:, 1:]


def signatures(texts: list[str]) -> np.ndarray:
    """64 bits for each text, of which a letter that is put in or left out turns exactly one.

    A bit is turned for each letter and each time that it occurs, so two texts that leave d letters without match differ in
    at most d bits.
    """
    out = np.zeros(len(texts), dtype=np.uint64)
    if not texts:
        return out
    width = max(1, max(map(len, texts)))
    place = np.arange(KINDS, dtype=np.uint64)[:, None] * np.uint64(2654435761) + np.arange(width, dtype=np.uint64)[None, :] * np.uint64(2246822519)
    for factor in (739982445, 695872825):  # mixed, so letters that occur a little more or less often do not meet in a bit
        place = ((place ^ (place >> np.uint64(15))) * np.uint64(factor)) & np.uint64(0xFFFFFFFF)
    place = (place >> np.uint64(12)) % np.uint64(64)
    turned = np.zeros((KINDS, width + 1), dtype=np.uint64)
    turned[:, 1:] = np.bitwise_xor.accumulate(np.uint64(1) << place, axis=1)
    step = max(1, AT_ONCE // width)
    for at in range(0, len(texts), step):
        counts = _counted(_kinds(texts[at : at + step]), KINDS)
        out[at : at + step] = np.bitwise_xor.reduce(turned[np.arange(KINDS), counts], axis=1)
    return out


class Tile:
    """A few texts with the vectors that bounds are made of."""

    def __init__(self, texts: list[str]) -> None:
        self.texts = texts
        self.sizes = np.array([len(t) for t in texts], dtype=np.float32)
        self.kinds = _kinds(texts).astype(np.int8)
        counts = _counted(self.kinds, KINDS)
        self.letters = np.concatenate([counts > t for t in range(TIMES)], axis=1).astype(np.float32)
        self.rest = np.maximum(counts - TIMES, 0).sum(axis=1).astype(np.float32)
        self._pairs = None

    def pairs(self) -> np.ndarray:
        if self._pairs is None:
            here, after = self.kinds[:, :-1].astype(np.int64), self.kinds[:, 1:]
            self._pairs = _counted(np.where(after >= 0, (here * 16 + after) % PAIRS, -1), PAIRS).astype(np.float32)
        return self._pairs


def within_reach(a: Tile, b: Tile, least: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``a`` and ``b``, of ``rows`` and ``columns`` only, of the pairs whose ratio may reach the ``least`` of the text of ``a``."""
    both = a.sizes[rows, None] + b.sizes[columns]
    least = least[rows].astype(np.float32)[:, None]
    near = a.letters[rows] @ b.letters[columns].T
    near += np.minimum(a.rest[rows, None], b.rest[columns])
    near = 2 * near >= least * both - 1e-3
    inside = (1.5 * least - 1) * both - 1 - 1e-3
    if near.any() and inside.max() > 1 and near.mean() > 1e-3:
        near &= a.pairs()[rows] @ (b.pairs()[columns] > 0).astype(np.float32).T >= inside
    x, y = np.nonzero(near)
    return rows[x], columns[y]


class Covers:
    """What each ``NARROW`` texts, in their order, have at most: letters, and the least and greatest length."""

    def __init__(self, texts: list[str]) -> None:
        runs = [texts[k : k + NARROW] for k in range(0, len(texts), NARROW)]
        tiles = [Tile(run) for run in runs]
        self.letters = np.array([t.letters.max(axis=0) for t in tiles], dtype=np.float32)
        self.rest = np.array([t.rest.max() for t in tiles], dtype=np.float32)
        self.shortest = np.array([t.sizes.min() for t in tiles], dtype=np.float32)
        self.longest = np.array([t.sizes.max() for t in tiles], dtype=np.float32)

    def within_reach(self, a: Tile, least: np.ndarray) -> np.ndarray:
        """For each text of ``a`` and each run of texts whether one of them may reach the text's ``least``.

        With k letters in common the ratio is greatest for a partner of k letters, or of the length next to it.
        """
        common = a.letters @ self.letters.T + np.minimum(a.rest[:, None], self.rest)
        size = np.clip(common, self.shortest, self.longest)
        return 2 * np.minimum(common, size) >= least.astype(np.float32)[:, None] * (a.sizes[:, None] + size) - 1e-3


def _alike(texts: list[str]) -> np.ndarray:
    """The places of the texts, those of like lengths and like letters beside each other."""
    keys = [(int(np.log(len(t)) * LENGTHS), "".join(sorted(t, reverse=True))) for t in texts]
    return np.array(sorted(range(len(texts)), key=keys.__getitem__), dtype=np.int64)


def near_pairs(a: list[str], least: np.ndarray, b: list[str]):
    """(places in ``a``, places in ``b``) of all pairs whose common subsequence allows a ratio of ``least``, in parts.

    Texts are not empty. Those of ``b`` are put in runs of like letters; a run is opened only to the texts of ``a`` that could
    reach a text with all letters that occur in it. Vectors are made for a tile of either side at a time.
    """
    if not a or not b:
        return
    left, right = _alike(a), _alike(b)
    covers = Covers([b[j] for j in right])
    p, q, held = [], [], 0

    def kept() -> tuple[np.ndarray, np.ndarray]:
        x, y = np.concatenate(p), np.concatenate(q)
        texts, others = [a[i] for i in x], [b[j] for j in y]
        both = np.array([len(t) + len(o) for t, o in zip(texts, others, strict=True)], dtype=np.float64)
        near = 2.0 * common_subsequence(texts, others) >= least[x] * both - 1e-9
        return x[near], y[near]

    for start in range(0, len(a), TILE * TOGETHER):
        places = [left[i : i + TILE] for i in range(start, min(start + TILE * TOGETHER, len(a)), TILE)]
        owns = [(at, Tile([a[j] for j in at]), least[at]) for at in places]
        opened = [covers.within_reach(own, goal) for _, own, goal in owns]
        for k in range(0, len(b), TILE):
            runs = slice(k // NARROW, (k + TILE) // NARROW)
            if not any(near[:, runs].any() for near in opened):
                continue
            at_right = right[k : k + TILE]
            other = Tile([b[j] for j in at_right])
            for (at_left, own, goal), near in zip(owns, opened, strict=True):
                for rows, columns in _parts(near[:, runs], len(at_right)):
                    x, y = within_reach(own, other, goal, rows, columns)
                    for at in range(0, len(x), CHUNK):
                        p.append(at_left[x[at : at + CHUNK]])
                        q.append(at_right[y[at : at + CHUNK]])
                        held += len(p[-1])
                        if held >= CHUNK:
                            yield kept()
                            p, q, held = [], [], 0
    if held:
        yield kept()


def _parts(near: np.ndarray, size: int):
    """(places of the left, places of the right) to compare: run by run, or at once where much is open."""
    if near.mean() > 0.2:
        yield np.flatnonzero(near.any(axis=1)), np.arange(size)
    else:
        for r in np.flatnonzero(near.any(axis=0)):
            yield np.flatnonzero(near[:, r]), np.arange(r * NARROW, min((r + 1) * NARROW, size))
