"""Title similarity by the longest-matching-blocks ratio of the standard library, and scores built on it.

Spark has no such function, so pairs go through an Arrow UDF; a sound native bound (``letters``) drops most pairs before it. The
ratio is not symmetric: the first argument is the one that callers name first.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from libraryloom.functions.text import normalize_title


def _ratios(a: pd.Series, b: pd.Series) -> pd.Series:
    matcher = SequenceMatcher(None)
    out = []
    for x, y in zip(a, b, strict=True):
        matcher.set_seqs(x or "", y or "")
        out.append(matcher.ratio())
    return pd.Series(out, dtype="float64")


def _ratio(a: Column, b: Column) -> Column:
    return F.pandas_udf(_ratios, "double")(a, b)  # made late, as it needs a session


#: How often letters occur in English titles and names, in thousandths; others are taken to be rare.
FREQUENCY = {**dict.fromkeys("0123456789", 60), " ": 180, "e": 127, "t": 91, "a": 82, "o": 75, "i": 70, "n": 67, "s": 63, "h": 61, "r": 60, "d": 43, "l": 40, "u": 28, "c": 28, "m": 24, "w": 24, "f": 22, "g": 20, "y": 20, "p": 19, "b": 15, "v": 10, "k": 8, "j": 2, "x": 2, "q": 1, "z": 1}


def letters(text: Column) -> Column:
    """The letters of a text as distinct numbers, one for each letter and each time that it occurs, the rarest first.

    Two texts share as many of them as they can have letters in common. The order is the same for all texts; which it is
    makes no difference but in speed.
    """
    often = F.create_map(*[F.lit(x) for pair in FREQUENCY.items() for x in pair])

    def number(x: Column, time: Column) -> Column:
        rank = F.floor(1000 * F.coalesce(often[x], F.lit(1)) / time)
        return F.shiftleft(rank.cast("long"), 40) + F.shiftleft(F.ascii(x).cast("long"), 20) + time

    def numbered(xs: Column) -> Column:
        return F.sort_array(F.transform(xs, lambda x, i: number(x, i - F.array_position(xs, x).cast("int") + 2)))

    found = F.sort_array(F.filter(F.split(text, ""), lambda x: x != ""))
    return F.element_at(F.transform(F.array(found), numbered), 1)


#: Occurrences of a letter that have bits of their own in ``letter_bits``.
TIMES = 3


def letter_bits(numbers: Column) -> Column:
    """Numbers of ``letters`` as bits: a long for each of the first ``TIMES`` occurrences, and how many are left over."""

    def place(x: Column) -> Column:
        code = F.shiftright(x, 20).bitwiseAND(F.lit(0xFFFFF))
        return F.when(code == 32, 36).when(code.between(48, 57), code - 22).when(code.between(97, 122), code - 97)

    def bits(time: int) -> Column:
        own = F.filter(numbers, lambda x: (x.bitwiseAND(F.lit(0xFFFFF)) == time) & place(x).isNotNull())
        return F.aggregate(own, F.lit(0).cast("long"), lambda m, x: m.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), place(x).cast("int"))))

    masks = [bits(t + 1) for t in range(TIMES)]
    held = sum((F.bit_count(m) for m in masks[1:]), F.bit_count(masks[0]))
    return F.struct(F.array(*masks).alias("masks"), (F.size(numbers) - held).alias("rest"))


def common_letters(a: list[Column], rest_a: Column, b: list[Column], rest_b: Column) -> Column:
    """At least how many letters two texts have in common, from the masks and rests of their ``letter_bits``."""
    return sum((F.bit_count(x.bitwiseAND(y)) for x, y in zip(a, b, strict=True)), F.least(rest_a, rest_b))


#: Bits of a machine word: the longest text that ``common_subsequence`` holds in one.
WORD = 64


def common_subsequence(a: list[str], b: list[str]) -> np.ndarray:
    """For each pair at least the length of the longest common subsequence, all pairs at once, a bit for each letter of one.

    It is exact but for letters whose code points agree modulo 64, which count as equal, and for pairs of two texts of more
    than 64 letters, which get the shorter length.
    """
    sizes_a, sizes_b = np.array([len(x) for x in a], dtype=np.int64), np.array([len(x) for x in b], dtype=np.int64)
    out = np.minimum(sizes_a, sizes_b)
    fits = np.flatnonzero((out <= WORD) & (out > 0))
    if not len(fits):
        return out
    short = [a[i] if sizes_a[i] <= sizes_b[i] else b[i] for i in fits]
    long = [b[i] if sizes_a[i] <= sizes_b[i] else a[i] for i in fits]
    width = max(map(len, long))
    x = np.array(short, dtype=f"U{WORD}").view(np.uint32).reshape(len(fits), WORD)
    y = np.ascontiguousarray(np.array(long, dtype=f"U{width}").view(np.uint32).reshape(len(fits), width).T)
    rows = np.arange(len(fits))
    masks = np.zeros((len(fits), WORD), dtype=np.uint64)
    for i in range(int(out[fits].max())):
        masks[rows, x[:, i] % WORD] |= np.where(x[:, i] > 0, np.uint64(1) << np.uint64(i), np.uint64(0))
    free = np.full(len(fits), 2**64 - 1, dtype=np.uint64)
    for letter in y:
        u = free & masks[rows, letter % WORD]
        free = np.where(letter > 0, (free + u) | (free - u), free)
    out[fits] = np.bitwise_count(~free)
    return out


def _may_reach(a: pd.Series, b: pd.Series, least: pd.Series) -> pd.Series:
    x, y = a.tolist(), b.tolist()
    both = np.array([len(i) + len(j) for i, j in zip(x, y, strict=True)], dtype=np.float64)
    return pd.Series(2.0 * common_subsequence(x, y) >= least.to_numpy() * both - 1e-9)


def may_reach(a: Column, b: Column, least: Column) -> Column:
    """False where the ratio of two texts cannot reach ``least``: matching blocks are a common subsequence.

    Declared nondeterministic, so that Spark leaves it where it stands and does not look at pairs before they are distinct.
    """
    return F.pandas_udf(_may_reach, "boolean").asNondeterministic()(a, b, least)


def similarity(a: Column, b: Column) -> Column:
    """Ratio of two normalised strings."""
    return _ratio(a, b)


def title_similarity(a: Column, b: Column) -> Column:
    return _ratio(normalize_title(a), normalize_title(b))


def fuzzy_parts(name: Column, slug: Column, title: Column, ids: Column, raw_name: Column, meta: Column, first_page: Column) -> tuple[Column, Column, Column]:
    """(whether an identifier decides, what containment gives, what the year adds) of ``fuzzy_score``; no similarity in them."""
    has = lambda c: F.coalesce(c, F.lit("")) != ""
    within = lambda a, b: F.coalesce(has(a) & has(b) & (a.contains(b) | b.contains(a)), F.lit(False))
    zero = F.lit(0.0)
    held = F.greatest(
        F.when(within(name, slug) | within(name, title), 0.85).otherwise(zero),
        F.when(within(meta, title), 0.90).otherwise(zero),
        F.when(F.coalesce(has(first_page) & has(title) & first_page.contains(title), F.lit(False)), 0.90).otherwise(zero),
    )
    year = F.regexp_extract(F.coalesce(slug, F.lit("")), "\\b((?:19|20)[0-9]{2})\\b", 1)
    decisive = F.exists(F.coalesce(ids, F.array().cast("array<string>")), lambda i: (i != "") & raw_name.contains(i))
    return F.coalesce(decisive, F.lit(False)), held, F.when((year != "") & name.contains(year), 0.10).otherwise(zero)


def fuzzy_score(name: Column, slug: Column, title: Column, ids: Column, raw_name: Column, meta: Column, first_page: Column) -> Column:
    """How likely a file is a record's missing original, 0 to 1. All but ``raw_name`` and ``ids`` are normalised."""
    decisive, held, year = fuzzy_parts(name, slug, title, ids, raw_name, meta, first_page)
    pair = lambda a, b: F.when((a != "") & (b != ""), _ratio(a, b)).otherwise(F.lit(0.0))
    none = lambda c: F.coalesce(c, F.lit(""))
    best = F.greatest(F.when(none(slug) != "", _ratio(name, slug)).otherwise(F.lit(0.0)), F.when(none(title) != "", _ratio(name, title)).otherwise(F.lit(0.0)), held, pair(none(meta), none(title))) + year
    return F.when(decisive, 0.95).otherwise(F.least(best, F.lit(1.0)))
