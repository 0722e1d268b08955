"""Choosing among scored candidates: best with a margin, stable argmax, fast path, uniqueness."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from libraryloom.functions import similarity
from libraryloom.functions.bounds import near_pairs, signatures
from libraryloom.operators.order import ranked
from libraryloom.sources.scratch import cut


def best_with_margin(scored: DataFrame, by: Sequence[str], candidate: str, score: str, threshold: float, margin: float) -> DataFrame:
    """The best candidate of each group, where it reaches ``threshold`` and leads the next one by ``margin``.

    A lone candidate leads by its whole score. Ties go to the least candidate, and then no margin is left. Each task first
    keeps its own two best of a group, so only these are brought together.
    """
    w = Window.partitionBy(*by).orderBy(F.desc(score), candidate)
    two = scored.withColumn("_rank", F.row_number().over(w)).filter("_rank <= 2")
    best = two.withColumn("runner_up", F.lead(score, 1, 0.0).over(w)).filter("_rank = 1").drop("_rank")
    return best.withColumn("accepted", (F.col(score) >= threshold) & (F.round(F.col(score) - F.col("runner_up"), 9) >= margin))


def stable_argmax(items: Column, score) -> Column:
    """struct(score, item) of an array's item of the highest score, the first of equals; nulls for no items.

    The whole array is folded in place, so nothing is exploded.
    """
    best = F.array_max(F.transform(items, lambda x, i: F.struct(score(x).alias("score"), (-i).alias("place"))))
    return F.struct(best["score"].alias("score"), F.get(items, -best["place"]).alias("item"))


def first_or_better(hits: DataFrame, by: Sequence[str], fast: str, score: str, place: str) -> DataFrame:
    """A hit of each group: the first on the fast path if there is one, else the first of the highest score."""
    order = [F.desc(fast), F.when(F.col(fast), F.col(place)), F.desc(score), F.col(place)]
    w = Window.partitionBy(*by).orderBy(*order)
    return hits.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")


def only_match(pairs: DataFrame, by: Sequence[str], candidate: str) -> DataFrame:
    """The candidate of each group that has exactly one distinct candidate."""
    found = pairs.groupBy(*by).agg(F.min(candidate).alias(candidate), F.max(candidate).alias("_other"))
    return found.filter(F.col(candidate) == F.col("_other")).drop("_other")


#: Similarities from which on texts meet under segments that they share; below the first one they are compared in blocks.
SEGMENTS = (0.9, 0.95)
#: The most texts of a block on either side, and pairs that are not worth a task of their own.
BLOCK, PAIRS = 65_536, 4_000_000
#: Kinds of lengths for e times the length.
LENGTHS = 32


def similar_texts(left: DataFrame, right: DataFrame, floor: float) -> DataFrame:
    """(text, other) of a text of ``left`` and one of ``right`` whose similarity can matter.

    ``left``: text and least, the similarity that its partners must be able to reach, never below ``floor``; ``right``:
    text. No pair whose ratio reaches ``least`` is missing, and those that stay have a common subsequence that allows it.
    Texts are looked at once however many rows have them; empty and null ones have no partner. Candidates meet by ``least``:

    * below ``SEGMENTS``: in blocks, where bounds on common letters leave out runs of like texts at once, and those on common
      letters and common neighbours of the rest are products of matrices (``bounds``). Such pairs share no part that is rare,
      so each may have to be looked at; a task holds one block of either side, and there are as many blocks as it takes to
      keep all tasks busy or as ``BLOCK`` asks for, so copies of texts are few;
    * from it on: under a segment that both have whole (``_by_segments``). Rows that meet hold numbers in place of texts.
    """
    c = F.col
    texts = cut(spread(left.filter("text <> ''").groupBy("text").agg(F.min("least").alias("least")), "text"), "texts")
    others = cut(spread(right.filter("text <> ''").select(c("text").alias("other")).distinct(), "other"), "others")
    found = None
    if floor < SEGMENTS[0]:
        found = _by_blocks(texts.filter(c("least") < SEGMENTS[0]), others)
    for low, high in zip(SEGMENTS, (*SEGMENTS[1:], None), strict=True):
        if high is None or floor < high:
            own = texts.filter((c("least") >= low) & (c("least") < high) if high else c("least") >= low)
            near = _by_segments(own, others, max(low, floor))
            near = near.filter(similarity.may_reach(c("text"), c("other"), c("least"))).select("text", "other")
            found = near if found is None else found.union(near)
    return found


def _blocks(n: int, m: int, tasks: int) -> tuple[int, int]:
    """Into how many blocks ``n`` and ``m`` texts are cut, so that both together are copied little."""
    wanted = min(4 * tasks, max(1, -(-n * m // PAIRS)))
    rows = min(max(n, 1), max(-(-n // BLOCK), round((wanted * n / max(m, 1)) ** 0.5), 1))
    return rows, max(-(-m // BLOCK), -(-wanted // rows), 1)


def _by_blocks(texts: DataFrame, others: DataFrame) -> DataFrame:
    c = F.col
    m = others.count()
    rows, columns = _blocks(texts.count(), m, _tasks(texts))
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    a = texts.withColumn("row", F.pmod(F.xxhash64("text"), F.lit(rows)).cast("int")).withColumn("column", every(columns))
    alike = F.array_join(F.sort_array(F.split("other", ""), asc=False), "")  # so runs of like letters are in one block
    placed = ranked(others, [F.length("other"), alike, "other"]) if columns > 1 else others.withColumn("place", F.lit(1))
    b = placed.withColumn("column", F.floor((c("place") - 1) * columns / m).cast("int")).drop("place").withColumn("row", every(rows))

    def compared(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        own, other = x["text"].to_numpy(dtype=object), y["other"].to_numpy(dtype=object)
        found = list(near_pairs(own.tolist(), x["least"].to_numpy(dtype=np.float64), other.tolist()))
        p, q = (np.concatenate(k) for k in zip(*found, strict=True)) if found else (np.zeros(0, dtype=np.int64),) * 2
        return pd.DataFrame({"text": own[p], "other": other[q]})

    by = ["row", "column"]
    a, b = spread(a, *by), spread(b, *by)
    return a.groupBy(*by).cogroup(b.groupBy(*by)).applyInPandas(compared, "text string, other string")


def _by_segments(texts: DataFrame, others: DataFrame, floor: float) -> DataFrame:
    """(text, other, least) of pairs that share a segment as pairs whose common subsequence allows ``floor`` must.

    Texts of n and m letters that reach ``floor`` leave d = n + m - 2 * common <= (1 - floor) * (n + m) letters without match.
    One is cut into more segments than the greatest such d of a kind of lengths of the other. Let each letter without match
    belong to a segment, those of the other text to the segment of the matched letter before them. The first segment i, from
    0, up to which no more than i letters are without match has none itself and exactly i before it: so it is whole in the
    other text, its place there differs from its own by a number s that is odd or even as i is and is at most i, and as d - i
    letters without match follow, n - m - s is at most that. Of letters put in or left out each turns one bit of a text's
    signature, so signatures differ in at most d bits. The side of fewer texts gives all its pieces, the other its segments.
    """
    c = F.col
    signature = F.pandas_udf(lambda x: pd.Series(signatures(x.tolist()).view(np.int64)), "long")
    side = lambda rows, text, *more: rows.select(c(text).alias("t"), *more, F.length(text).alias("n")).withColumn("id", F.monotonically_increasing_id())
    own = cut(side(texts, "text", c("least")).withColumn("signature", signature("t")), "own")
    other = cut(side(others, "other").withColumn("signature", signature("t")), "other")
    cutting, pieced = (own, other) if own.count() > other.count() else (other, own)
    kind = F.floor(F.log("n") * LENGTHS + 1e-9).cast("int")
    without = lambda both: F.floor((1 - floor) * both + 1e-9)
    low, high = F.ceil(floor * c("n") / (2 - floor) - 1e-9), F.floor((2 - floor) * c("n") / floor + 1e-9)
    of_length = lambda n: F.floor(F.log(F.greatest(n, F.lit(1))) * LENGTHS + 1e-9).cast("int")
    pieced = pieced.withColumn("kind", kind)
    kinds = F.broadcast(pieced.select("kind").distinct())  # a few numbers, as are lengths of segments

    longest = F.floor(F.exp((c("kind") + 1) / LENGTHS) + 1e-9)
    cuts = cutting.withColumn("kind", F.explode(F.sequence(of_length(low), of_length(high)))).join(kinds, "kind").withColumn("d", without(longest + c("n")).cast("int"))
    bound = lambda i: F.floor(i * c("n") / (c("d") + 1)).cast("int")
    segment = lambda i: F.struct(i.alias("i"), bound(i).alias("at"), (bound(i + 1) - bound(i)).alias("size"))
    cuts = cuts.withColumn("s", F.explode(F.transform(F.sequence(F.lit(0), "d"), segment))).select("id", "signature", "kind", "t", "n", "d", "s.*").filter("size > 0")
    key = lambda at: F.xxhash64("kind", F.substring("t", c(at) + 1, c("size")))
    sizes = F.broadcast(cuts.select("kind", "size").distinct())
    cuts = cuts.select(key("at").alias("key"), c("id").alias("cut_id"), c("signature").alias("cut_signature"), _packed("n", "d").alias("nd"), _packed("i", "at").alias("ia"))
    pieces = pieced.join(sizes, "kind").filter("size <= n").withColumn("place", F.explode(F.sequence(F.lit(0), c("n") - c("size"))))
    pieces = pieces.select(key("place").alias("key"), c("id").alias("piece_id"), "signature", _packed("n", "place").alias("np"))

    first, second = lambda x: F.shiftright(x, 32), lambda x: x.bitwiseAND(F.lit(0xFFFFFFFF))
    n, m = first("np"), first("nd")
    i, s = first("ia"), second(c("np")) - second(c("ia"))
    allowed = F.least(second(c("nd")), without(n + m))
    kept = (F.abs(s) <= i) & (F.pmod(i - s, F.lit(2)) == 0) & (F.abs(n - m - s) <= allowed - i)
    kept = kept & (F.bit_count(c("signature").bitwiseXOR(c("cut_signature"))) <= allowed)
    met = pieces.join(whole(cuts), "key").filter(kept).select("piece_id", "cut_id").distinct()
    a, b = ("cut_id", "piece_id") if cutting is own else ("piece_id", "cut_id")
    met = met.join(whole(own.select(c("id").alias(a), c("t").alias("text"), "least")), a).join(whole(other.select(c("id").alias(b), c("t").alias("other"))), b)
    return spread(met.select("text", "other", "least"), "text", "other")


def _packed(high: str, low: str) -> Column:
    """Two whole numbers in one, so that rows stay short."""
    return F.shiftleft(F.col(high).cast("long"), 32) + F.col(low)


def _tasks(rows: DataFrame) -> int:
    return int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def whole(rows: DataFrame) -> DataFrame:
    """``rows`` for a join by merging: Spark goes by the bytes of files, and a few MB of these may hold rows that fill the driver."""
    return rows.hint("merge")


def spread(rows: DataFrame, *by: str) -> DataFrame:
    """``rows`` dealt to all tasks: few bytes may be much work, and Spark joins small parts by their bytes."""
    return rows.repartition(_tasks(rows), *by)


#: Of the beginnings, and of the ends, that a text shares with others the longest ones that are followed.
SHARED = 3


def neighbours(left: DataFrame, right: DataFrame) -> DataFrame:
    """(text, other): for each text of ``left`` a few of ``right`` that begin or end as it does; which others there are is left open.

    Of the texts that share a beginning or an end of at least half of either two are taken, for the longest few of those that
    a text shares, so their number is bounded. Hashes stand for shared parts and for the others until few are left.
    """
    c = F.col

    def parts(rows: DataFrame, name: str) -> DataFrame:
        sizes = F.sequence(F.ceil(F.length(name) / 2).cast("int"), F.length(name))
        part = lambda k, cut: F.struct(k.alias("size"), cut(c(name), k).alias("part"))
        some = F.concat(F.transform(sizes, lambda k: part(k, lambda t, k: F.xxhash64(F.lit(0), F.left(t, k)))), F.transform(sizes, lambda k: part(k, lambda t, k: F.xxhash64(F.lit(1), F.right(t, k)))))
        return rows.filter(c(name) != "").select(F.xxhash64(name).alias(f"{name}_id"), F.explode(some).alias("p")).select(f"{name}_id", "p.size", "p.part")

    texts, others = left.select("text").distinct(), right.select(c("text").alias("other")).distinct()
    ends = parts(others, "other").groupBy("part").agg(F.min("other_id").alias("a"), F.max("other_id").alias("b"))
    met = parts(texts, "text").join(whole(ends), "part")
    longest = F.slice(F.sort_array(F.collect_list(F.struct("size", "a", "b")), asc=False), 1, 2 * SHARED)  # bounded by a text's length
    met = met.groupBy("text_id").agg(longest.alias("x")).select("text_id", F.explode("x").alias("x")).select("text_id", F.explode(F.array("x.a", "x.b")).alias("other_id")).distinct()
    return met.join(whole(texts.withColumn("text_id", F.xxhash64("text"))), "text_id").join(whole(others.withColumn("other_id", F.xxhash64("other"))), "other_id").select("text", "other")


def _grams(text: Column, size: Column | int) -> Column:
    """The distinct pieces of ``size`` characters of a text; none where it is shorter."""
    size = F.lit(size) if isinstance(size, int) else size
    count = F.length(text) - size + 1
    return F.when(count > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), count), lambda i: F.substring(text, i, size)))).otherwise(F.array().cast("array<string>"))


#: Letters of the word after a part's last inner word that go into a key, the most that it has.
BEGINNINGS = (6, 3, 1)
#: Pieces of a part without inner words among which the rarest is looked for.
PIECES = 8


def containing(parts: DataFrame, wholes: DataFrame, separator: str = " ", kind: str | None = None) -> DataFrame:
    """(part_id, whole_id) where a whole's text contains a part's. ``parts``: part_id, part; ``wholes``: whole_id, whole.

    All but a part's first and last word must be words of the whole, and the last one begins the word that follows there,
    so pairs meet under the part's rarest inner word, or under the last inner word with the beginning of the word after
    it where that is rarer, and only these are searched. A part of fewer than three words has none: it meets wholes under
    the rarest of a few of its pieces of three letters (of its own length, where it is shorter). Numbers stand for parts
    until few pairs are left, so rows of words and pieces are short. Null texts are contained in nothing, and an
    empty part is looked for nowhere. With ``kind``, a column of both sides, only rows of one kind are compared.
    """
    by = [kind] if kind else []
    words = lambda c: F.split(c, separator)
    inner = F.array_distinct(F.filter(F.slice(words(F.col("part")), 2, F.greatest(F.lit(0), F.size(words(F.col("part"))) - 2)), lambda w: w != ""))
    begun = lambda w, after, k: F.concat(w, F.lit("\0"), F.left(after, F.lit(k)))
    last, after = F.try_element_at(words(F.col("part")), F.lit(-2)), F.element_at(words(F.col("part")), -1)
    tail = F.coalesce(*[F.when(F.length(after) >= k, F.array(begun(last, after, k))) for k in BEGINNINGS], F.array().cast("array<string>"))
    inner = F.when(F.size(words(F.col("part"))) > 2, F.concat(inner, tail)).otherwise(F.array().cast("array<string>"))
    parts = parts.filter("part <> ''").select(*by, "part_id", "part").distinct().withColumn("_id", F.monotonically_increasing_id())
    parts = cut(parts, "parts")
    wholes = wholes.filter("whole IS NOT NULL").select(*by, "whole_id", "whole")
    keyed = parts.withColumn("_w", inner)
    size = F.least(F.lit(3), F.length("part"))
    count = F.length("part") - size + 1
    some = F.transform(F.sequence(F.lit(1), count, F.ceil(count / PIECES).cast("int")), lambda i: F.substring("part", i, size))
    short = keyed.filter(F.size("_w") == 0).withColumn("_w", F.array_distinct(some))
    long = keyed.filter(F.size("_w") > 0)

    def met(keyed: DataFrame, keys: Column) -> DataFrame:
        words = keyed.select(*by, "_id", F.explode("_w").alias("w"))
        held = wholes.select(*by, "whole_id", F.explode(keys).alias("w")).join(words.select(*by, "w").distinct(), [*by, "w"], "left_semi")
        often = held.groupBy(*by, "w").agg(F.count(F.lit(1)).alias("n"))
        rarest = words.join(often, [*by, "w"], "left").groupBy(*by, "_id").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "w")).alias("x"))
        rarest = rarest.filter("x.n > 0").select(*by, "_id", "x.w")  # else no whole has all words
        near = held.join(whole(rarest), [*by, "w"]).select(*by, "whole_id", "_id")
        near = near.join(whole(parts.select("_id", "part_id", "part")), "_id").join(whole(wholes), [*by, "whole_id"])
        return near.filter(F.col("whole").contains(F.col("part"))).select("part_id", "whole_id")

    pieces = F.array_distinct(F.concat(*[_grams(F.col("whole"), n) for n in (1, 2, 3)]))
    own = words(F.col("whole"))
    pairs = F.arrays_zip(F.slice(own, F.lit(1), F.size(own) - 1).alias("w"), F.slice(own, F.lit(2), F.size(own) - 1).alias("after"))
    tails = [F.transform(pairs, (lambda k: lambda x: F.when(F.length(x["after"]) >= k, begun(x["w"], x["after"], k)).otherwise(""))(k)) for k in BEGINNINGS]
    return met(long, F.array_distinct(F.concat(own, *tails))).union(met(short, pieces)).distinct()


def places(rows: DataFrame, group: Sequence[str], bucket: Sequence[Column], within: Sequence[Column], name: str = "place") -> DataFrame:
    """``rows`` with their place, from 1, in each group, in the order of ``within``; no task orders a whole group.

    ``bucket``: the leading part of that order, descending, such as the first letters of its first columns. Rows are
    ordered bucket by bucket, and only the buckets' sizes are added up along a group.
    """
    keys = [f"_b{k}" for k in range(len(bucket))]
    for key, column in zip(keys, bucket, strict=True):
        rows = rows.withColumn(key, column)
    sizes = rows.groupBy(*group, *keys).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy(*[F.desc(k) for k in keys]).rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    own = F.row_number().over(Window.partitionBy(*group, *keys).orderBy(*within))
    equal = [F.col(f"r.{k}").eqNullSafe(F.col(f"s.{k}")) for k in (*group, *keys)]
    joined = rows.withColumn("_own", own).alias("r").join(base.alias("s"), equal)
    return joined.select(*[f"r.{c}" for c in rows.columns if c not in keys], (F.col("s._base") + F.col("r._own")).alias(name))
