"""Best-fit packing of tokenised documents into sequences of a fixed capacity.

Sizes are whole numbers up to the capacity, so an instance of any number of pieces is a histogram of at most
``capacity`` counts. The driver solves the histogram: a Martello-Toth dominance reduction fixes small sets that
provably dominate every other set with the same largest piece, and best-fit decreasing packs what is left. The plan is
a list of intervals (size, ranks, first sequence, offset); Spark ranks the pieces of each size and looks their interval
up in a broadcast table of at most ``capacity`` rows. Only counts by size and the plan pass through the driver, both bounded by the capacity.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from libraryloom.llm.bpe import compile_lexicon, encoder, runs_of_texts
from libraryloom.llm.common import cut

CAPACITY = 2048
#: Pieces of one size that are ranked together in one task, about.
RANKED_TOGETHER = 20_000


@dataclass
class Plan:
    """Intervals of ranks: pieces ``rank`` to ``rank + count`` of ``size`` go to ``sequence``, ``sequence + 1``, ... at ``offset``."""

    capacity: int
    intervals: list[tuple[int, int, int, int, int]] = field(default_factory=list)
    sequences: int = 0
    fixed: int = 0  # sequences that the reduction fixed

    def place(self, size: int, taken: dict[int, int], count: int, sequence: int, offset: int) -> None:
        self.intervals.append((size, taken[size], count, sequence, offset))
        taken[size] += count


def dominating(sizes: list[int], left: dict[int, int], big: int, capacity: int) -> tuple[int, ...] | None:
    """A set of companions for one piece of size ``big`` that dominates every feasible set with it; else None.

    A set dominates another if the other's pieces can be grouped so that each group is no larger than one piece of the
    set; then some optimal packing holds the set. Companions are sought up to two, as in the published procedure.
    ``sizes``: ascending, all sizes with pieces left, those too that were passed over before.
    """
    left[big] -= 1
    have = [s for s in sizes if left[s]]
    free = capacity - big
    try:
        at = bisect.bisect_right(have, free) - 1
        if at < 0:
            return ()
        one = have[at]
        if one == free:
            return (one,)
        smallest = []
        for s in have[:3]:
            smallest += [s] * min(3, left[s])
        if len(smallest) < 2 or free < smallest[0] + smallest[1]:
            return (one,)
        if len(smallest) >= 3 and free >= sum(smallest[:3]):
            return None

        # at most two more fit: the largest pair sum, and the largest piece that can be the smaller one of a pair
        best = lesser = 0
        for i, s in enumerate(have[: at + 1]):
            if 2 * s > free:
                break
            j = bisect.bisect_right(have, free - s) - 1
            if j > i or j == i and left[s] > 1:
                best, lesser = max(best, s + have[j]), max(lesser, s)
        if best <= one:
            return (one,)
        left[one] -= 1
        j = bisect.bisect_right(have, free - one) - 1
        while j >= 0 and not left[have[j]]:
            j -= 1
        left[one] += 1
        return (one, have[j]) if j >= 0 and have[j] >= lesser else None
    finally:
        left[big] += 1


def solve(histogram: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """Pack ``histogram`` (count by size, sizes 1 to ``capacity``) into few sequences.

    Work and plan depend on the number of distinct sizes, not on the number of pieces: equal steps are taken at once.
    """
    plan = Plan(capacity)
    left = {s: n for s, n in histogram.items() if n > 0}
    taken = dict.fromkeys(left, 0)
    sizes = sorted(left)
    order, k = sizes[::-1], 0
    while k < len(order):  # the reduction, from the largest size down
        big = order[k]
        mates = dominating(sizes, left, big, capacity) if left[big] else None
        if mates is None:
            k += 1
            continue
        need: dict[int, int] = {}
        for s in (big, *mates):
            need[s] = need.get(s, 0) + 1
        times = min(left[s] // k for s, k in need.items())
        if len(mates) > 1:
            times = 1  # the argument for pairs looks at counts, which change
        offset = 0
        for s in (big, *mates):
            plan.place(s, taken, times, plan.sequences, offset)
            offset += s
            left[s] -= times
        plan.sequences += times
        sizes = [s for s in sizes if left[s]]
    plan.fixed = plan.sequences
    rest = {s: left[s] for s in sizes}

    bins: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # by space left: (first sequence, count)
    spaces: list[int] = []  # those with bins, ascending

    def put(space: int, first: int, count: int) -> None:
        if space and count:
            if not bins[space]:
                bisect.insort(spaces, space)
            bins[space].append((first, count))

    for size in sorted(rest, reverse=True):
        n = rest[size]
        while n:
            at = bisect.bisect_left(spaces, size)
            if at < len(spaces):
                space = spaces[at]
                first, count = bins[space].pop()
                if not bins[space]:
                    spaces.pop(at)
                times = min(n, count)
                plan.place(size, taken, times, first, capacity - space)
                put(space, first + times, count - times)
                put(space - size, first, times)
                n -= times
                continue
            each = min(capacity // size, n)
            times = n // each
            for k in range(each):
                plan.place(size, taken, times, plan.sequences, k * size)
            put(capacity - each * size, plan.sequences, times)
            plan.sequences += times
            n -= each * times
    return plan


def pieces(spark: SparkSession, docs: DataFrame, tokenizer_json: str, capacity: int = CAPACITY) -> DataFrame:
    """Token pieces of documents: each document's ids and a closing id 0; longer ones are cut every ``capacity`` ids.

    A null text counts as empty and gives one piece of the closing id; repeated rows give repeated pieces.
    """
    shared = spark.sparkContext.broadcast(compile_lexicon(tokenizer_json))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(shared.value)
        for batch in batches:
            for i, j, texts in runs_of_texts(batch.column(1)):
                rows = []
                for doc, ids in zip(batch.column(0).slice(i, j - i).to_pylist(), enc.encode(texts), strict=True):
                    ids += b"\0\0\0\0"
                    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[at : at + 4 * capacity]
                        rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part)))
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def pack(items: DataFrame, capacity: int = CAPACITY) -> tuple[DataFrame, Plan]:
    """``items`` (a written table with doc_id, piece and length from 1 to ``capacity``) with sequence_id and offset.

    Equal pieces are interchangeable; an empty table gives an empty result.
    """
    spark = items.sparkSession
    n = items.count()
    buckets = max(16, n // RANKED_TOGETHER)
    items = items.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    counts = items.groupBy("length", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    plan = solve(histogram, capacity)
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    within = Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece")
    ranked = items.withColumn("_rank", F.row_number().over(within) - 1).join(base, ["length", "_bucket"])
    ranked = ranked.withColumn("_rank", F.col("_rank") + F.col("_base"))

    steps: dict[int, list[tuple[int, int, int]]] = {}
    for size, rank, _, sequence, offset in sorted(plan.intervals):
        steps.setdefault(size, []).append((rank, sequence, offset))
    where = "length long, steps array<struct<rank:long,sequence:long,offset:long>>"
    where = F.broadcast(spark.createDataFrame([(size, found) for size, found in steps.items()], where))  # at most ``capacity`` rows
    own = F.element_at(F.filter("steps", lambda s: s["rank"] <= F.col("_rank")), -1)
    placed = ranked.join(where, "length").withColumn("_at", own)
    out = ["doc_id", "piece", "start", "length", "ids_crc32"]
    return placed.select(*out, (F.col("_at.sequence") + F.col("_rank") - F.col("_at.rank")).alias("sequence_id"), F.col("_at.offset").alias("offset")), plan


def pack_documents(spark: SparkSession, docs: DataFrame, tokenizer_json: str, capacity: int = CAPACITY) -> DataFrame:
    """Tokenise and pack ``docs``: one row per piece with its sequence and its place there, gapless from 0.

    Null ids are kept as null; null texts count as empty; every document has a piece, as it ends in id 0; texts of any
    length are cut into pieces. Pieces of equal length are interchangeable, so ties go by hash bucket, id and piece, and
    repeated rows each have a place. Other columns are left out; an empty table gives an empty result.
    """
    return pack(cut(pieces(spark, docs, tokenizer_json, capacity), "pieces"), capacity)[0]
