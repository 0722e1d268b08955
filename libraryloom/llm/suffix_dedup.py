"""Removal of repeated passages by distributed prefix doubling.

Every byte covered by a 100-byte string that also starts earlier (in a smaller document, or earlier in the same one) is
removed. Rows of (position, pair of names) are sorted by Spark at growing offsets and ranked anew; a position leaves the
rounds as soon as its rank is unique:

1. offset 25, 25 to 50 bytes: the pair of 25-byte names at a position and 25 bytes on gives the rank of its 50 bytes. Only
   sampled positions take part, the least 50-byte name of each 100-byte window (its anchor), about one in 26: equal
   windows have their anchors at equal places, so no repeat is missed where the others are left out.
2. neighbouring windows that share an anchor make a run. Of runs that are equal as a whole (rank and rest) the first
   stands for all; the others are repeats already.
3. offsets -25 and 50, 50 to 75 bytes: the rank with the 25-byte name before or behind it. A 100-byte window holds one of
   the two, so windows whose rank is unique on that side leave.
4. offset 50, 50 to 100 bytes: the pair of 50-byte names of every window left, past the threshold. Of equal pairs the
   first stays and the others are repeats.

A name is a 64-bit number that equal bytes share wherever they lie; windows are held equal by a pair of them, 128 bits, so
among the 1e14 positions of 100 TB less than one wrong pair in 1e10 such corpora is to be expected.

Texts are dealt once into a bucketed table of blocks. A block sends what is distinct in it, so a name that a third of the
corpus shares costs one row for each block in the task that sorts it; where rows of one rank may be many (round 3) they
are counted on the map side and joined back, which may be split.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from libraryloom.llm.common import NULL_ID, cut, fresh_path, powers, prefix_sums, span_hash, splitmix, unused, utf8_of

LENGTH = 100
HALF, QUARTER = 50, 25
WINDOWS = LENGTH - HALF + 1  # places of a 50-byte name in a window
CHUNK = 1 << 19
#: Bytes of text in a block, the rows that one call of Python holds, blocks in a partition, and bytes of text for each
#: partition of a sort. Their numbers follow the corpus, with LEAST of each; partitions are never more than MOST, so that a
#: shuffle stays one that Spark can plan: beyond that a partition holds more blocks, one after the other, and a sort spills.
BLOCK_BYTES = 4_000_000
TOGETHER = 4
SORT_BYTES = 16_000_000
LEAST = 8
MOST = 50_000
ALL = np.uint64(2**64 - 1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _buffers(texts: list[bytes]) -> Iterator[list[tuple[int, int, int]]]:
    """Segments (text, begin, end) that together have at most CHUNK bytes; longer texts are cut with 99 bytes in common."""
    out: list[tuple[int, int, int]] = []
    total = 0
    for i, t in enumerate(texts):
        for begin in range(0, max(1, len(t) - LENGTH + 1), CHUNK - LENGTH + 1):
            end = min(len(t), begin + CHUNK)
            if end - begin < LENGTH:
                continue
            if total + end - begin > CHUNK and out:
                yield out
                out, total = [], 0
            out.append((i, begin, end))
            total += end - begin
    if out:
        yield out


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours, by prefix and suffix minima of blocks."""
    n = len(x) - width + 1
    rows = -(-len(x) // width)
    full = np.full(rows * width, ALL)
    full[: len(x)] = x
    full = full.reshape(rows, width)
    left = np.minimum.accumulate(full, axis=1).ravel()
    right = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[width - 1 : width - 1 + n])


def _quarters(sums: np.ndarray) -> np.ndarray:
    """The name of the 25 bytes at each place."""
    return splitmix((sums[QUARTER:] - sums[:-QUARTER]) * powers(len(sums))[1][: len(sums) - QUARTER])


def _pairs(quarter: np.ndarray) -> np.ndarray:
    """The name of the 50 bytes at each place: that of the pair of its quarters."""
    return splitmix(quarter[:-QUARTER] * _MIX + quarter[QUARTER:])


def runs(texts: list[bytes], full: bool = True) -> Iterator[tuple[np.ndarray, ...]]:
    """The runs of windows that share an anchor, in order: text, anchor, first window, last window, names of 25 bytes.

    Names are those at the anchor and 25 bytes on, then (``full``) of the whole run, and of the 25 bytes before and
    behind the 50 bytes, 0 where the run does not hold them.
    """
    for segments in _buffers(texts):
        b = np.frombuffer(b"".join(texts[i][s:e] for i, s, e in segments), dtype=np.uint8)
        n = len(b)
        sums = prefix_sums(b)
        quarter = _quarters(sums)
        order = (_pairs(quarter) >> np.uint64(20) << np.uint64(20)) | np.arange(n - HALF + 1, dtype=np.uint64)
        anchor = (_sliding_min(order, WINDOWS) & np.uint64((1 << 20) - 1)).astype(np.int64)
        lengths = np.array([e - s for _, s, e in segments])
        begins = np.cumsum(lengths) - lengths
        valid = np.zeros(n - LENGTH + 2, dtype=np.int8)
        np.add.at(valid, begins, 1)
        np.add.at(valid, begins + lengths - LENGTH + 1, -1)
        at = np.flatnonzero(np.cumsum(valid)[:-1])
        of = anchor[at]
        new = np.concatenate([[True], (of[1:] != of[:-1]) | (at[1:] != at[:-1] + 1)])
        first = np.flatnonzero(new)
        last = np.concatenate([first[1:], [len(at)]]) - 1
        low, high, mid = at[first], at[last], of[first]
        segment = np.searchsorted(begins, low, side="right") - 1
        text, shift = np.array([i for i, _, _ in segments])[segment], (np.array([s for _, s, _ in segments]) - begins)[segment]
        out = (text, mid + shift, low + shift, high + shift, quarter[mid], quarter[mid + QUARTER])
        if full:
            whole = span_hash(sums, low, high + LENGTH)
            left = np.where(mid - low >= QUARTER, quarter[mid - QUARTER], np.uint64(0))  # a place before the first byte is never taken
            right = np.where(high + LENGTH >= mid + HALF + QUARTER, quarter[np.minimum(mid + HALF, len(quarter) - 1)], np.uint64(0))
            out += (whole, left, right)
        yield out


def windows(texts: list[bytes], text: np.ndarray, low: np.ndarray, high: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(text, start, name of 50 bytes there, name 50 bytes on) of the windows from ``low`` to ``high``, run by run."""
    size = high - low + LENGTH
    ends = np.cumsum(size)
    for at in np.split(np.arange(len(text)), np.flatnonzero(np.diff(ends // CHUNK)) + 1) if len(text) else []:
        rows = zip(text[at].tolist(), low[at].tolist(), high[at].tolist(), strict=True)
        name = _pairs(_quarters(prefix_sums(np.frombuffer(b"".join([texts[t][a : z + LENGTH] for t, a, z in rows]), dtype=np.uint8))))
        count = high[at] - low[at] + 1
        inside = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        place = np.repeat(np.cumsum(size[at]) - size[at], count) + inside
        yield np.repeat(text[at], count), np.repeat(low[at], count) + inside, name[place], name[place + HALF]


class Block:
    """The texts of a block in order, each distinct (document, text) once."""

    def __init__(self, table: pa.Table) -> None:
        ids, subs, body = table.column(0).to_numpy(), table.column(1).to_numpy(), utf8_of(table.column(2))
        order = np.lexsort((subs, ids))
        new = np.concatenate([[True], (np.diff(ids[order]) != 0) | (np.diff(subs[order]) != 0)])[: len(order)]
        self.ids, self.subs = ids[order][new], subs[order][new]
        self.texts = [body[i] for i in order[new].tolist()]
        self.row_of = np.empty(len(order), dtype=np.int64)
        self.row_of[order] = np.cumsum(new) - 1


def _columns(parts: Iterable[tuple[np.ndarray, ...]]) -> list[np.ndarray]:
    parts = list(parts)
    return [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else []


def _first_of(*keys: np.ndarray) -> np.ndarray:
    """Whether each row is the first of those with its keys."""
    by = np.lexsort(keys[::-1])  # stable, so equal rows stay in order
    new = np.zeros(len(by), dtype=bool)
    new[:1] = True
    for k in keys:
        k = k[by]
        new[1:] |= k[1:] != k[:-1]
    out = np.empty(len(by), dtype=bool)
    out[by] = new
    return out


def _merged(text: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, ...]:
    """Stretches of windows, in order, with those that follow each other put together."""
    if not len(text):
        return text, low, high
    new = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (low[1:] > high[:-1] + 1)]))
    return text[new], low[new], np.maximum.reduceat(high, new)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64) if x.dtype == np.uint64 else x)


def _rows(fields: str, **columns) -> pa.Table:
    """A table of ``fields`` (DDL); missing ones are 0."""
    n = next(len(x) for x in columns.values() if not np.isscalar(x))
    kinds = {"int": pa.int32(), "long": pa.int64()}
    out = {}
    for name, kind in (f.split() for f in fields.split(", ")):
        value = columns.get(name, 0)
        value = np.full(n, value, dtype=np.int64) if np.isscalar(value) else value
        out[name] = _signed(value).cast(kinds[kind])
    return pa.table(out)


NAMED = "a long, b long, block int, times int"
KNOWN = "block int, name long, rank long"
#: ``first`` 1: the first run of its kind in the block; 0: windows from low to high are repeats within the block.
RUNS = "block int, text int, low long, high long, first int, rank long, shape int, whole long, before long, behind long, doc long, sub long"
LED = "block int, text int, low long, high long, first int, rank long, shape int, before long, behind long"
PAIRS = "block int, text int, low long, high long, first int, a long, b long, doc long, sub long"
MARKS = "block int, text int, low long, high long"


def name_rows(block: Block, number: int) -> pa.Table:
    """Round 1: the distinct pairs of names at a block's anchors, and whether they come once or more often."""
    parts = [p[4:6] for p in runs(block.texts, full=False)]
    a, b = _columns(parts) or [np.zeros(0, np.uint64)] * 2
    by = np.lexsort((b, a))
    a, b = a[by], b[by]
    new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(a) else np.zeros(0, int)
    return _rows(NAMED, a=a[new], b=b[new], block=number, times=np.diff(np.concatenate([new, [len(a)]])))


def run_rows(block: Block, number: int, name: np.ndarray, rank: np.ndarray) -> pa.Table:
    """Round 2: the runs of a block whose 50 bytes have a rank."""
    by = np.argsort(name)
    name, rank = name[by], rank[by]
    parts = []
    for text, anchor, low, high, a, b, *rest in runs(block.texts) if len(name) else ():
        own = splitmix(a * _MIX + b)
        at = np.minimum(np.searchsorted(name, own), len(name) - 1)
        hit = np.flatnonzero(name[at] == own)
        parts.append((text[hit], low[hit], high[hit], rank[at[hit]], ((anchor - low) * 64 + high - low)[hit], *(x[hit] for x in rest)))
    if not parts:
        return _rows(RUNS, text=np.zeros(0, np.int64))
    text, low, high, rank, shape, whole, left, right = _columns(parts)
    first = _first_of(rank, shape, whole)
    t, lo, hi = _merged(text[~first], low[~first], high[~first])
    on = np.flatnonzero(first)
    own = text[on]
    leaders = _rows(RUNS, block=number, text=own, low=low[on], high=high[on], first=1, rank=rank[on], shape=shape[on], whole=whole[on], before=left[on], behind=right[on], doc=block.ids[own], sub=block.subs[own])
    return pa.concat_tables([leaders, _rows(RUNS, text=t, block=number, low=lo, high=hi)])


def pair_rows(block: Block, number: int, text: np.ndarray, low: np.ndarray, high: np.ndarray) -> pa.Table:
    """Round 4: the windows of a block that are still in, each pair of names once."""
    by = np.lexsort((high, low, text))
    found = _columns(windows(block.texts, text[by], low[by], high[by]))
    if not found:
        return _rows(PAIRS, text=np.zeros(0, np.int64))
    text, start, a, b = found
    first = _first_of(a, b)
    t, lo, hi = _merged(text[~first], start[~first], start[~first])
    on = np.flatnonzero(first)
    own = text[on]
    leaders = _rows(PAIRS, block=number, text=own, low=start[on], high=start[on], first=1, a=a[on], b=b[on], doc=block.ids[own], sub=block.subs[own])
    return pa.concat_tables([leaders, _rows(PAIRS, text=t, block=number, low=lo, high=hi)])


def neighbours_equal(batches: Iterable[pa.RecordBatch], keys: int) -> Iterator[tuple[list[np.ndarray], np.ndarray, np.ndarray]]:
    """Columns of sorted rows, with whether each row has the keys (first columns) of the row before and of the next.

    The last row of a batch is held back until the next is there, so groups of any size take no memory.
    """
    held: list[np.ndarray] = []
    like_last = False

    def told(columns: list[np.ndarray], end: bool):
        nonlocal held, like_last
        same = np.ones(len(columns[0]) - 1, dtype=bool)
        for k in columns[:keys]:
            same &= k[1:] == k[:-1]
        before, after = np.concatenate([[like_last], same]), np.concatenate([same, [False]])
        if end:
            return columns, before, after
        held, like_last = [c[-1:] for c in columns], bool(before[-1])
        return [c[:-1] for c in columns], before[:-1], after[:-1]

    for batch in batches:
        if batch.num_rows:
            columns = [c.to_numpy() for c in batch.columns]
            yield told([np.concatenate(x) for x in zip(held, columns, strict=True)] if held else columns, False)
    if held:
        yield told(held, True)


def ranks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Round 1: a rank for each pair that occurs again, told to the blocks that have it."""
    last = TaskContext.get().partitionId() << 40
    for (a, b, block, times), before, after in neighbours_equal(batches, 2):
        again = before | after | (times > 1)
        rank = last + np.cumsum(again & ~before)
        last = int(rank[-1]) if len(rank) else last
        name = splitmix(a[again].view(np.uint64) * _MIX + b[again].view(np.uint64))
        yield from _rows(KNOWN, block=block[again], name=name, rank=rank[again]).to_batches()


def leaders(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Round 2: whether each run is the first of those equal to it."""
    for (rank, shape, _, _, _, low, block, text, high, left, right), before, _ in neighbours_equal(batches, 3):
        yield from _rows(LED, block=block, text=text, low=low, high=high, first=(~before).astype(np.int32), rank=rank, shape=shape, before=left, behind=right).to_batches()


def repeats(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Round 4: the windows that are not the first of their pair of names."""
    for (_, _, _, _, low, block, text), before, _ in neighbours_equal(batches, 2):
        yield from _rows(MARKS, block=block[before], text=text[before], low=low[before], high=low[before]).to_batches()


def cut_out(texts: list[bytes], text: np.ndarray, low: np.ndarray, high: np.ndarray) -> list[tuple[int, int, int, bytes]]:
    """(bytes, removed, removed runs, what is left) of each text; windows from low to high go."""
    by = np.argsort(text, kind="stable")
    low, end = low[by], high[by] + LENGTH
    at = np.searchsorted(text[by], np.arange(len(texts) + 1)).tolist()
    out = []
    for t, body in enumerate(texts):
        if at[t] == at[t + 1]:
            out.append((len(body), 0, 0, body))
            continue
        steps = np.zeros(len(body) + 1, dtype=np.int64)
        np.add.at(steps, low[at[t] : at[t + 1]], 1)
        np.add.at(steps, end[at[t] : at[t + 1]], -1)
        gone = np.cumsum(steps[:-1]) > 0
        spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
        out.append((len(body), int(gone.sum()), spans, np.frombuffer(body, dtype=np.uint8)[~gone].tobytes()))
    return out


def remove_repeats(docs: DataFrame, strip: bool = False) -> DataFrame:
    """``docs`` with n_bytes, n_removed, n_spans (maximal removed runs) and kept (the bytes left); other columns stay.

    A null text is an empty one; texts under 100 bytes lose nothing; texts of any length are taken whole, in segments.
    Rows that repeat a doc_id and its text are one document with one result; different texts of one doc_id are documents
    in the order of their xxhash64; a null doc_id comes before every id. Columns of ``docs`` with the names of the results
    are replaced; all others, whatever their names, are handed on. An empty table gives an empty result. ``strip``: no
    results are added, but what is left takes the place of ``text``, see ``strip_repeats``.
    """
    spark = docs.sparkSession
    results = [] if strip else ["n_bytes", "n_removed", "n_spans", "kept"]
    docs = docs.drop(*results)
    columns = docs.columns
    key, doc, sub = unused(columns, "block", "doc", "sub")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks, sorts = max(LEAST, total // BLOCK_BYTES), min(MOST, max(LEAST, total // SORT_BYTES))
    parts = min(MOST, max(LEAST, blocks // TOGETHER))
    dealt = docs.withColumn(doc, F.coalesce("doc_id", F.lit(NULL_ID))).withColumn(sub, F.xxhash64(F.coalesce("text", F.lit(""))))
    dealt = dealt.withColumn(key, F.pmod(F.xxhash64(doc, sub), F.lit(blocks)).cast("int"))
    path = fresh_path(spark, "blocks")
    table = f"blocks_{path.rpartition('-')[2]}"
    dealt.repartition(parts, key).write.bucketBy(parts, key).option("compression", "zstd").option("path", path).saveAsTable(table)
    dealt = spark.table(table)
    spark.sql(f"DROP TABLE {table}")  # only its entry in the catalog: the files stay, and the plan has their places
    texts = dealt.select(F.col(key).alias("block"), F.col(doc).alias("doc"), F.col(sub).alias("sub"), "text").groupBy("block")

    def of(found: pa.Table, *names: str) -> list[np.ndarray]:
        return [found.column(c).to_numpy() for c in names]

    def block_of(left: pa.Table) -> Block:
        return Block(left.select(["doc", "sub", "text"]))

    def names_of(key: tuple, left: pa.Table) -> pa.Table:
        return name_rows(block_of(left), key[0].as_py())

    named = texts.applyInArrow(names_of, NAMED).repartition(sorts, "a", "b").sortWithinPartitions("a", "b")
    known = named.mapInArrow(ranks, KNOWN).groupBy("block")

    def runs_of(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        name, rank = of(right, "name", "rank")
        return run_rows(block_of(left), key[0].as_py(), name.view(np.uint64), rank)

    found = cut(texts.cogroup(known).applyInArrow(runs_of, RUNS), "runs")
    same = ["rank", "shape", "whole"]
    order = [*same, "doc", "sub", "low"]
    sent = found.filter("first = 1").select(*order, "block", "text", "high", "before", "behind")
    led = cut(sent.repartition(sorts, *same).sortWithinPartitions(*order).mapInArrow(leaders, LED), "led")

    # round 3: windows at 25 bytes or more before the anchor hold the 25 bytes before it, the others those behind its 50
    side = F.explode(F.array(*(F.struct(F.lit(k).alias("side"), F.col(c).alias("name")) for k, c in enumerate(("before", "behind")))))
    sides = led.filter("first = 1").select("block", "text", "low", "high", "rank", F.expr("low + cast(shape div 64 as long)").alias("anchor"), side.alias("x"))
    sides = sides.select("*", "x.side", "x.name").drop("x").filter("name <> 0")
    low, high = F.when(F.col("side") == 0, F.col("low")).otherwise(F.greatest("low", F.col("anchor") - QUARTER + 1)), F.when(F.col("side") == 0, F.least("high", F.col("anchor") - QUARTER)).otherwise(F.col("high"))
    sides = sides.withColumn("from", low).withColumn("to", high).filter("from <= to").select("block", "text", F.col("from").alias("low"), F.col("to").alias("high"), "rank", "side", "name")
    by = ["rank", "side", "name"]
    again = cut(sides.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(*by), "again")
    left_in = sides.join(again, by, "left_semi").select("block", "text", "low", "high")

    def pairs_of(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        return pair_rows(block_of(left), key[0].as_py(), *of(right, "text", "low", "high"))

    pairs = cut(texts.cogroup(left_in.groupBy("block")).applyInArrow(pairs_of, PAIRS), "pairs")
    order = ["a", "b", "doc", "sub", "low"]
    past = pairs.filter("first = 1").select(*order, "block", "text").repartition(sorts, "a", "b").sortWithinPartitions(*order).mapInArrow(repeats, MARKS)
    marks = past
    for rows in (found, led, pairs):
        marks = marks.union(rows.filter("first = 0").select("block", "text", "low", "high"))

    out = T.StructType(docs.schema.fields.copy())
    if not strip:
        out = out.add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long").add("kept", "binary")

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        block = Block(left.select([doc, sub, "text"]))
        rows = cut_out(block.texts, *of(right, "text", "low", "high"))
        rows = [rows[i] for i in block.row_of.tolist()]
        if strip:
            texts = [r[3].decode("utf-8", "ignore") for r in rows]
            own = {c: left.column(c) for c in columns}
            own["text"] = pa.array(texts, pa.string())
            if "n_chars" in own:
                own["n_chars"] = pa.array([len(t) for t in texts], pa.int64()).cast(own["n_chars"].type)
            return pa.table(own)
        extra = list(zip(*rows, strict=True)) or [()] * 4
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
        return pa.table([*(left.column(c) for c in columns), *(pa.array(c, k) for c, k in zip(extra, kinds, strict=True))], names=[*columns, *results])

    return dealt.groupBy(key).cogroup(marks.groupBy("block")).applyInArrow(finish, out)


def repeat_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of each document."""
    out = remove_repeats(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def strip_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated passages cut out of ``text``; all rows and columns stay, and n_chars, where there, follows.

    Passages are bytes, so a cut may split a character; what is left of a split character is dropped. A null text
    becomes an empty one.
    """
    return remove_repeats(docs, strip=True)
