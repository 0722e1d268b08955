"""Near-duplicate groups by MinHash signatures and a multi-index Hamming join.

A text is the set of its distinct five-word shingles. A signature has M components of 16 bits; a pair of similarity
0.75 differs in a quarter of them on average and in more than DISTANCE with probability about 1e-4 (1e-6 at 0.8).
Signatures are split into CHUNKS chunks. By the pigeonhole principle two signatures within DISTANCE differ in at most
DISTANCE // CHUNKS = 1 component of some chunk, so all chunk values with any one component left out are enumerated as
keys, and every pair within the distance shares a key. Pairs that share a key are compared by signature and size where
they meet; what is left is confirmed on the full sets.

Documents with equal sets are one class from the start. Pairs are never rows: a task compares the classes that share its
keys and hands on the trees that near pairs make up. Every near pair lies in one component of all these trees, so full
sets are compared within components only, and again only trees of similar sets are handed on. A component of at most a
block is compared whole. In a larger one a few members, the hubs, those closest to the family's commonest signature, are
compared with all others first, row by row where these lie. Those that the hubs join into one class need no more links among themselves; only what is left outside is
compared with all members, block by block. So a family of near copies of one text moves once, however large it is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from libraryloom.llm.common import NULL_ID, cut, joined, prefix_sums, slices, span_hash, splitmix, unused, utf8_of, word_spans
from libraryloom.llm.graph import components

WORDS = 5
SHARE = 75  # of 100
M = 64
DISTANCE = 29
CHUNKS = 15
#: Documents, and bytes of full sets, of a component that are compared in one task at most.
BLOCK = 512
BLOCK_BYTES = 32_000_000
#: Members of a larger component that all its others are compared with first.
HUBS = 4
#: Signature components by which hubs are chosen.
VOTES = 16
#: Bits of the filter that picks the texts whose sets are needed; more texts only make it let more through.
FILTER_BITS = 1 << 23

_inside = np.ones(256, dtype=bool)
_inside[[32, *range(9, 14)]] = False
_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
_MIX = splitmix(np.arange(101, 101 + WORDS, dtype=np.uint64)) | np.uint64(1)
_PERMUTE = splitmix(np.arange(201, 201 + M, dtype=np.uint64)) | np.uint64(1)
_WEIGH = splitmix(np.arange(301, 301 + M, dtype=np.uint64)) | np.uint64(1)
_BOUNDS = [M * c // CHUNKS for c in range(CHUNKS + 1)]


def shingle_sets(texts: list[bytes], size: int = WORDS) -> list[np.ndarray]:
    """Each text's distinct shingles as sorted 64-bit hashes; with fewer words the whole sequence, without words none."""
    b, at = joined(texts)
    b = _lower[b]
    start, end = word_spans(b, _inside)
    words = span_hash(prefix_sums(b), start, end)
    first = np.searchsorted(start, at)
    mix = _MIX if size == WORDS else splitmix(np.arange(101, 101 + size, dtype=np.uint64)) | np.uint64(1)
    count = max(0, len(words) - size + 1)
    rolled = np.zeros(count, dtype=np.uint64)
    for k in range(size):
        rolled += words[k : k + count] * mix[k]
    rolled = splitmix(rolled)
    out = []
    for i, j in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if j - i >= size:
            out.append(np.unique(rolled[i : j - size + 1]))
        elif j > i:
            out.append(splitmix(np.array([(words[i:j] * mix[: j - i]).sum() + np.uint64(j - i)], dtype=np.uint64)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def signatures(sets: list[np.ndarray], components: int = M) -> np.ndarray:
    """A row of (the first) M 16-bit components for each set; no set is empty."""
    starts = np.cumsum([0, *map(len, sets)])[:-1]
    flat = np.concatenate(sets)
    out = np.empty((len(sets), components), dtype=np.uint16)
    for k in range(components):
        least = np.minimum.reduceat(flat * _PERMUTE[k], starts)
        out[:, k] = (splitmix(least) >> np.uint64(48)).astype(np.uint16)
    return out


def chunk_keys(signature: np.ndarray) -> np.ndarray:
    """For each signature the M keys: every chunk with one of its components left out."""
    weighed = signature.astype(np.uint64) * _WEIGH
    out = np.empty_like(weighed)
    for c in range(CHUNKS):
        a, z = _BOUNDS[c], _BOUNDS[c + 1]
        out[:, a:z] = weighed[:, a:z].sum(axis=1, keepdims=True) - weighed[:, a:z] + splitmix(np.arange(401 + a, 401 + z, dtype=np.uint64))
    return splitmix(out)


def describe(docs: DataFrame) -> DataFrame:
    """(doc_id, _d, n, digest, sig): size, identity and signature of each text's set."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in slices(batch.column(1), 1_000_000):
                sets = shingle_sets(utf8_of(batch.column(1).slice(i, j - i)))
                digest = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
                own: dict[bytes, int] = {}
                for k, d in enumerate(digest):
                    if len(sets[k]):
                        own.setdefault(d, k)
                sig = dict(zip(own, (x.tobytes() for x in signatures([sets[k] for k in own.values()])), strict=True)) if own else {}
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array([len(s) for s in sets], pa.int64()), pa.array(digest, pa.binary()), pa.array([sig.get(d) for d in digest], pa.binary())], names=["doc_id", "n", "digest", "sig"])

    out = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, digest binary, sig binary")
    return out.withColumn("_d", F.coalesce("doc_id", F.lit(NULL_ID)))


def deal(df: DataFrame, keyed: Callable, partitions: int) -> DataFrame:
    """Send numpy rows to partitions by key in blobs, one for each task's batch and bucket.

    ``keyed`` turns an Arrow batch into (keys, function from row numbers to a blob). Rows of equal keys meet in one
    partition.
    """
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, blob = keyed(batch)
            bucket = (keys % np.uint64(partitions)).astype(np.int32)
            by = np.argsort(bucket, kind="stable")
            edges = np.flatnonzero(np.concatenate([[True], np.diff(bucket[by]) != 0, [True]])) if len(by) else np.zeros(1, int)
            parts = [(int(bucket[by[a]]), blob(by[a:z])) for a, z in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in parts], pa.int32()), pa.array([p[1] for p in parts], pa.binary())], names=["bucket", "blob"])

    return df.mapInArrow(run, "bucket int, blob binary").repartition(partitions, "bucket")


def partitions_for(rows: int, row_bytes: int) -> int:
    """Buckets, and partitions, of about 32 MB of blobs, at least 32 and at most 50 000; a batch sends one row to each."""
    return min(50_000, max(32, rows * row_bytes >> 25))


def shared_keys(classes: DataFrame, partitions: int) -> DataFrame:
    """(rep, key) for the keys that two or more classes have."""
    pair = np.dtype([("key", "<u8"), ("rep", "<i8")])

    def keyed(batch: pa.RecordBatch):
        sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.uint16).reshape(-1, M)
        rows = np.empty(len(sig) * M, dtype=pair)
        rows["key"], rows["rep"] = chunk_keys(sig).ravel(), np.repeat(batch.column(0).to_numpy(), M)
        return rows["key"], lambda at: rows[at].tobytes()

    def meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = np.frombuffer(b"".join(x for batch in batches for x in batch.column(1).to_pylist()), dtype=pair)
        rows = rows[np.lexsort((rows["rep"], rows["key"]))]
        again = (rows["key"][1:] == rows["key"][:-1]) & (rows["rep"][1:] == rows["rep"][:-1])
        rows = rows[np.concatenate([[True], ~again])[: len(rows)]]
        same = rows["key"][1:] == rows["key"][:-1]
        keep = np.zeros(len(rows), dtype=bool)
        keep[1:] |= same
        keep[:-1] |= same
        rows = rows[keep]
        for i in range(0, len(rows), 100_000):
            part = rows[i : i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(part["rep"])), pa.array(np.ascontiguousarray(part["key"]).view(np.int64))], names=["rep", "key"])

    return deal(classes.select("rep", "sig"), keyed, partitions).mapInArrow(meet, "rep long, key long")


MEMBER = np.dtype([("rep", "<i8"), ("n", "<i8"), ("sig", "<u2", (M,))])


def _near(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether members a and b of ``x`` may be similar enough by size and are within DISTANCE."""
    ok = 100 * np.minimum(x["n"][a], x["n"][b]) >= SHARE * np.maximum(x["n"][a], x["n"][b])
    at = np.flatnonzero(ok)
    for i in range(0, len(at), 100_000):
        part = at[i : i + 100_000]
        ok[part] = (x["sig"][a[part]] != x["sig"][b[part]]).sum(axis=1) <= DISTANCE
    return ok


class Forest:
    """Union-find over numbers 0 to n - 1; the root of a tree is its least number."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)


def _link_group(members: np.ndarray, near: Callable[[int, np.ndarray], np.ndarray], forest: Forest) -> None:
    """Join the members of a group that are near each other, comparing one with the later ones of other trees at a time."""
    label = np.array([forest.root(i) for i in members.tolist()])
    for k in range(len(members) - 1):
        if (label == label[0]).all():
            return
        later = k + 1 + np.flatnonzero(label[k + 1 :] != label[k])
        hit = later[near(k, later)]
        for other in np.unique(label[hit]).tolist():
            forest.join(int(label[k]), other)
            label[label == other] = label[k]


def neighbours(shared: DataFrame, classes: DataFrame, partitions: int) -> DataFrame:
    """(a, b): links that join all classes that share a key and are within the distance; at most one for each class and task.

    Within a task nothing but the trees that the near pairs make up leaves it, so a group of any size gives few rows.
    """
    keys = shared.groupBy("rep").agg(F.collect_list("key").alias("keys"))  # a class has M keys
    rows = keys.join(classes.select("rep", "n", "sig"), "rep").select("rep", "n", "sig", "keys")

    def keyed(batch: pa.RecordBatch):
        x = np.empty(len(batch), dtype=MEMBER)
        x["rep"], x["n"] = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        x["sig"] = np.frombuffer(b"".join(batch.column(2).to_pylist()), dtype=np.uint16).reshape(-1, M)
        lists = batch.column(3)
        flat = lists.flatten().to_numpy().view(np.uint64)
        owner = np.repeat(np.arange(len(x)), lists.value_lengths().to_numpy())

        def blob(at: np.ndarray) -> bytes:
            own, place = np.unique(owner[at], return_inverse=True)
            return np.array([len(own), len(at)], dtype="<i8").tobytes() + x[own].tobytes() + flat[at].tobytes() + place.astype("<i8").tobytes()

        return flat, blob

    def meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members, keys, owners, total = [], [], [], 0
        for batch in batches:
            for raw in batch.column(1).to_pylist():
                n, k = np.frombuffer(raw, dtype="<i8", count=2).tolist()
                at = 16 + n * MEMBER.itemsize
                members.append(np.frombuffer(raw, dtype=MEMBER, count=n, offset=16))
                keys.append(np.frombuffer(raw, dtype="<u8", count=k, offset=at))
                owners.append(np.frombuffer(raw, dtype="<i8", count=k, offset=at + 8 * k) + total)
                total += n
        if not total:
            return
        x, key, owner = np.concatenate(members), np.concatenate(keys), np.concatenate(owners)
        # a class that came in several blobs is one member; classes that share a rep stay apart
        _, first, same = np.unique(x.view(np.dtype((np.void, MEMBER.itemsize))), return_index=True, return_inverse=True)
        x, owner = x[first], same.ravel()[owner]
        by = np.argsort(x["rep"], kind="stable")
        rank = np.empty(len(x), dtype=np.int64)
        rank[by] = np.arange(len(x))
        x, owner = x[by], rank[owner]
        by = np.lexsort((owner, key))
        key, owner = key[by], owner[by]
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        sizes = np.diff(np.concatenate([starts, [len(owner)]]))
        # groups of the same members are compared once
        mark = np.add.reduceat(splitmix(owner.astype(np.uint64) + np.uint64(1)), starts)
        _, first = np.unique(np.stack([mark, sizes.astype(np.uint64)], axis=1), axis=0, return_index=True)
        starts, sizes = starts[first], sizes[first]
        forest = Forest(len(x))
        for size in np.unique(sizes[sizes > 1]).tolist():
            rows = owner[starts[sizes == size][:, None] + np.arange(size)]
            if size <= 16:
                i, j = np.triu_indices(size, 1)
                pairs = np.unique(np.stack([rows[:, i].ravel(), rows[:, j].ravel()], axis=1), axis=0)
                pairs = pairs[_near(x, pairs[:, 0], pairs[:, 1])]
                for a, b in pairs.tolist():
                    forest.join(a, b)
            else:
                for group in rows:
                    _link_group(group, lambda k, later, g=group: _near(x, np.full(len(later), g[k]), g[later]), forest)
        root = np.array([forest.root(i) for i in range(len(x))])
        on = np.flatnonzero(root != np.arange(len(x)))
        yield pa.RecordBatch.from_arrays([pa.array(x["rep"][root[on]]), pa.array(x["rep"][on])], names=["a", "b"])

    return deal(rows, keyed, partitions).mapInArrow(meet, "a long, b long").distinct()


def sets_of(ids: DataFrame, docs: DataFrame) -> DataFrame:
    """(id, set) of the documents in ``ids``, made anew from their texts."""
    spark = docs.sparkSession
    bit = F.pmod(F.xxhash64("id"), F.lit(FILTER_BITS))
    # a bit map of fixed size, however many documents there are
    words = ids.select(bit.alias("bit")).select(F.expr("cast(bit div 64 as int)").alias("w"), F.expr("shiftleft(1L, cast(bit % 64 as int))").alias("v")).groupBy("w").agg(F.bit_or("v").alias("v")).toArrow()
    bits = np.zeros(FILTER_BITS // 64, dtype=np.int64)
    bits[words.column(0).to_numpy()] = words.column(1).to_numpy()
    shared = spark.sparkContext.broadcast(bits)
    rows = docs.select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("id"), "text").withColumn("bit", F.pmod(F.xxhash64("id"), F.lit(FILTER_BITS)))

    def pick(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bit = batch.column(2).to_numpy()
            batch = batch.filter(pa.array((shared.value.view(np.uint64)[bit >> 6] >> (bit & 63).astype(np.uint64) & np.uint64(1)).astype(bool)))
            for i, j in slices(batch.column(1), 1_000_000):
                sets = [s.tobytes() for s in shingle_sets(utf8_of(batch.column(1).slice(i, j - i)))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(sets, pa.binary())], names=["id", "set"])

    return rows.mapInArrow(pick, "id long, set binary")


def similar(sets: list[np.ndarray], side: np.ndarray, cross: bool) -> Forest:
    """Trees of the sets that are similar enough. ``cross``: only pairs of different sides are compared."""
    forest = Forest(len(sets))
    size = np.array([len(x) for x in sets])
    shingle, place = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), size)
    by = np.argsort(place, kind="stable")
    holders = owner[by]  # the sets that hold each shingle, shingle after shingle
    begin = np.searchsorted(place[by], np.arange(len(shingle) + 1))
    ends = np.cumsum(size)

    def near(k: int, later: np.ndarray) -> np.ndarray:
        own = place[ends[k] - size[k] : ends[k]]
        count = begin[own + 1] - begin[own]
        at = np.repeat(begin[own] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        common = np.bincount(holders[at], minlength=len(sets))[later]
        ok = (common > 0) & (100 * common >= SHARE * (size[k] + size[later] - common))
        return ok & (side[later] != side[k]) if cross else ok

    _link_group(np.arange(len(sets)), near, forest)
    return forest


def _hub_links(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each member the hubs of its component that it is similar to, as a mask of their places and as ids."""
    now, hubs = None, []
    for batch in batches:
        masks, ids = [], []
        component, own = batch.column("component").to_pylist(), batch.column("set").to_pylist()
        for k, c in enumerate(component):
            if c != now:
                now, hubs = c, [(h["id"], np.frombuffer(h["set"], dtype=np.uint64)) for h in batch.column("hubs")[k].as_py()]
            x = np.frombuffer(own[k], dtype=np.uint64)
            mask, near = 0, []
            for place, (i, hub) in enumerate(hubs):
                if not len(x) or not len(hub) or 100 * min(len(x), len(hub)) < SHARE * max(len(x), len(hub)):
                    continue
                common = int((hub[np.minimum(np.searchsorted(hub, x), len(hub) - 1)] == x).sum())
                if 100 * common >= SHARE * (len(x) + len(hub) - common):
                    mask |= 1 << place
                    near.append(i)
            masks.append(mask)
            ids.append(near)
        yield pa.RecordBatch.from_arrays([batch.column("component"), batch.column("id"), pa.array(masks, pa.int32()), pa.array(ids, pa.list_(pa.int64()))], names=["component", "id", "mask", "hubs"])


def _component_counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each value of the first VOTES signature components occurs in a batch, by family."""
    for batch in batches:
        sets = [np.frombuffer(x, dtype=np.uint64) for x in batch.column("set").to_pylist()]
        on = [k for k, x in enumerate(sets) if len(x)]
        if not on:
            continue
        sig = signatures([sets[k] for k in on], VOTES)
        rows = np.stack([np.repeat(batch.column("component").to_numpy()[on], VOTES), np.tile(np.arange(VOTES), len(on)), sig.ravel().astype(np.int64)], axis=1)
        rows, n = np.unique(rows, axis=0, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(rows[:, 0]), pa.array(rows[:, 1].astype(np.int32)), pa.array(rows[:, 2].astype(np.int32)), pa.array(n)], names=["component", "place", "value", "n"])


def _agreement(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many of its first VOTES signature components each member shares with its family's consensus."""
    for batch in batches:
        sets = [np.frombuffer(x, dtype=np.uint64) for x in batch.column("set").to_pylist()]
        agree = np.zeros(len(sets), dtype=np.int32)
        on = [k for k, x in enumerate(sets) if len(x)]
        if on:
            consensus = batch.column("consensus").flatten().field("value").to_numpy().reshape(-1, VOTES)
            agree[on] = (signatures([sets[k] for k in on], VOTES) == consensus[on]).sum(axis=1)
        yield pa.RecordBatch.from_arrays([batch.column("component"), batch.column("id"), pa.array(agree)], names=["component", "id", "agree"])


def _largest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each component the hubs of its largest class: masks of members join the hubs that they name."""
    for batch in batches:
        best = []
        for masks in batch.column("masks").to_pylist():
            classes: list[list[int]] = []  # hubs and members
            for m in masks:
                own = [m["mask"], m["n"]]
                if own[0]:
                    for other in [c for c in classes if c[0] & own[0]]:
                        classes.remove(other)
                        own = [own[0] | other[0], own[1] + other[1]]
                    classes.append(own)
            best.append(max(classes, key=lambda c: (c[1], c[0]))[0] if classes else 0)
        yield pa.RecordBatch.from_arrays([batch.column("component"), pa.array(best, pa.int32())], names=["component", "best"])


def _compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trees of similar sets of each group of sorted rows (component, i, j, side, id, set); between sides if there are two."""

    def links_of(rows: list[tuple]) -> tuple[list[int], list[int]]:
        sides = np.array([r[3] for r in rows])
        if sides.all():  # nobody to compare them with
            return [], []
        forest = similar([np.frombuffer(r[5], dtype=np.uint64) for r in rows], sides, bool((sides != sides[0]).any()))
        both = [(rows[forest.root(k)][4], rows[k][4]) for k in range(len(rows)) if forest.root(k) != k]
        return [x for x, _ in both], [y for _, y in both]

    now, rows = None, []
    for batch in batches:
        a, b = [], []
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:3] != now:
                if len(rows) > 1:
                    x, y = links_of(rows)
                    a += x
                    b += y
                now, rows = row[:3], []
            rows.append(row)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
    if len(rows) > 1:
        x, y = links_of(rows)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], names=["a", "b"])


def confirmed(links: DataFrame, docs: DataFrame, block: int = BLOCK, room: int = BLOCK_BYTES, hubs: int = HUBS) -> DataFrame:
    """(a, b): links that join all documents whose full sets are similar enough, among those that ``links`` connect.

    Every near pair lies in one component of ``links``. Nothing but trees of similar sets, and a row for each member and
    hub that are similar, leaves a task.
    """
    found = components(links).select(F.col("node").alias("id"), "component")
    members = found.join(sets_of(found.select("id"), docs), "id").select("component", "id", F.octet_length("set").alias("bytes"), "set")
    members = cut(members, "members")
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / block), F.ceil(F.sum("bytes") / room)).cast("int")
    families = cut(members.groupBy("component").agg(blocks.alias("blocks"), F.count(F.lit(1)).alias("size")), "families")
    keys = ["component", "i", "j"]

    def compared(rows: DataFrame) -> DataFrame:
        rows = rows.select(*keys, "side", "id", "set").repartition(*keys).sortWithinPartitions(*keys, "side", "id")
        return rows.mapInArrow(_compare, "a long, b long")

    one = F.lit(0)
    small = members.join(families.filter("blocks = 1"), "component").select("component", one.alias("i"), one.alias("j"), one.alias("side"), "id", "set")
    links = compared(small)
    large = families.filter("blocks > 1")
    if large.isEmpty():
        return links.distinct()

    # hubs: the members that agree best with their family's consensus, the commonest value of each signature component
    often = members.join(large.select("component"), "component").select("component", "set").mapInArrow(_component_counts, "component long, place int, value int, n long")
    often = often.groupBy("component", "place", "value").agg(F.sum("n").alias("n")).groupBy("component", "place").agg(F.max(F.struct("n", "value")).alias("x"))
    often = cut(often.groupBy("component").agg(F.sort_array(F.collect_list(F.struct("place", "x.value"))).alias("consensus")), "consensus")  # VOTES values of each
    votes = members.join(often, "component").select("component", "id", "set", "consensus").mapInArrow(_agreement, "component long, id long, agree int")
    ranked = F.row_number().over(Window.partitionBy("component").orderBy("key"))
    picks = votes.groupBy("component", F.pmod(F.xxhash64("id"), F.lit(hubs)).alias("slot")).agg(F.min(F.struct(-F.col("agree"), F.xxhash64("id"), F.col("id").alias("id"))).alias("key"))  # a few rows of each
    picked = cut(picks.withColumn("k", ranked).filter(F.col("k") <= hubs).select("component", "key.id"), "picked")
    chosen = members.join(picked, ["component", "id"]).groupBy("component", "id").agg(F.min("set").alias("set"))
    chosen = cut(chosen.groupBy("component").agg(F.sort_array(F.collect_list(F.struct("id", "set"))).alias("hubs")), "hubs")  # at most ``hubs`` of each
    near = cut(members.join(chosen, "component").select("component", "id", "set", "hubs").mapInArrow(_hub_links, "component long, id long, mask int, hubs array<long>"), "near")
    links = links.union(near.select(F.explode("hubs").alias("a"), F.col("id").alias("b")).filter("a <> b"))
    masks = near.groupBy("component", "mask").agg(F.count(F.lit(1)).alias("n"))
    best = cut(masks.groupBy("component").agg(F.collect_list(F.struct("mask", "n")).alias("masks")).mapInArrow(_largest, "component long, best int"), "best")
    left = near.join(best, "component").filter(F.col("mask").bitwiseAND(F.col("best")) == 0).select("component", "id").distinct()
    left = cut(left, "left")
    if left.isEmpty():
        return links.distinct()

    # what the hubs left outside, in blocks, against all members, in blocks
    rest = left.groupBy("component").agg(F.count(F.lit(1)).alias("n")).join(large, "component")
    rest = cut(rest.select("component", "blocks", F.least("blocks", F.ceil(F.col("n") * F.col("blocks") / F.col("size"))).cast("int").alias("lefts")), "rest")
    place = lambda n: F.pmod(F.xxhash64(F.lit(3), "id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    outside = members.join(left, ["component", "id"]).join(rest, "component")
    outside = outside.select("component", place("lefts").alias("i"), every("blocks").alias("j"), F.lit(0).alias("side"), "id", "set")
    inside = members.join(rest, "component").select("component", every("lefts").alias("i"), place("blocks").alias("j"), F.lit(1).alias("side"), "id", "set")
    return links.union(compared(outside.union(inside))).distinct()


def near_groups(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id and kept.

    Documents without words are linked with nothing. Rows that share a doc_id are one document: they share a component
    and are all kept or all dropped. A null doc_id sorts before every id and is one document like any other. An empty
    table gives an empty result.
    """
    spark = docs.sparkSession
    rows = cut(describe(docs), "sets")
    classes = rows.filter("n > 0").groupBy("digest").agg(F.min(F.struct("_d", "n", "sig")).alias("x"), F.max("sig").alias("s"))
    classes = cut(classes.select("digest", F.col("x._d").alias("rep"), F.col("x.n").alias("n"), F.col("s").alias("sig")), "classes")
    parts = partitions_for(classes.count(), M * 16)
    shared = cut(shared_keys(classes, parts), "shared")
    links = cut(neighbours(shared, classes, parts), "links")
    # rows that share an id may be of different classes, or without words: they are linked by their least class
    several = cut(rows.groupBy("_d").agg(F.min("digest").alias("x"), F.max("digest").alias("y")).filter("x < y").select("_d"), "several")
    own = cut(rows.join(several, "_d").select("_d", "digest").distinct().join(classes.select("digest", "rep"), "digest").select("_d", "rep").distinct(), "own")
    first = cut(own.groupBy("_d").agg(F.min("rep").alias("first")), "first")
    bonds = own.join(first, "_d").filter("rep > first").select(F.col("first").alias("a"), F.col("rep").alias("b"))
    homes = cut(components(cut(confirmed(links, docs).union(bonds), "links")), "homes")
    found = classes.select("digest", "rep").join(homes, F.col("rep") == F.col("node"), "left").select("digest", F.coalesce("component", "rep").alias("c"))
    out = rows.filter("n > 0").join(found, "digest").select("doc_id", "n", "_d", "c")
    found = first.join(homes, F.col("first") == F.col("node"), "left").select("_d", F.coalesce("component", "first").alias("c"))
    none = rows.filter("n = 0").join(found, "_d", "left").select("doc_id", "n", "_d", F.coalesce("c", "_d").alias("c"))
    return out.union(none).select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("c") != NULL_ID, F.col("c")).alias("component_id"), (F.col("c") == F.col("_d")).alias("kept"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, one document of each near-duplicate group, with all their columns, whatever their names."""
    (gone,) = unused(docs.columns, "gone")
    dropped = near_groups(docs.select("doc_id", "text")).filter("NOT kept").select(F.coalesce("doc_id", F.lit(NULL_ID)).alias(gone)).distinct()
    return docs.join(cut(dropped, "gone"), F.coalesce("doc_id", F.lit(NULL_ID)) == F.col(gone), "left_anti")


#: The result of ``near_groups`` by joining shingles; quadratic in what documents share, so for small tables.
ORACLE_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
l AS (SELECT doc_id, CASE WHEN len(ws) >= 5 THEN list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS g FROM w),
s AS (SELECT doc_id, len(g) AS n, unnest(g) AS g FROM l),
e AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
r(id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.id)
SELECT l.doc_id, CAST(len(l.g) AS BIGINT) AS n_shingles, m.root AS component_id, l.doc_id = m.root AS kept
FROM l JOIN (SELECT id, min(root) AS root FROM r GROUP BY id) m ON m.id = l.doc_id
"""
