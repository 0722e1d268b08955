"""Prefix trie of conversations, built in hash partitions of first turns.

Texts stay where they are read: a turn becomes the SHA-256 of its role and text and a number of words, a conversation the
path of its digests. Equal paths are one row with a count before any trie is built. Rows are partitioned by the digest
of their first turn; a first turn with more than ``LIMIT`` distinct paths is partitioned anew by its next turn, and so on,
so a group is bounded whatever is common. Inside ``applyInPandas`` each group becomes a pointer-dictionary trie that is
walked in iterative postorder. The nodes above partitions (the root and the first turns that were split) are summed from
their children by Spark.

Defined results: rows without conv_id belong to no conversation and take no part; null role and text are empty; turns
that tie are in order of their digests; repeated rows are turns of their own; remainders have the sign of the id, as in
SQL. No conversations give no nodes. A conversation's digests, not its texts, lie in one row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from libraryloom.llm.common import cut

#: Distinct paths of a group beyond which it is partitioned anew, and for which there is one bucket.
LIMIT = 1000
#: Rows of split prefixes that a join may broadcast (each is about 200 bytes and 32 for each turn of its depth).
BROADCAST_ROWS = 10_000
#: Bytes of a turn's digest; conversations of one base; turns that may come from it; ids of a chunk are 2 to this power.
DIGEST, FAMILY, SHARED, CHUNK_BITS = 32, 20, 4, 9

WORD = r"[^\x20\x09-\x0D]+"
NODES = "depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
NO_ENDS = hashlib.sha256(b"").hexdigest()


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(conv_id, path: digests of turns one after another, words: their numbers of words) of each rebuilt conversation.

    Conversations of one base lie together, at most ``FAMILY`` of them, so the base's first turns reach the others by a
    window and nothing is joined.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turn = F.struct(F.col("turn").alias("turn"), F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256).alias("d"), F.regexp_count(text, F.lit(WORD)).alias("w"))
    rows = conversations.filter(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("c"), turn.alias("turn")).withColumn("base", F.col("c") - F.col("c") % FAMILY)
    own = rows.repartition("base").groupBy("base", "c").agg(F.sort_array(F.collect_list("turn")).alias("own"))
    head = F.max(F.when(F.col("c") == F.col("base"), F.slice("own", 1, SHARED - 1))).over(Window.partitionBy("base"))
    h = (F.crc32(F.col("c").cast("string").cast("binary")) % SHARED).cast("int")
    turns = own.withColumn("head", head).select("c", F.concat(F.coalesce(F.slice("head", F.lit(1), h), F.slice("own", 1, 0)), F.slice("own", h + 1, F.size("own"))).alias("turns"))
    path = F.unhex(F.array_join(F.transform("turns", lambda t: t.d), ""))
    return turns.select(F.col("c").alias("conv_id"), path.alias("path"), F.transform("turns", lambda t: t.w).alias("words"))


def _digest_ends(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a path from its sorted chunks of ids, which are digested as they come."""
    names = ["path", "words", "n", "low", "ends"]
    at, sha = None, None

    def batch_of(rows: list[list]) -> pa.RecordBatch:
        kinds = (pa.binary(), pa.list_(pa.int32()), pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(list(column), kind) for column, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    for batch in batches:
        done: list[list] = []
        for path, words, ids, n, low in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if at is not None and at[0] == path:
                sha.update(b"," + ids.encode())
                at[2] += n
                continue
            if at is not None:
                done.append([*at, sha.hexdigest()])
            at, sha = [path, words, n, low], hashlib.sha256(ids.encode())
        if done:
            yield batch_of(done)
    if at is not None:
        yield batch_of([[*at, sha.hexdigest()]])


def distinct_paths(conversations: DataFrame) -> DataFrame:
    """(path, words, n, low, ends): each distinct rebuilt conversation, how many there are, the least id, the ids' digest.

    Ids are joined in chunks of neighbouring ids first, so that a path which very many conversations share costs a row for
    each chunk; a path's chunks are then sorted and digested as they stream by.
    """
    chunked = rebuilt(conversations).groupBy("path", F.shiftright("conv_id", CHUNK_BITS).alias("chunk")).agg(F.first("words").alias("words"), F.sort_array(F.collect_list("conv_id")).alias("ids"))
    chunked = chunked.select("path", "words", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"), F.size("ids").cast("long").alias("n"), F.col("ids")[0].alias("low"), "chunk")
    ordered = chunked.repartition("path").sortWithinPartitions("path", "chunk").drop("chunk")
    return ordered.mapInArrow(_digest_ends, "path binary, words array<int>, n long, low long, ends string")


def _prefix(level: int, path: str = "path") -> Column:
    return F.substring(path, 1, DIGEST * level)


class _Node:
    __slots__ = ("children", "depth", "words", "n", "low", "ends", "leaves", "saved", "parent")

    def __init__(self, depth: int, words: int, parent: int) -> None:
        self.children: dict[bytes, _Node] = {}
        self.depth, self.words, self.parent = depth, words, parent
        self.n, self.low, self.ends, self.leaves, self.saved = 0, 2**63 - 1, NO_ENDS, 0, 0


def grow(rows: pd.DataFrame) -> pd.DataFrame:
    """The nodes of one bucket's tries from the depth of their partition (``level``) down, in postorder."""
    tops: dict[bytes, _Node] = {}
    for path, words, n, low, ends, level, parent in zip(*[rows[c] for c in ("path", "words", "n", "low", "ends", "level", "parent_low")], strict=True):
        path = bytes(path)
        top = path[: DIGEST * level]
        node = tops.get(top)
        if node is None:
            node = tops[top] = _Node(level, words[level - 1], parent)
        node.n += n
        node.low = min(node.low, low)
        for depth in range(level + 1, len(words) + 1):
            digest = path[DIGEST * (depth - 1) : DIGEST * depth]
            child = node.children.get(digest)
            if child is None:
                child = node.children[digest] = _Node(depth, words[depth - 1], 0)
            child.n += n
            child.low = min(child.low, low)
            node = child
        node.ends = ends
    out = []
    for key, top in tops.items():
        stack = [(top, iter(top.children.values()))]
        while stack:
            node, rest = stack[-1]
            child = next(rest, None)
            if child is not None:
                child.parent = node.low
                stack.append((child, iter(child.children.values())))
                continue
            stack.pop()
            node.leaves = node.leaves or 1
            node.saved += (node.n - 1) * node.words
            out.append((key[:-DIGEST] if node is top else None, node.depth, node.low, node.parent, node.n, len(node.children), node.leaves, node.saved, node.ends))
            if stack:
                stack[-1][0].leaves += node.leaves
                stack[-1][0].saved += node.saved
    return pd.DataFrame(out, columns=["above", "depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"])


def trie(conversations: DataFrame, limit: int = LIMIT) -> DataFrame:
    """One row for each node of the trie of rebuilt conversations, root included (columns of NODES)."""
    spark = conversations.sparkSession
    paths = cut(distinct_paths(conversations), "paths")
    total, count, least = paths.agg(F.sum("n"), F.count(F.lit(1)), F.min("low")).first()
    if not count:
        return spark.createDataFrame([], NODES)
    empty, none = F.lit(b""), F.lit(None).cast("long")
    splits = [spark.range(1).select(empty.alias("prefix"), F.lit(total).alias("n"), F.lit(least).alias("low"), F.lit(0).alias("w"), none.alias("parent_low"))]
    pending = paths.filter(F.length("path") > 0).withColumn("parent_low", F.lit(least))
    units = []
    while True:
        level = len(splits)
        keyed = pending.withColumn("prefix", _prefix(level)).withColumn("level", F.lit(level))
        stats = keyed.groupBy("prefix").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("n"), F.min("low").alias("low"), F.max(F.col("words")[level - 1]).alias("w"), F.max("parent_low").alias("parent_low"))
        large = cut(stats.filter(F.col("rows") > limit).drop("rows"), "large")
        found = large.count()
        if not found:
            units.append(keyed)
            break
        splits.append(large)
        known = large.select("prefix", F.col("low").alias("split_low"))
        joined = keyed.join(F.broadcast(known) if found <= BROADCAST_ROWS else known, "prefix", "left")
        units.append(joined.filter(F.col("split_low").isNull()).select(*keyed.columns))
        below = joined.filter(F.col("split_low").isNotNull() & (F.length("path") > DIGEST * level))
        pending = cut(below.select("path", "words", "n", "low", "ends", F.col("split_low").alias("parent_low")), "pending")
    rows = units[0]
    for more in units[1:]:
        rows = rows.unionByName(more)
    buckets = max(1, -(-count // limit))
    bucket = F.pmod(F.xxhash64("prefix"), F.lit(buckets)).alias("bucket")
    nodes = cut(rows.select(bucket, "path", "words", "n", "low", "ends", "level", "parent_low").groupBy("bucket").applyInPandas(grow, f"above binary, {NODES}"), "nodes")

    out, children = nodes.select(*NODES.replace(" long", "").replace(" string", "").split(", ")), None
    for depth in reversed(range(len(splits))):
        tops = nodes.filter(F.col("above").isNotNull() & (F.col("depth") == depth + 1)).select("above", "n_leaves", "saved_tokens")
        under = tops if children is None else tops.unionByName(children)
        sums = under.groupBy(F.col("above").alias("prefix")).agg(F.count(F.lit(1)).alias("n_children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
        ends = paths.filter(F.length("path") == DIGEST * depth).select(F.col("path").alias("prefix"), "ends")
        level = splits[depth].join(sums, "prefix", "left").join(ends, "prefix", "left")
        nought = F.lit(0).cast("long")
        level = level.select(
            "prefix", F.lit(depth).cast("long").alias("depth"), F.col("low").alias("conv_id"), F.col("parent_low").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.coalesce("n_children", nought).alias("n_children"),
            F.coalesce("leaves", nought + 1).alias("n_leaves"), ((F.col("n") - 1) * F.col("w") + F.coalesce("saved", nought)).alias("saved_tokens"), F.coalesce("ends", F.lit(NO_ENDS)).alias("ends_sha256"),
        )
        level = cut(level, "splits")
        out = out.unionByName(level.drop("prefix"))
        children = level.select(F.substring("prefix", 1, DIGEST * max(depth - 1, 0)).alias("above"), "n_leaves", "saved_tokens")
    return out


ORACLE_SQL = r"""
WITH crcs AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) ORDER BY i) AS t
  FROM range(256) r(i)
),
rows AS (SELECT conv_id AS c, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL),
own AS (
  SELECT c, list({'r': r, 'x': x} ORDER BY turn NULLS FIRST, sha256(length(r)::VARCHAR || ':' || r || x)) AS turns FROM rows GROUP BY c
),
shares AS (
  SELECT c, turns, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(c::VARCHAR) + 1), lambda i: ascii((c::VARCHAR)[i])::BIGINT)),
    lambda a, b: xor(t[(xor(a, b) & 255) + 1], a >> 8)), 4294967295) % 4 AS h
  FROM own, crcs
),
rebuilt AS (
  SELECT s.c, list_concat(coalesce(b.turns, [])[1:h], s.turns[h + 1:]) AS turns FROM shares s LEFT JOIN own b ON b.c = s.c - s.c % 20
),
members AS (SELECT c, turns[1:d] AS p, d, len(turns) AS size FROM (SELECT *, unnest(range(0, len(turns) + 1)) AS d FROM rebuilt)),
nodes AS (
  SELECT p, d, min(c) AS low, count(*) AS n, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE size = d), '') AS ends,
    CASE WHEN d = 0 THEN 0 ELSE len(regexp_extract_all(p[d].x, '[^\x20\x09-\x0D]+')) END AS words
  FROM members GROUP BY p, d
),
children AS (SELECT p[1:d - 1] AS p, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1),
above AS (
  SELECT p[1:k] AS p, sum(gain) AS saved, sum(leaf) AS leaves FROM (
    SELECT nodes.p, unnest(range(0, nodes.d + 1)) AS k, (nodes.n - 1) * words AS gain, CASE WHEN children.n IS NULL THEN 1 ELSE 0 END AS leaf
    FROM nodes LEFT JOIN children ON nodes.p = children.p
  ) GROUP BY 1
)
SELECT n.low AS conv_id, n.d::BIGINT AS depth, up.low AS parent_conv_id, n.n AS n_convs, coalesce(children.n, 0) AS n_children,
  above.leaves::BIGINT AS n_leaves, above.saved::BIGINT AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM nodes n JOIN above ON above.p = n.p LEFT JOIN children ON children.p = n.p LEFT JOIN nodes up ON n.d > 0 AND up.p = n.p[1:n.d - 1]
"""
