"""Exact deduplication by deterministic block naming.

A normalised text is cut into blocks of fixed size. Distinct blocks are sorted and named by integers; then adjacent
names are paired, distinct pairs are sorted and named again, and so on until one name is left for each document. Equal
texts end with the same (level, name) and different texts never do: a name stands for one block content, which is
verified where blocks meet under their digest, and a pair of names for one pair.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from libraryloom.llm.common import NULL_ID, cut, unused

BLOCK_BYTES = 4096
#: The characters that do not count.
IGNORED = (" ", "\t", "\n", "\x0b", "\x0c", "\r")


def normalised(text: Column) -> Column:
    """The text without the characters of IGNORED; null as empty."""
    out = F.coalesce(text, F.lit(""))
    for c in IGNORED:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def two_hashes(block: Column) -> list[Column]:
    return [F.xxhash64(block), F.xxhash64(F.lit(7), block)]


def _blocks(docs: DataFrame, size: int, digest) -> DataFrame:
    whole = docs.select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("_d"), normalised(F.col("text")).alias("_t"))
    whole = whole.select("_d", F.sha2("_t", 256).alias("_s"), F.encode("_t", "UTF-8").alias("_t"))
    n = F.greatest(F.lit(1), F.ceil(F.length("_t") / size)).cast("int")
    cuts = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(F.col("_t"), i * size + 1, F.lit(size)))
    rows = whole.select("_d", "_s", n.alias("_n"), F.posexplode(cuts).alias("_i", "_block"))
    h1, h2 = digest(F.col("_block"))
    return rows.select("_d", "_s", "_n", "_i", h1.alias("_h1"), h2.alias("_h2"), "_block")


def _named(distinct: DataFrame, *by: str) -> Column:
    """Integers for rows that hash partitioning has dealt out, in the order of ``by`` within each partition."""
    return distinct.sortWithinPartitions(*by).withColumn("_name", F.monotonically_increasing_id())


def identities(docs: DataFrame, size: int = BLOCK_BYTES, digest=two_hashes) -> DataFrame:
    """(_d, _s, _level, _name) for each distinct pair of document id and text digest.

    ``_s``, the text's SHA-256, only tells apart rows that repeat a doc_id. ``digest`` only brings equal blocks
    together: where different blocks meet under one digest, they are named by their content.
    """
    blocks = _blocks(docs, size, digest)
    found = blocks.groupBy("_h1", "_h2").agg(F.min("_block").alias("_low"), F.max("_block").alias("_high"))
    names = cut(_named(found, "_low").select("_h1", "_h2", "_name", (F.col("_low") != F.col("_high")).alias("_clash")), "names")
    clash = names.filter("_clash").select("_h1", "_h2")
    keys = ["_d", "_s", "_n", "_i"]
    level = blocks.drop("_block").join(names.filter("NOT _clash"), ["_h1", "_h2"]).select(*keys, "_name")
    if not clash.isEmpty():
        met = blocks.join(clash, ["_h1", "_h2"])
        apart = cut(_named(met.select("_block").distinct(), "_block"), "names")
        level = level.union(met.join(apart, "_block").select(*keys, -1 - F.col("_name")))
    level = cut(level, "level")
    most = level.agg(F.max("_n")).first()[0] or 1
    done = [level.filter("_n = 1").select("_d", "_s", F.lit(0).alias("_level"), "_name").distinct()]
    level = level.filter("_n > 1")
    for k in range(1, 1 + math.ceil(math.log2(most))):
        side = lambda odd: F.max(F.when(F.col("_i") % 2 == odd, F.col("_name")))
        pairs = level.groupBy("_d", "_s", "_n", F.floor(F.col("_i") / 2).cast("int").alias("_j")).agg(side(0).alias("_a"), side(1).alias("_b"))
        pairs = cut(pairs.withColumn("_last", F.col("_b").isNull()).fillna({"_b": 0}), "pairs")
        names = cut(_named(pairs.select("_a", "_b", "_last").distinct(), "_a", "_b", "_last"), "names")
        level = pairs.join(names, ["_a", "_b", "_last"])
        level = cut(level.select("_d", "_s", F.ceil(F.col("_n") / 2).cast("int").alias("_n"), F.col("_j").alias("_i"), "_name"), "level")
        done.append(level.filter("_n = 1").select("_d", "_s", F.lit(k).alias("_level"), "_name"))
        level = level.filter("_n > 1")
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    return out


def exact_dedup(docs: DataFrame, size: int = BLOCK_BYTES, digest=two_hashes) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept and text_sha256.

    Of equal texts the row with the most code points in the original, then the smallest doc_id, stays; exactly one row
    of a group is kept, also where whole rows repeat. A null text is an empty one; a null doc_id sorts before every id;
    texts of any length are cut into blocks whole. An empty table gives an empty result.
    """
    rows = docs.select("doc_id", F.coalesce("doc_id", F.lit(NULL_ID)).alias("_d"), F.length(F.coalesce("text", F.lit(""))).alias("_chars"), F.sha2(normalised(F.col("text")), 256).alias("_s"))
    again = Window.partitionBy("_d", "_s").orderBy(F.desc("_chars"))
    rows = cut(rows.withColumn("_again", F.row_number().over(again)).join(identities(docs, size, digest), ["_d", "_s"]), "rows")
    groups = rows.groupBy("_level", "_name").agg(F.min(F.struct(-F.col("_chars"), F.col("_d"))).alias("_best"), F.count(F.lit(1)).alias("group_size"))
    groups = cut(groups.select("_level", "_name", "group_size", F.col("_best._d").alias("_keep")), "groups")  # so that the join below may split a large group
    keep = F.when(F.col("_keep") != NULL_ID, F.col("_keep"))
    kept = (F.col("_d") == F.col("_keep")) & (F.col("_again") == 1)
    return rows.join(groups, ["_level", "_name"]).select("doc_id", keep.alias("keep_id"), "group_size", kept.alias("kept"), F.col("_s").alias("text_sha256"))


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``exact_dedup`` keeps, with all their columns, whatever their names.

    Rows are dropped by an anti join with what goes, which is small as a rule; only where rows repeat a doc_id and its
    text are rows of one key told apart.
    """
    found = exact_dedup(docs.select("doc_id", "text"))
    doc, digest, kept, times, turn = unused(docs.columns, "doc", "digest", "kept", "times", "turn")
    keys = found.groupBy(F.coalesce("doc_id", F.lit(NULL_ID)).alias(doc), F.col("text_sha256").alias(digest)).agg(F.max("kept").alias(kept), F.count(F.lit(1)).alias(times))
    keys = cut(keys.filter(~F.col(kept) | (F.col(times) > 1)), "dropped")
    rows = docs.withColumn(doc, F.coalesce("doc_id", F.lit(NULL_ID))).withColumn(digest, F.sha2(normalised(F.col("text")), 256))
    out = rows.join(keys, [doc, digest], "left_anti").select(*docs.columns)
    again = keys.filter(kept).select(doc, digest)
    if again.isEmpty():
        return out
    once = Window.partitionBy(doc, digest).orderBy(F.desc(F.length("text")))
    rows = rows.join(again, [doc, digest], "left_semi").withColumn(turn, F.row_number().over(once)).filter(F.col(turn) == 1)
    return out.union(rows.select(*docs.columns))


ORACLE_SQL = """
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS t FROM documents
)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept,
       sha256(t) AS text_sha256
FROM n
WINDOW w AS (PARTITION BY t ORDER BY chars DESC, doc_id)
"""
