"""Places in an order over tables of any size: ranges that Spark samples, and sums of the sizes of partitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from libraryloom.sources.scratch import cut

_ROW = 33  # the low bits that ``monotonically_increasing_id`` numbers a partition's rows with


def ranked(rows: DataFrame, order: Sequence[Column | str], name: str = "place", group: Sequence[str] = ()) -> DataFrame:
    """``rows`` with their place, from 1, in ``order``, of the whole table or of each ``group``; no task orders a group.

    Rows are dealt to ranges of (group, order), sorted in them and written with their number in the partition; the driver
    sees one size for each partition. ``order`` must tell rows apart, or equal rows share a task and have any order among
    them. Groups whose columns are null are groups too. An empty table stays empty.
    """
    spark = rows.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [*[F.col(g) for g in group], *[F.col(o) if isinstance(o, str) else o for o in order]]
    dealt = rows.repartitionByRange(partitions, *keys).sortWithinPartitions(*keys)
    kept = cut(dealt.withColumn("_id", F.monotonically_increasing_id()), "ranked").withColumn("_p", F.shiftright("_id", _ROW))
    sizes = sorted(tuple(r) for r in kept.groupBy("_p").agg(F.count(F.lit(1))).collect())  # at most ``partitions`` rows
    before, total = [], 0
    for p, n in sizes:
        before.append((p, total))
        total += n
    bases = spark.createDataFrame(before, "_p long, _before long")
    row = F.col("_before") + F.col("_id").bitwiseAND(F.lit((1 << _ROW) - 1)) + 1
    placed = kept.join(F.broadcast(bases), "_p").withColumn(name, row).drop("_p", "_id", "_before")
    if not group:
        return placed
    starts = placed.groupBy(*group).agg(F.min(name).alias("_start")).alias("s")
    equal = [F.col(f"r.{g}").eqNullSafe(F.col(f"s.{g}")) for g in group]
    joined = placed.alias("r").join(starts, equal)
    return joined.select(*[f"r.{c}" for c in rows.columns], (F.col(f"r.{name}") - F.col("s._start") + 1).alias(name))
