"""Connected components of an edge table by alternating large and small stars; no node or edge passes the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from libraryloom.llm.common import cut, remove, written


def _star(edges: DataFrame, large: bool) -> tuple[DataFrame, str]:
    """One round, and the path of its table of minima.

    Large: each node's greater neighbours go to its least neighbour; small: its lesser ones and itself do. The minima are
    taken on the map side and written, so that the join with them may split the edges of a node that has very many.
    """
    if large:
        edges = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least, path = written(edges.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m")), "least")
        return edges.join(least, "a").filter("b > a").select("b", F.col("m").alias("to")), path
    least, path = written(edges.groupBy("b").agg(F.min("a").alias("m")), "least")
    down = edges.join(least, "b").filter("a > m").select(F.col("a").alias("b"), F.col("m").alias("to"))
    return down.union(least.select("b", F.col("m").alias("to"))), path


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b: long): the least node that it is linked with.

    Loops and repeated edges do no harm; no edges give no rows. A node of many edges costs a row in each task. The tables
    of a round are deleted when the next one is written.
    """
    spark = edges.sparkSession
    edges = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct()
    edges, path = written(edges, "edges")
    state = None
    while True:
        for large in (True, False):
            star, least = _star(edges, large)
            edges, now = written(star.select(F.col("to").alias("a"), "b").filter("a < b").distinct(), "edges")
            remove(spark, path, least)
            path = now
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == state:
            break
        state = now
    return cut(edges.select(F.col("b").alias("node"), F.col("a").alias("component")).union(edges.select("a", "a").distinct()), "components")
