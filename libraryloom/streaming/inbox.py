"""Incremental intake: a stream over the inbox whose batches are decided against the library and what came before."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from libraryloom.functions.urls import canonical_url, first_url

SETTLE_SECONDS = 5
FILES = "path string, modificationTime timestamp, length long, content binary"
PENDING = "name string, path string, modified timestamp, hash string, key string"
CLAIMED = "hash string, key string, name string, outcome string, matched string"


def inbox(spark: SparkSession, folder: str) -> DataFrame:
    """New files of the inbox as a stream."""
    return spark.readStream.format("binaryFile").schema(FILES).load(folder)


def described(files: DataFrame) -> DataFrame:
    """name, modified, hash and key (canonical address of a link file) of incoming files."""
    name = F.element_at(F.split("path", "/"), -1)
    link = F.when(F.lower(name).rlike("\\.(txt|url)$"), canonical_url(first_url(F.col("content").cast("string"))))
    return files.select(name.alias("name"), "path", F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("hash"), F.nullif(link, F.lit("")).alias("key"))


def decide_batch(batch: DataFrame, claimed: DataFrame) -> DataFrame:
    """outcome of each file: duplicate of an earlier one by hash or address, in this batch or before, else new.

    Within a batch files count in the order of their time and name.
    """
    order = [F.col("modified"), F.col("name")]
    # the first file of each hash and key is worked out where the files are, so no task sorts all files of one
    first = lambda by, name: batch.filter(F.col(by).isNotNull()).groupBy(by).agg(F.min(F.struct(*order)).alias("_f")).select(by, F.col("_f.name").alias(name))
    rows = batch.join(first("hash", "_h"), "hash", "left").join(first("key", "_k"), "key", "left")
    seen = claimed.filter("outcome = 'new'")
    by_hash = seen.groupBy("hash").agg(F.min("name").alias("_sh"))
    by_key = seen.filter("key IS NOT NULL").groupBy("key").agg(F.min("name").alias("_sk"))
    rows = rows.join(by_hash, "hash", "left").join(by_key, "key", "left")
    matched = F.coalesce("_sh", F.when(F.col("_h") != F.col("name"), F.col("_h")), "_sk", F.when(F.col("_k") != F.col("name"), F.col("_k")))
    return rows.select("hash", "key", "name", F.when(matched.isNull(), "new").otherwise("duplicate").alias("outcome"), matched.alias("matched"))


def drain(spark: SparkSession, folder: str, state: str, checkpoint: str, now: str | None = None) -> int:
    """Take in everything that waits and stop; returns the number of batches that had files.

    Decisions are written to ``state`` under twice the batch's number, so a batch that runs again after a failure replaces
    its own rows. Files younger than SETTLE_SECONDS at ``now`` wait in a pending table, as a stream offers a file only
    once; every later call takes those that have settled, with the next batch or, where none comes, under an odd number.
    """
    batches = 0
    settled = F.lit(True) if now is None else F.col("modified") <= F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {SETTLE_SECONDS} SECONDS")

    def one(batch: DataFrame, number: int) -> None:
        nonlocal batches
        batches += 1
        at = 2 * number
        rows = described(batch).unionByName(waiting(spark, state, at - 2))
        rows.filter(~settled).write.mode("overwrite").parquet(f"{state}/pending/batch={at}")
        decide_batch(rows.filter(settled), claimed(spark, state).filter(F.col("batch") < at)).write.mode("overwrite").parquet(f"{state}/claimed/batch={at}")

    query = inbox(spark, folder).writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(one).start()
    query.awaitTermination()
    last = _table(spark, f"{state}/pending", PENDING).agg(F.max("batch")).first()[0]
    if last is not None:  # what has settled by now, this call's or an earlier one's; the rows of an earlier call come again
        rows = _table(spark, f"{state}/pending", PENDING).filter(F.col("batch") == last).drop("batch").filter(settled)
        decide_batch(rows, claimed(spark, state).filter(F.col("batch") <= last)).write.mode("overwrite").parquet(f"{state}/claimed/batch={last + 1}")
    return batches


def waiting(spark: SparkSession, state: str, at: int) -> DataFrame:
    """The files that were not settled in batch ``at`` and that no later call has taken."""
    rows = _table(spark, f"{state}/pending", PENDING).filter(F.col("batch") == at).drop("batch")
    taken = claimed(spark, state).filter(F.col("batch") == at + 1).select("name", "hash")
    return rows.join(taken, ["name", "hash"], "left_anti").select(*[f.split()[0] for f in PENDING.split(", ")])


def claimed(spark: SparkSession, state: str) -> DataFrame:
    """All decisions so far, with the number of their batch."""
    return _table(spark, f"{state}/claimed", CLAIMED)


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], f"{schema}, batch int")
    return spark.read.schema(f"{schema}, batch int").parquet(path)
