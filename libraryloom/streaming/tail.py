"""The events of a growing run log: a stream that parses only the bytes that were appended and keeps the last events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from libraryloom.sources.records import events
from libraryloom.streaming import growing

KEPT, SERVED = 400, 200
EVENTS = "seq long, icon string, text string"


def drain_log(spark: SparkSession, folder: str, state: str, checkpoint: str, keep: int = KEPT) -> None:
    """Parse what was appended to the files of ``folder``, one run's log, since the last call; only complete lines count.

    Lines count in the order of their file's time and their place. The events kept are the last ``keep``; they are written
    under the number of the batch, so a batch that runs again replaces its own. A file that was begun anew means a new
    run: earlier events go, and numbers go on. Other runs have folders of their own.
    """

    def one(batch: DataFrame, number: int) -> None:
        lines = batch.withColumn("line", F.struct("modified", "path", "at"))
        new = events(lines).select("line", "icon", "text")
        before = kept(spark, state, number - 1)
        start = before.agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]
        if not batch.filter("reset").isEmpty():
            before = before.limit(0)
        newest = new.withColumn("_k", F.monotonically_increasing_id()).orderBy(F.desc("line"), F.desc("_k")).limit(keep)
        rows = newest.collect()[::-1]  # at most ``keep``
        own = spark.createDataFrame([(start + 1 + k, r.icon, r.text) for k, r in enumerate(rows)], EVENTS)
        before.unionByName(own).orderBy(F.desc("seq")).limit(keep).coalesce(1).write.mode("overwrite").parquet(f"{state}/batch={number}")

    growing.register(spark)
    lines = spark.readStream.format("growing_files").load(folder)
    lines.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(one).start().awaitTermination()


def kept(spark: SparkSession, state: str, number: int | None = None) -> DataFrame:
    """The events kept after a batch, the last one if none is named."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(state)
    if (number is not None and number < 0) or not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], EVENTS)
    rows = spark.read.schema(f"{EVENTS}, batch int").parquet(state)
    if number is None:
        number = rows.agg(F.max("batch")).first()[0]
    return rows.filter(F.col("batch") == F.lit(number)).drop("batch")


def served(spark: SparkSession, state: str, most: int = SERVED) -> DataFrame:
    """The last events in order, as the console asks for them."""
    return kept(spark, state).orderBy(F.desc("seq")).limit(most).orderBy("seq")
