"""Tables written on the way: in the folder that driver and executors share, deleted when the session ends."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset and all runs in one process (``local[...]``), a folder of the warehouse.

    Elsewhere a missing setting is an error, as executors do not see a folder of the driver.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = f"{spark.conf.get('spark.sql.warehouse.dir')}/shared"
    return found.rstrip("/")


def fresh(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def cut(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` written and read again: worked out once, and no lost executor brings their lineage back."""
    spark = rows.sparkSession
    path = fresh(spark, name)
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)
