"""Tables that are replaced as a whole: a new version is written beside the old one and then named the current one.

Readers see the old version or the new one, never a half-written table, and a failure before the switch changes nothing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

POINTER = "current"


def _fs(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def publish(df: DataFrame, root: str) -> str:
    """Write ``df`` as the new current version under ``root``; returns the version's name."""
    spark = df.sparkSession
    version = f"v-{uuid.uuid4().hex}"
    df.write.parquet(f"{root}/{version}")
    fs, at = _fs(spark, f"{root}/{POINTER}")
    _, new = _fs(spark, f"{root}/{POINTER}-{version}")
    out = fs.create(new, True)
    out.write(bytearray(version.encode()))
    out.close()
    old = _fs(spark, f"{root}/{POINTER}-old")[1]
    if fs.exists(at):
        fs.delete(old, False)
        fs.rename(at, old)
    fs.rename(new, at)
    return version


def current(spark: SparkSession, root: str) -> DataFrame | None:
    """The current version, or None where nothing was published; a switch that was cut short leaves the old one."""
    for name in (POINTER, f"{POINTER}-old"):
        fs, at = _fs(spark, f"{root}/{name}")
        if fs.exists(at):
            found = spark.read.text(f"{root}/{name}", wholetext=True).first()[0].strip()
            return spark.read.parquet(f"{root}/{found}")
    return None
