"""Folder listings and recorded service responses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from libraryloom.functions import measures

UPLOAD = "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"
LOG_TAIL = 4000


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """name, size, size_text and modified of the visible files of a folder."""
    rows = spark.read.format("binaryFile").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    return rows.select(name.alias("name"), F.col("length").alias("size"), measures.size_text(F.col("length")).alias("size_text"), F.col("modificationTime").alias("modified")).filter(~F.col("name").startswith("."))


def quarantined(spark: SparkSession, folder: str) -> DataFrame:
    """The files of a quarantine folder with the end of the log that lies beside each, empty without one."""
    rows = spark.read.format("binaryFile").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), "content")
    logs = rows.filter(F.col("name").endswith(".log")).select(F.regexp_replace("name", "\\.log$", "").alias("name"), F.right(F.col("content").cast("string"), F.lit(LOG_TAIL)).alias("log"))
    files = rows.filter(~F.col("name").endswith(".log")).drop("content")
    return files.join(logs, "name", "left").withColumn("log", F.coalesce("log", F.lit("")))


def staged(spark: SparkSession, folder: str) -> DataFrame:
    """Staged files with in_flight: whether staging named them; the others are strays."""
    return listing(spark, folder).withColumn("in_flight", F.col("name").rlike(UPLOAD))


def status_payload(runs: DataFrame, inbox: DataFrame, staged_files: DataFrame, failed: DataFrame, duplicates: DataFrame, last: int = 20) -> DataFrame:
    """One row: how many files wait in each place and what the last ``last`` runs (newest first, with place) cost."""
    cost = runs.filter(F.col("place") <= last).agg(F.coalesce(F.sum(F.coalesce("cost_usd", F.lit(0.0))), F.lit(0.0)).alias("recent_cost"), F.count(F.lit(1)).alias("runs"))
    count = lambda rows, name: rows.agg(F.count(F.lit(1)).alias(name))
    out = cost
    for one in (count(inbox, "inbox"), staged_files.agg(F.count_if("in_flight").alias("in_flight"), F.count_if(~F.col("in_flight")).alias("stray")), count(failed, "failed"), count(duplicates, "duplicate")):
        out = out.crossJoin(F.broadcast(one))  # one row each
    return out


def recorded_responses(spark: SparkSession, path: str, attempts: int = 3) -> DataFrame:
    """key, body and error from recorded answers of a service: a JSON line for each request, its responses in the order tried.

    The body is that of the first good response (status 200) within ``attempts``; without one the error says how the last
    attempt ended. Lines that can't be read are left out.
    """
    lines = spark.read.text(path).filter(F.try_parse_json("value").isNotNull())
    field = lambda k, name: F.get_json_object("value", f"$.responses[{k}].{name}")
    tries = F.least(F.coalesce(F.json_array_length(F.get_json_object("value", "$.responses")), F.lit(0)), F.lit(attempts))
    good = F.coalesce(*[F.when((tries > k) & (field(k, "status").try_cast("int") == 200), F.struct(field(k, "body").alias("body"))) for k in range(attempts)])
    last = F.coalesce(*[F.when(tries == k + 1, F.coalesce(field(k, "status"), F.lit("None"))) for k in range(attempts)])
    failed = F.when(tries == 0, "no response").otherwise(F.concat(F.lit("status "), last, F.lit(" after "), tries.cast("string"), F.lit(" attempts")))
    return lines.select(F.get_json_object("value", "$.key").alias("key"), good["body"].alias("body"), F.when(good.isNull(), failed).alias("error"))
