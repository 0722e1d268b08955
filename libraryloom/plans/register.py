"""The registry of table queries and the SQL beside them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from libraryloom.functions.urls import TRACKING

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def register(sql: str):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


#: One spelling of the address ``url``.
_URL = "regexp_replace(url, '^[\\s\\x0b]+|[\\s\\x0b]+$', '', 'g')"
_KEPT = f"list_filter(string_split(regexp_extract({_URL}, '^[^?#]*\\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^(?i)({'|'.join(TRACKING)})'))"
CANON = f"""
CASE WHEN regexp_matches({_URL}, '(?i)^https?://') THEN
  lower(regexp_extract({_URL}, '(?i)^(https?)://', 1)) || '://' || lower(regexp_extract({_URL}, '(?i)^https?://([^/?#]*)', 1))
  || regexp_replace(regexp_extract({_URL}, '(?i)^https?://[^/?#]*([^?#]*)', 1), '/+$', '')
  || CASE WHEN len({_KEPT}) > 0 THEN '?' || array_to_string({_KEPT}, '&') ELSE '' END
ELSE {_URL} END
"""
