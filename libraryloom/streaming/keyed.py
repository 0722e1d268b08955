"""Intake state by key: what a batch costs follows its own size, not the history.

``claims`` decides incoming files against all earlier ones by hash and address: two chained operators, each with one small
value for a key. ``waiting`` holds rows until their time has come and then gives them out: files that must settle, checks
that grow stale, notes that wait. Its time is the caller's ``now``, carried by the rows as event time, and its timers are
Spark's, so a row comes out when a later batch moves the time past it, without anything that waits being read again.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

HASHED = "hash string, key string, name string, modified timestamp, by_hash string"
CLAIMED = "hash string, key string, name string, outcome string, matched string"
HELD = "key string, due timestamp, payload string"


def sized(spark: SparkSession, partitions: int) -> SparkSession:
    """A session for streams with keyed state: its store, and a number of partitions, which a checkpoint then keeps."""
    session = spark.newSession()
    for name, value in (
        ("spark.sql.shuffle.partitions", str(partitions)), ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"),
        ("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true"), ("spark.sql.streaming.stateStore.rocksdb.allowFAllocate", "false"), ("spark.sql.session.timeZone", "UTC"),
    ):
        session.conf.set(name, value)
    return session


def run(rows: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Take in everything that waits, append results to ``out`` exactly once, and stop."""
    query = rows.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


# -- duplicates ----------------------------------------------------------------------------------------------------------


class _First(StatefulProcessor):
    """The name of the first file of each key, by time and name; the other files of the key get it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.first = handle.getValueState("first", "name string")

    def _earliest(self, rows: Iterator[pd.DataFrame]) -> tuple[list[pd.DataFrame], str | None]:
        held = self.first.get()
        frames = list(rows)
        if held is not None:
            return frames, held[0]
        return frames, min((r.modified, r.name) for f in frames for r in f[["modified", "name"]].itertuples(index=False, name="R"))[1]

    def close(self) -> None:
        pass


class ByHash(_First):
    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        frames, first = self._earliest(rows)
        for f in frames:
            yield f[["hash", "key", "name", "modified"]].assign(by_hash=[first if first != n else None for n in f["name"]])
        self.first.update((first,))


class ByAddress(_First):
    """Files without an address pass by; a copy by hash does not claim an address, as its first one has."""

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        frames = list(rows)
        if frames and pd.isna(frames[0]["key"].iloc[0]):
            first = None
        else:
            frames, first = self._earliest(iter(frames))
            self.first.update((first,))
        for f in frames:
            other = pd.Series([first if first != n else None for n in f["name"]], index=f.index, dtype=object)
            matched = f["by_hash"].astype(object).where(f["by_hash"].notna(), other)
            yield pd.DataFrame({"hash": f["hash"], "key": f["key"], "name": f["name"], "outcome": ["new" if pd.isna(m) else "duplicate" for m in matched], "matched": matched})


def claims(files: DataFrame) -> DataFrame:
    """outcome (new, duplicate) and matched of each file of a stream (hash, key: its address or null, name, modified).

    The first file of a hash, by time and name, is what later ones match, in whatever batch they come; where none has the
    hash, the first file of the address is. Hash comes before address. A name is taken to stand for one file: rows that
    repeat it with the same hash are one claim. State is one name for each hash and each address.
    """
    by_hash = files.select("hash", "key", "name", "modified").groupBy("hash").transformWithStateInPandas(ByHash(), HASHED, "append", "None")
    place = F.coalesce(F.concat(F.lit("a:"), "key"), F.concat(F.lit("h:"), "hash")).alias("place")  # files without one are spread by hash
    return by_hash.select("*", place).groupBy("place").transformWithStateInPandas(ByAddress(), CLAIMED, "append", "None")


# -- waiting -------------------------------------------------------------------------------------------------------------


class _ClockReader(DataSourceStreamReader):
    def __init__(self, now: int) -> None:
        self.now = now

    def initialOffset(self) -> dict:
        return {"now": -1}

    def latestOffset(self) -> dict:
        return {"now": self.now}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [InputPartition(end["now"])] if end["now"] > start["now"] else []

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield (dt.datetime.fromtimestamp(partition.value / 1e6, dt.UTC),)


class Clock(DataSource):
    """A stream of one row a start: the caller's ``now`` (microseconds since 1970), if it is later than before."""

    @classmethod
    def name(cls) -> str:
        return "clock"

    def schema(self) -> str:
        return "seen timestamp"

    def streamReader(self, schema: Any) -> _ClockReader:
        return _ClockReader(int(self.options["now"]))


class Holding(StatefulProcessor):
    """The last row of each key and a timer for it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "due timestamp, payload string")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        if key[0] is None:
            return
        last = None
        for f in rows:
            row = f.sort_values(["due", "payload"], kind="stable").iloc[-1]
            if last is None or (row["due"], row["payload"]) > (last["due"], last["payload"]):
                last = row
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        due, now = pd.Timestamp(last["due"]), pd.Timestamp(last["seen"])
        if due <= now:
            self.held.clear()
            yield pd.DataFrame({"key": [key[0]], "due": [due], "payload": [last["payload"]]})
            return
        self.held.update((due.to_pydatetime(), last["payload"]))
        self.handle.registerTimer(-(-due.value // 1_000_000))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        held = self.held.get()
        if held is not None:
            self.held.clear()
            yield pd.DataFrame({"key": [key[0]], "due": [pd.Timestamp(held[0])], "payload": [held[1]]})

    def close(self) -> None:
        pass


def waiting(rows: DataFrame, now: dt.datetime) -> DataFrame:
    """``rows`` of a stream (key, due, payload) as they become due at ``now``; of one key the row due last.

    A row of a key that is waiting takes its place and its time, so a file that is written again settles anew and a check
    that is made again grows stale later. What is due when it comes goes out at once. ``now`` never goes back. A null key
    or time is never due.
    """
    spark = rows.sparkSession
    spark.dataSource.register(Clock)
    ticks = spark.readStream.format("clock").option("now", int(now.replace(tzinfo=now.tzinfo or dt.UTC).timestamp() * 1e6)).load()
    none = F.lit(None).cast("string")
    held = rows.filter("key IS NOT NULL AND due IS NOT NULL").select("key", "due", F.coalesce("payload", F.lit("")).alias("payload"), F.lit(now).cast("timestamp").alias("seen"))
    both = held.unionByName(ticks.select(none.alias("key"), F.col("seen").alias("due"), none.alias("payload"), "seen"))
    return both.withWatermark("seen", "0 seconds").groupBy("key").transformWithStateInPandas(Holding(), HELD, "append", "EventTime")


def pass_on(rows: DataFrame, now: dt.datetime, out: str, checkpoint: str) -> None:
    """Append to ``out`` what is due of ``rows`` and of what waits at ``checkpoint``.

    The query starts twice: a start ends without a batch for timers, so the second, a microsecond on, has the first one's
    time as its watermark.
    """
    for at in (now, now + dt.timedelta(microseconds=1)):
        run(waiting(rows, at), out, checkpoint)
