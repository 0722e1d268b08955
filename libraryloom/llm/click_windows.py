"""Expiring click deduplication: two chained stateful operators of one streaming query, on one checkpoint.

The first operator holds, for each click_id with an open window, the opener's start hour (hence the deadline) and hash.
It drops rows that are too late, tags each row with the identity of its window, (click_id, start_hour), and sends a
control event when a window closes. The second operator holds the counters of open windows and gives a row when a
window's control event arrives. How far time has come travels as control rows of the input, one for each group of keys
and batch, so no operator needs a clock or a timeout, and a batch that is run again gives the same.

Keys are grouped in buckets of click_ids by hash, so that a state is read and written by the bucket, in a few arrays, and
rules are applied to all ids of a bucket at once. The number of buckets follows the number of rows, a bucket's size does
not. Equal copies (click_id, hour, hash) of a batch are counted before they are written, with a combine on the map side,
so a click that is delivered over and over is one row with a count.

Rows without click_id or arrived_at have no copies and take no part. Other nulls are empty in the hash; an arriving
row is never lost but by the rule of lateness. An empty table gives no windows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from libraryloom.llm.common import fresh_path

#: Hours from a window's start to its deadline, and hours that a row may lag behind the latest hour of earlier batches.
WINDOW, LATENESS = 24, 96
BATCHES = 8
#: Rows of all batches for a partition of the streaming query, and buckets of keys in it.
PARTITION_ROWS, PARTITION_BUCKETS, LEAST_PARTITIONS = 250_000, 8, 6
#: No row can be too late for this hour, none is in time for the other.
NO_LIMIT, ALL_HOURS = -(2**62), 2**62

FED = "bucket long, click_id long, hour long, hash binary, n long, late long, expired long, control int, batch int"
TAGGED = "bucket long, control int, click_id long, start_hour long, n long, conflicts long, crc long, closed_batch long, hash binary"
CLOSED = "click_id long, start_hour long, closed_batch long, n_repeats long, n_conflicts long, conflict_crc long, hash binary"


def utc_micros(df: DataFrame, name: str) -> Column:
    """Microseconds since 1970 of a timestamp column; one without a zone is read as UTC, whatever the session's zone."""
    if isinstance(df.schema[name].dataType, T.TimestampNTZType):
        seconds = F.expr(f"cast(cast(`{name}` - timestamp_ntz'1970-01-01 00:00:00' as interval second) as decimal(30, 6))")
        return (seconds * 1_000_000).cast("long")
    return F.unix_micros(F.col(name))


def copies(clicks: DataFrame, batches: int = BATCHES) -> DataFrame:
    """(click_id, hour, hash binary, batch) of the copies j = 0 to click_id % 3 of each row, dealt to batches by lag."""
    hours = utc_micros(clicks, "arrived_at")
    rows = clicks.select("click_id", ((hours - F.pmod(hours, F.lit(3_600_000_000))) / 3_600_000_000).cast("long").alias("at"), "client_id", "kind", "value", utc_micros(clicks, "ts").alias("us"), "props")
    rows = rows.filter(F.col("click_id").isNotNull() & F.col("at").isNotNull()).withColumn("j", F.explode(F.sequence(F.lit(0), F.pmod("click_id", F.lit(3)).cast("int"))))
    rows = rows.withColumn("c", F.crc32(F.concat_ws(":", F.col("click_id").cast("string"), F.col("j").cast("string")).cast("binary")))
    rows = rows.withColumn("hour", F.col("at") + 6 * F.col("j") * (F.col("c") % 10))
    rows = rows.withColumn("lag", F.col("hour") + F.floor(F.col("c") / 10) % 200)
    low, high = rows.agg(F.min("lag"), F.max("lag")).first()
    low, span = (0, 1) if low is None else (low, high - low + 1)
    parts = [F.col("client_id"), F.col("kind"), F.floor(100 * F.col("value") + 0.5), F.col("us"), F.col("props"), F.col("c") % 3]
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return rows.select("click_id", "hour", F.unhex(F.sha2(text, 256)).alias("hash"), F.floor((F.col("lag") - low) * batches / span).cast("int").alias("batch"))


# -- the two operators over arrays ---------------------------------------------------------------------------------------


def _bytes32(column: Iterable[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype="S32")


def _objects(hashes: np.ndarray) -> list[bytes]:
    raw = hashes.tobytes()
    return [raw[i : i + 32] for i in range(0, len(raw), 32)]


def openers(ids: np.ndarray, hours: np.ndarray, deadline: np.ndarray, window: int) -> np.ndarray:
    """True for rows that open a window; rows are sorted by (ids, hours), ``ids`` are 0, 1, ... without gaps.

    ``deadline`` has each id's deadline so far, below all hours where none is open. All ids take a step at once: to
    their first row beyond the deadline.
    """
    opens = np.zeros(len(ids), dtype=bool)
    if not len(ids):
        return opens
    low, span = hours.min(), int(hours.max() - hours.min()) + 2
    place = ids * span + (hours - low)
    ends = np.searchsorted(ids, np.arange(len(deadline)), side="right")
    active = np.arange(len(deadline))
    while len(active):
        at = np.searchsorted(place, active * span + np.clip(deadline[active] - low, -1, span - 1), side="right")
        there = at < ends[active]
        active, at = active[there], at[there]
        opens[at] = True
        deadline[active] = hours[at] + window
    return opens


def tag_rows(bucket: int, rows: pd.DataFrame, held: tuple[bytes, ...], window: int) -> tuple[tuple[bytes, ...], list[pd.DataFrame]]:
    """The first operator over one bucket's rows of a batch: its new state, and what it sends on.

    ``held`` is the state: ids, start hours and hashes of the opener of each open window, sorted by id.
    """
    open_ids, open_starts, open_hashes = np.frombuffer(held[0], dtype=np.int64), np.frombuffer(held[1], dtype=np.int64), np.frombuffer(held[2], dtype="S32")
    control = rows[rows["control"] == 1].iloc[0]
    batch = int(control["batch"])
    rows = rows[(rows["control"] == 0) & (rows["hour"] >= int(control["late"]))]
    ids, hours, hashes, n, crc = rows["click_id"].to_numpy(), rows["hour"].to_numpy(), _bytes32(rows["hash"]), rows["n"].to_numpy(), rows["crc"].to_numpy()
    order = np.lexsort((hashes, hours, ids))
    ids, hours, hashes, n, crc = ids[order], hours[order], hashes[order], n[order], crc[order]

    own, first, place = np.unique(ids, return_index=True, return_inverse=True)
    at = np.minimum(np.searchsorted(open_ids, own), max(len(open_ids) - 1, 0))
    held_open = open_ids[at] == own if len(open_ids) else np.zeros(len(own), dtype=bool)
    deadline = np.where(held_open, open_starts[at] + window, NO_LIMIT) if len(open_ids) else np.full(len(own), NO_LIMIT, dtype=np.int64)
    opens = openers(place, hours, deadline, window)
    by = np.maximum.accumulate(np.where(opens, np.arange(len(ids)), -1)) if len(ids) else np.zeros(0, dtype=np.int64)
    earlier = by < first[place]  # the window was open before this batch
    starts = np.where(earlier, open_starts[at[place]], hours[by]) if len(open_ids) else hours[by]
    like = np.where(earlier, open_hashes[at[place]], hashes[by]) if len(open_ids) else hashes[by]
    repeats = n - opens
    conflicts = np.where(hashes != like, repeats, 0)
    told = repeats > 0

    opened = np.flatnonzero(opens)
    followed = np.append(place[opened][1:] == place[opened][:-1], False) if len(opened) else np.zeros(0, dtype=bool)
    over = np.zeros(len(open_ids), dtype=bool)
    over[at[held_open & (np.bincount(place[opened], minlength=len(own)) > 0)]] = True
    end_ids = np.concatenate([open_ids[over], ids[opened[followed]]])
    end_starts = np.concatenate([open_starts[over], hours[opened[followed]]])
    end_hashes = np.concatenate([open_hashes[over], hashes[opened[followed]]])
    open_ids = np.concatenate([open_ids[~over], ids[opened[~followed]]])
    open_starts = np.concatenate([open_starts[~over], hours[opened[~followed]]])
    open_hashes = np.concatenate([open_hashes[~over], hashes[opened[~followed]]])
    gone = open_starts + window < int(control["expired"])
    end_ids, end_starts, end_hashes = np.concatenate([end_ids, open_ids[gone]]), np.concatenate([end_starts, open_starts[gone]]), np.concatenate([end_hashes, open_hashes[gone]])
    order = np.flatnonzero(~gone)[np.argsort(open_ids[~gone], kind="stable")]
    held = (open_ids[order].tobytes(), open_starts[order].tobytes(), open_hashes[order].tobytes())

    tags = pd.DataFrame({"bucket": bucket, "control": 0, "click_id": ids[told], "start_hour": starts[told], "n": repeats[told], "conflicts": conflicts[told], "crc": (conflicts * crc)[told], "closed_batch": -1, "hash": b""})
    events = pd.DataFrame({"bucket": bucket, "control": 1, "click_id": end_ids, "start_hour": end_starts, "n": 0, "conflicts": 0, "crc": 0, "closed_batch": batch, "hash": _objects(end_hashes)})
    return held, [tags, events]


def count_windows(rows: pd.DataFrame, held: tuple[bytes, ...]) -> tuple[tuple[bytes, ...], list[pd.DataFrame]]:
    """The second operator: adds rows to their windows' counters (the state), gives the windows whose control event came."""
    ends = rows["control"].to_numpy() == 1
    told = rows[~ends]
    table = np.concatenate([np.frombuffer(held[0], dtype=np.int64).reshape(5, -1), told[["click_id", "start_hour", "n", "conflicts", "crc"]].to_numpy(dtype=np.int64).T], axis=1)
    table = table[:, np.lexsort((table[1], table[0]))]
    new = np.ones(table.shape[1], dtype=bool)
    new[1:] = (table[0, 1:] != table[0, :-1]) | (table[1, 1:] != table[1, :-1])
    at = np.flatnonzero(new)
    if len(at):
        table = np.concatenate([table[:2, at], np.add.reduceat(table[2:], at, axis=1)])
    closed = rows.loc[ends, ["click_id", "start_hour", "closed_batch", "hash"]].reset_index(drop=True)
    counters = pd.DataFrame(table.T, columns=["click_id", "start_hour", "n_repeats", "n_conflicts", "conflict_crc"])
    out = closed.merge(counters.assign(place=np.arange(len(counters))), on=["click_id", "start_hour"], how="left")
    stay = np.ones(table.shape[1], dtype=bool)
    stay[out["place"].dropna().to_numpy(dtype=np.int64)] = False
    for name in ("n_repeats", "n_conflicts", "conflict_crc"):
        exact = np.zeros(len(out), dtype=np.int64)
        known = out["place"].notna().to_numpy()
        exact[known] = counters[name].to_numpy()[out["place"][known].to_numpy(dtype=np.int64)]
        out[name] = exact
    return (np.ascontiguousarray(table[:, stay]).tobytes(),), [out[["click_id", "start_hour", "closed_batch", "n_repeats", "n_conflicts", "conflict_crc", "hash"]]]


class Windows(StatefulProcessor):
    """First operator: openers and deadlines of open windows."""

    def __init__(self, window: int) -> None:
        self.window = window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getValueState("open", "ids binary, starts binary, hashes binary")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        held, out = tag_rows(int(key[0]), pd.concat(list(rows), ignore_index=True), self.open.get() or (b"", b"", b""), self.window)
        self.open.update(held)
        yield from out

    def close(self) -> None:
        pass


class Counters(StatefulProcessor):
    """Second operator: counters of open windows."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counters = handle.getValueState("counters", "counters binary")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        held, out = count_windows(pd.concat(list(rows), ignore_index=True), self.counters.get() or (b"",))
        self.counters.update(held)
        yield from out

    def close(self) -> None:
        pass


# -- the streaming query -------------------------------------------------------------------------------------------------


def chained(fed: DataFrame, buckets: int, window: int = WINDOW) -> DataFrame:
    """The two operators over a stream of rows and control rows (columns of FED)."""
    bucket = F.when(F.col("control") == 1, F.col("bucket")).otherwise(F.pmod(F.xxhash64("click_id"), F.lit(buckets)))
    rows = fed.withColumn("bucket", bucket).withColumn("crc", F.crc32(F.lower(F.hex("hash")).cast("binary")))
    tagged = rows.groupBy("bucket").transformWithStateInPandas(Windows(window), TAGGED, "append", "None")
    return tagged.groupBy("bucket").transformWithStateInPandas(Counters(), CLOSED, "append", "None")


def _move(spark: SparkSession, source: str, target: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(source).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(path(target).getParent())
    if not fs.rename(path(source), path(target)):
        raise OSError(f"could not move {source} to {target}")


def _stream_session(spark: SparkSession, home: str, partitions: int) -> SparkSession:
    """A session for a stream whose checkpoint lies in ``home`` and holds its number of partitions fast.

    A query that is started anew opens all of its stores again, so a store is closed when its task ends: an executor holds
    one for each running task, not those of all partitions and of the run before.
    """
    session = spark.newSession()
    session.conf.set("spark.sql.shuffle.partitions", str(partitions))
    session.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    session.conf.set("spark.sql.streaming.stateStore.unloadOnCommit", "true")
    session.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    session.conf.set("spark.sql.streaming.stateStore.rocksdb.allowFAllocate", "false")  # many small stores, one for each start
    session.conf.set("spark.sql.streaming.checkpoint.fileChecksum.enabled", "false")  # a second file for each; the folder serves one call
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(home)
    if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getScheme() == "file":
        # there the default starts processes (stat, readlink) for each file that it renames
        session.conf.set("spark.sql.streaming.checkpointFileManagerClass", "org.apache.spark.sql.execution.streaming.checkpointing.FileSystemBasedCheckpointFileManager")
    return session


def windows(spark: SparkSession, events: DataFrame, batches: int = BATCHES, window: int = WINDOW, lateness: int = LATENESS) -> DataFrame:
    """Windows of ``events`` (click_id, hour, hash: 32 bytes, batch from 0), whose batches are fed to the stream in order.

    One row a window: click_id, start_hour, closed_batch, n_repeats, n_conflicts, conflict_crc, hash (binary). Each call
    has a new folder; the query is started anew for each batch and ends when it has read it. The driver sees two numbers
    for each batch: its latest hour and its number of rows.
    """
    home = fresh_path(spark, "click-windows")
    counted = events.groupBy("batch", "click_id", "hour", "hash").agg(F.count(F.lit(1)).alias("n"))
    zero = lambda name: F.lit(0).cast("long").alias(name)
    counted = counted.select(zero("bucket"), "click_id", "hour", "hash", "n", zero("late"), zero("expired"), F.lit(0).alias("control"), "batch")
    counted.write.partitionBy("batch").option("compression", "zstd").parquet(f"{home}/cut")
    schema = T._parse_datatype_string(FED)
    seen = {r.batch: (r.latest, r.rows) for r in spark.read.schema(schema).parquet(f"{home}/cut").groupBy("batch").agg(F.max("hour").alias("latest"), F.count(F.lit(1)).alias("rows")).collect()}
    partitions = max(LEAST_PARTITIONS, -(-sum(rows for _, rows in seen.values()) // PARTITION_ROWS))
    buckets = partitions * PARTITION_BUCKETS

    limits, latest = [], None
    for b in range(batches):
        late = NO_LIMIT if latest is None else latest - lateness
        latest = max((x for x in (latest, seen.get(b, (None, 0))[0]) if x is not None), default=None)
        limits.append((b, late, ALL_HOURS if b == batches - 1 else NO_LIMIT if latest is None else latest - lateness))
    marks = F.explode(F.array(*[F.struct(F.lit(b).alias("batch"), F.lit(late).cast("long").alias("late"), F.lit(expired).cast("long").alias("expired")) for b, late, expired in limits])).alias("m")
    control = spark.range(buckets, numPartitions=max(1, buckets // 100_000)).select(F.col("id").alias("bucket"), marks).select("bucket", zero("click_id"), zero("hour"), F.lit(b"").alias("hash"), zero("n"), "m.late", "m.expired", F.lit(1).alias("control"), "m.batch")
    control.write.mode("append").partitionBy("batch").option("compression", "zstd").parquet(f"{home}/cut")

    session = _stream_session(spark, home, partitions)
    for b in range(batches):
        _move(spark, f"{home}/cut/batch={b}", f"{home}/fed/batch={b}")
        fed = session.readStream.schema(schema).parquet(f"{home}/fed")
        query = chained(fed, buckets, window).writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{home}/checkpoint").option("path", f"{home}/windows").trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.schema(CLOSED).parquet(f"{home}/windows")


def click_windows(spark: SparkSession, clicks: DataFrame) -> DataFrame:
    """Windows of the copies of ``clicks`` with the opener's hash in lowercase hex."""
    found = windows(spark, copies(clicks))
    return found.withColumn("hash", F.lower(F.hex("hash")))


ORACLE_SQL = """
WITH RECURSIVE
crcs AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) ORDER BY i) AS t
  FROM range(256) r(i)
),
copied AS (
  SELECT k.*, k.click_id::VARCHAR || ':' || j::VARCHAR AS name, j
  FROM (SELECT *, unnest(range(0, click_id % 3 + 1)) AS j FROM clicks WHERE click_id IS NOT NULL AND arrived_at IS NOT NULL) k
),
numbered AS (
  SELECT copied.*, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(name) + 1), lambda i: ascii(name[i])::BIGINT)),
    lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) AS c
  FROM copied, crcs
),
lagged AS (
  SELECT *, epoch_us(arrived_at) // 3600000000 + 6 * j * (c % 10) AS hour, epoch_us(arrived_at) // 3600000000 + 6 * j * (c % 10) + (c // 10) % 200 AS lag
  FROM numbered
),
x AS (
  SELECT click_id, hour, (lag - min(lag) OVER ()) * 8 // (max(lag) OVER () - min(lag) OVER () + 1) AS batch,
    sha256(coalesce(client_id::VARCHAR, '') || '|' || coalesce(kind, '') || '|' || coalesce(floor(100 * value + 0.5)::BIGINT::VARCHAR, '') || '|' ||
      coalesce(epoch_us(ts)::VARCHAR, '') || '|' || coalesce(props, '') || '|' || (c % 3)::VARCHAR) AS hash
  FROM lagged
),
m AS (SELECT b AS batch, (SELECT max(hour) FROM x WHERE x.batch < b) AS m FROM range(8) r(b)),
kept AS (
  SELECT x.*, row_number() OVER (PARTITION BY click_id ORDER BY x.batch, hour, hash) AS rn
  FROM x JOIN m ON x.batch = m.batch WHERE x.batch = 0 OR hour >= m.m - 96
),
w AS (
  SELECT click_id, rn, hour AS start_hour, batch, hash FROM kept WHERE rn = 1
  UNION ALL
  SELECT k.click_id, min(k.rn), arg_min(k.hour, k.rn), arg_min(k.batch, k.rn), arg_min(k.hash, k.rn)
  FROM w JOIN kept k ON k.click_id = w.click_id AND k.rn > w.rn AND k.hour > w.start_hour + 24 GROUP BY k.click_id
),
ended AS (SELECT *, lead(rn) OVER s AS next_rn, lead(batch) OVER s AS next_batch FROM w WINDOW s AS (PARTITION BY click_id ORDER BY rn)),
expiry AS (
  SELECT e.click_id, e.rn, min(m.batch) - 1 AS batch FROM ended e JOIN m ON m.batch > e.batch AND e.start_hour + 24 < m.m - 96 GROUP BY e.click_id, e.rn
)
SELECT e.click_id, e.start_hour, least(coalesce(e.next_batch, 7), coalesce(any_value(x.batch), 7))::BIGINT AS closed_batch,
  count(k.rn) AS n_repeats, count(k.rn) FILTER (WHERE k.hash <> e.hash) AS n_conflicts,
  coalesce(sum(CASE WHEN k.hash <> e.hash THEN xor(list_reduce(list_prepend(4294967295, list_transform(range(1, 65), lambda i: ascii(k.hash[i])::BIGINT)),
    lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) END), 0)::BIGINT AS conflict_crc, e.hash
FROM ended e CROSS JOIN crcs LEFT JOIN expiry x ON x.click_id = e.click_id AND x.rn = e.rn
LEFT JOIN kept k ON k.click_id = e.click_id AND k.rn > e.rn AND (e.next_rn IS NULL OR k.rn < e.next_rn)
GROUP BY e.click_id, e.rn, e.start_hour, e.next_batch, e.hash
"""
