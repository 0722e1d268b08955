"""What the operators of this subpackage share: the shared folder, written tables that cut lineage, Arrow helpers."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A missing doc_id takes part as this id: it sorts before every other.
NULL_ID = -(2**63)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset and Spark runs in this one process (``local[...]``) a folder under the warehouse is used, as Spark
    itself writes tables there; elsewhere that is an error, since a folder of the driver is not seen by executors.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = f"{spark.conf.get('spark.sql.warehouse.dir')}/shared"
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used, deleted when the session ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def cut(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here and lost executors cost no recomputation."""
    return written(df, name, codec)[0]


def written(df: DataFrame, name: str, codec: str = "zstd") -> tuple[DataFrame, str]:
    """As ``cut``, with the path, for what ``remove`` takes away before the session ends."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete written tables that nothing reads any more."""
    for path in paths:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def unused(columns: list[str], *names: str) -> list[str]:
    """``names``, each with as many underscores before it as make it differ from all ``columns``, whatever their case."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id's decimal text is a multiple of 5; labels of those rows are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def texts_of(column: pa.Array | pa.ChunkedArray) -> list[str]:
    """Python strings of a string column, null as empty."""
    return [x or "" for x in column.to_pylist()]


def utf8_of(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of a string column, null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def runs_by_size(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Cut rows 0..n into consecutive runs whose sizes sum to at most ``most``; a larger row has a run of its own."""
    start = total = 0
    for i, size in enumerate(sizes):
        if i > start and total + size > most:
            yield start, i
            start, total = i, 0
        total += size
    if sizes:
        yield start, len(sizes)


def slices(column: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows of a string column of at most ``most`` bytes, found without making Python strings of them."""
    return runs_by_size(pc.fill_null(pc.binary_length(column), 0).to_pylist(), most)


def splitmix(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of unsigned 64-bit integers (the finaliser of SplitMix64)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


# -- words of many texts at once ----------------------------------------------------------------------------------------

_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64, at least n of each."""
    if "up" not in _POWERS or len(_POWERS["up"]) < n:
        size = max(1 << 20, 1 << (n - 1).bit_length())
        inverse = pow(_BASE, -1, 1 << 64)
        for name, base in (("up", _BASE), ("down", inverse)):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            _POWERS[name] = np.multiply.accumulate(p)
    return _POWERS["up"], _POWERS["down"]


#: A 64-bit number for each byte value.
BYTE_VALUES = splitmix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def prefix_sums(b: np.ndarray) -> np.ndarray:
    """Sums for ``span_hash``: of the first i bytes' numbers, each times the base to its place."""
    out = np.zeros(len(b) + 1, dtype=np.uint64)
    np.cumsum(BYTE_VALUES[b] * powers(len(b) + 1)[0][: len(b)], out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes; equal bytes have equal hashes wherever they lie."""
    return splitmix((sums[end] - sums[start]) * powers(len(sums))[1][start] + (end - start).astype(np.uint64))


def word_spans(b: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes whose ``inside`` is true; ``b`` must end with a byte outside."""
    on = inside[b]
    edge = np.flatnonzero(on[1:] != on[:-1]) + 1
    if len(on) and on[0]:
        edge = np.concatenate([[0], edge])
    return edge[0::2], edge[1::2]


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The texts with a line feed after each, as one array, and the places where texts begin, with the end."""
    b = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    return b, np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]).astype(np.int64)
