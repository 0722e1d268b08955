"""The bounded sample of labelled texts that the classifiers of this subpackage are fitted on."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from libraryloom.llm.common import held_out, utf8_of

#: About this many labelled rows, at most, are fitted on: all of them where there are fewer, else those whose hashed id
#: falls under the share that gives this number.
FIT_ROWS = 8_000
#: Bytes of text that are fitted on, at most: rows are taken in the order of their hashed id, and one that does not fit
#: in is passed over.
FIT_BYTES = 64_000_000
PARTS = 1_000_000


def training_rows(spark: SparkSession, docs: DataFrame, labels: DataFrame, label: str, most: int = FIT_ROWS, room: int = FIT_BYTES) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Texts, labels and a number from 0 to 1 for each row, of labelled rows that are not held out.

    Rows are chosen by their id alone, in the same way at every size, and come in the order of their ids. Only the text
    and the label are used: the id only picks rows. Rows that repeat an id count once, by the text that sorts first under
    xxhash64; texts are taken whole, and what reaches the driver is bounded by ``most`` rows and ``room`` bytes.
    """
    known = labels.select(F.col("doc_id").alias("_id"), F.col(label).alias("_y")).filter(F.col("_id").isNotNull() & F.col("_y").isNotNull())
    known = known.filter(~held_out(F.col("_id"))).groupBy("_id").agg(F.max("_y").alias("_y"))
    n = known.count()
    place = F.pmod(F.xxhash64(F.lit("fit"), "_id"), F.lit(PARTS))
    if n > most:
        known = known.filter(place < PARTS * most // n)
    known = F.broadcast(known.withColumn("_p", place / PARTS))  # its size is bounded by ``most``
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", "text").join(known, F.col("doc_id") == F.col("_id"))
    rows = rows.select("_id", "_y", "_p", text.alias("text"), F.xxhash64(text).alias("_h"), F.octet_length(text).alias("_n"))
    sizes = rows.groupBy("_id").agg(F.min(F.struct("_h", "_n")).alias("x"), F.first("_p").alias("_p")).select("_id", "x._h", "x._n", "_p").toArrow().to_pylist()
    taken, left = [], room
    for row in sorted(sizes, key=lambda r: (r["_p"], r["_id"])):
        if row["_n"] <= left:
            left -= row["_n"]
            taken.append((row["_id"], row["_h"]))
    chosen = F.broadcast(spark.createDataFrame(taken, "_id long, _h long"))
    rows = rows.join(chosen, ["_id", "_h"]).groupBy("_id").agg(F.min("text").alias("text"), F.first("_y").alias("_y"), F.first("_p").alias("_p")).toArrow()
    texts = utf8_of(rows.column("text"))
    ids, y, p = (rows.column(c).to_numpy() for c in ("_id", "_y", "_p"))
    order = np.argsort(ids, kind="stable")
    return [texts[i] for i in order.tolist()], (y[order] > 0).astype(np.float64), p[order].astype(np.float64)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Adam:
    """The usual first-order optimiser over a list of arrays."""

    def __init__(self, arrays: list[np.ndarray], rate: float) -> None:
        self.arrays, self.rate, self.t = arrays, rate, 0
        self.m, self.v = [np.zeros_like(a) for a in arrays], [np.zeros_like(a) for a in arrays]

    def step(self, gradients: list[np.ndarray]) -> None:
        self.t += 1
        for a, g, m, v in zip(self.arrays, gradients, self.m, self.v, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            a -= self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.999**self.t)) + 1e-8)
