"""Answers of services, recorded as JSON lines, read as a client that tries again would have taken them.

A line is a request: ``key``, ``service`` and ``responses``, each with ``status`` (none where the connection failed) and
``body``, in the order in which they would come. Spark splits the lines as it likes, so a service that most requests go to
is no hot partition: how long a client waits, and when it may ask at all, are columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from libraryloom.operators.order import ranked

REQUEST = "key string, service string, responses array<struct<status string, body string>>"
ATTEMPTS, BACKOFF, PACE = 3, 1.5, 0.4
#: Answers after which a download is tried again.
DOWNLOAD_AGAIN = (408, 429, 500, 502, 503, 504)


def requests(lines: DataFrame) -> DataFrame:
    """key, service and responses of ``lines`` (value); lines that can't be read are left out, a request without any stays."""
    rows = lines.filter(F.try_parse_json("value").isNotNull()).select(F.from_json("value", REQUEST).alias("r"))
    return rows.select("r.key", "r.service", F.coalesce("r.responses", F.array().cast("array<struct<status:string,body:string>>")).alias("responses"))


def _tried(asked: DataFrame, kind: Callable[[Column], Column], attempts: int, backoff: float) -> DataFrame:
    """``asked`` with the kind and the answer of the attempt that ended it, attempts, and seconds waited between them.

    ``kind`` says of an answer whether it is the last: any word but ``again`` ends the request. The n-th wait takes
    ``backoff`` * 2^(n-1) seconds; there is none after the last attempt.
    """
    c = F.col
    rows = asked.withColumn("_tries", F.slice("responses", 1, attempts)).withColumn("_kinds", F.transform("_tries", kind))
    first = F.array_position(F.transform("_kinds", lambda k: k != "again"), True)
    rows = rows.withColumn("attempts", F.when(first > 0, first.cast("int")).otherwise(F.size("_tries")))
    end = lambda name: F.when(c("attempts") > 0, F.get(name, c("attempts") - 1))
    waited = F.lit(backoff) * (F.pow(F.lit(2.0), F.greatest(c("attempts") - 1, F.lit(0))) - 1)
    return rows.withColumn("kind", F.coalesce(end("_kinds"), F.lit("unanswered"))).withColumn("answer", end("_tries")).withColumn("waited", waited).drop("_tries", "_kinds", "responses")


def _error(told: Column) -> Column:
    return F.when(told, F.concat(F.lit("status "), F.coalesce("answer.status", F.lit("none")), F.lit(" after "), F.col("attempts").cast("string")))


def searched(asked: DataFrame, attempts: int = ATTEMPTS, backoff: float = BACKOFF) -> DataFrame:
    """key, service, outcome, attempts, waited, body and error of ``requests`` to a service that answers in JSON.

    A failed connection, 429, 5xx and a body that is no whole JSON are passing troubles and tried again; 404 means that
    there is nothing (``missing``, no error); any other status ends the request at once (``refused``). Without a good answer
    the request ``failed``; a request for which nothing was recorded is ``unanswered``.
    """
    def kind(r: Column) -> Column:
        status = r["status"].try_cast("int")
        whole = F.when((status >= 200) & (status < 300), F.when(F.try_parse_json(r["body"]).isNotNull(), "good").otherwise("again"))
        passing = status.isNull() | (status == 429) | ((status >= 500) & (status < 600))
        return F.coalesce(whole, F.when(status == 404, "missing").when(passing, "again").otherwise("refused"))

    rows = _tried(asked, kind, attempts, backoff)
    outcome = F.when(F.col("kind") == "again", "failed").otherwise(F.col("kind"))
    return rows.select("key", "service", outcome.alias("outcome"), "attempts", "waited", F.when(F.col("kind") == "good", F.col("answer.body")).alias("body"), _error(outcome.isin("failed", "refused")).alias("error"))


def downloaded(asked: DataFrame, least: int = 1, attempts: int = ATTEMPTS, backoff: float = 1.0) -> DataFrame:
    """key, service, outcome, attempts, waited, size (bytes), body and error of ``requests`` for documents.

    What a server may mend is tried again (``DOWNLOAD_AGAIN`` and failed connections), other answers from 400 on are
    ``refused``. A body of fewer than ``least`` bytes is ``small``, which is no document: its size is told, its body is not. Where no body came the size is 0.
    """
    def kind(r: Column) -> Column:
        status = r["status"].try_cast("int")
        return F.when(status.isNull() | status.isin(*DOWNLOAD_AGAIN), "again").when(status >= 400, "refused").otherwise("good")

    came = F.col("kind") == "good"
    rows = _tried(asked, kind, attempts, backoff).withColumn("size", F.when(came, F.octet_length(F.coalesce("answer.body", F.lit("")))).otherwise(0))
    outcome = F.when(F.col("kind") == "again", "failed").when(came & (F.col("size") < least), "small").otherwise(F.col("kind"))
    return rows.select("key", "service", outcome.alias("outcome"), "attempts", "waited", F.col("size").cast("long").alias("size"), F.when(outcome == "good", F.col("answer.body")).alias("body"), _error(outcome.isin("failed", "refused")).alias("error"))


def paced(asked: DataFrame, gap: float = PACE) -> DataFrame:
    """``asked`` with turn and due: each service's requests in the order of their keys, ``gap`` seconds apart at least.

    ``due`` is in seconds from the start. Keys should differ; equal ones take turns in any order.
    """
    return ranked(asked, ["key"], "turn", ["service"]).withColumn("due", (F.col("turn") - 1) * F.lit(gap))


def atom_authors(feed: Column) -> Column:
    """Names of the authors of all entries of an Atom feed, in order; null where there are none or the feed can't be read."""
    read = F.from_xml(feed, "entry array<struct<author: array<struct<name: string>>>>", {"ignoreNamespace": "true"})
    people = F.flatten(F.transform(read["entry"], lambda e: F.coalesce(e["author"]["name"], F.array().cast("array<string>"))))
    found = F.filter(F.transform(people, lambda n: F.trim(n)), lambda n: F.coalesce(n, F.lit("")) != "")
    return F.when(F.size(found) > 0, found)
