"""Recorded answers against a plain client that asks again."""

import itertools
import json
import xml.etree.ElementTree as ET

from pyspark.sql import functions as F

from libraryloom.sources import lookups


def _requests(spark, cases):
    lines = [json.dumps({"key": str(n), "service": "s", "responses": list(r)}) for n, r in enumerate(cases)]
    return lookups.requests(spark.createDataFrame([(x,) for x in [*lines, "broken {", '{"key": "none"}']], "value string"))


def _client(responses, download, least, attempts, backoff):
    waited, last = 0.0, None
    for n, r in enumerate(responses[:attempts], 1):
        if n > 1:
            waited += backoff * 2 ** (n - 2)
        status, body = r.get("status"), r.get("body")
        last = (n, waited, status)
        if download:
            if status is None or status in lookups.DOWNLOAD_AGAIN:
                continue
            if status >= 400:
                return ("refused", *last, None)
            return ("good", *last, body) if len((body or "").encode()) >= least else ("small", *last, None)
        if status == 404:
            return ("missing", *last, None)
        if status == 200:
            try:
                json.loads(body or "")
                return ("good", *last, body)
            except ValueError:
                continue
        if status is not None and status != 429 and not 500 <= status < 600:
            return ("refused", *last, None)
    return ("failed", *last, None) if last else ("unanswered", 0, 0.0, None, None)


def test_attempts_and_waits(spark):
    kinds = [{"status": 200, "body": '{"a":1}'}, {"status": 200, "body": '{"a'}, {"status": 404}, {"status": 429}, {"status": 503}, {"status": 400}, {}, {"status": 200, "body": ""}, {"status": 408}]
    cases = [c for n in range(4) for c in itertools.product(kinds, repeat=n)][:: 3]
    asked = _requests(spark, cases).cache()
    for download, rows in ((False, lookups.searched(asked)), (True, lookups.downloaded(asked, 5, 2, 1.0))):
        got = {r.key: r for r in rows.collect()}
        assert len(got) == len(cases) + 1 and got["none"].outcome == "unanswered"
        for n, case in enumerate(cases):
            outcome, tries, waited, status, body = _client(case, download, 5, 2 if download else 3, 1.0 if download else 1.5)
            r = got[str(n)]
            assert (r.outcome, r.attempts, r.waited, r.body) == (outcome, tries, waited, body), case
            assert r.error == (f"status {'none' if status is None else status} after {tries}" if outcome in ("failed", "refused") else None)


def test_size_is_in_bytes(spark):
    rows = {r.key: (r.outcome, r.size) for r in lookups.downloaded(_requests(spark, [[{"status": 200, "body": "éé"}], [{"status": 200}]]), 4).collect()}
    assert (rows["0"], rows["1"]) == (("good", 4), ("small", 0))


def test_pace(spark):
    rows = spark.createDataFrame([(f"{n:03}", "hot" if n % 3 else "cold") for n in range(90)], "key string, service string")
    got = {(r.service, r.turn): (r.key, round(r.due, 6)) for r in lookups.paced(rows).collect()}
    for name in ("hot", "cold"):
        for turn, n in enumerate((n for n in range(90) if bool(n % 3) == (name == "hot")), 1):
            assert got[name, turn] == (f"{n:03}", round(0.4 * (turn - 1), 6))
    assert lookups.paced(rows.limit(0)).count() == 0


def test_atom_authors(spark):
    a = '<feed xmlns="http://www.w3.org/2005/Atom">'
    feeds = [
        f"{a}<entry><author><name> Ada Stone </name></author><author><name>Bo</name></author></entry><entry><author><name>Cy</name></author></entry></feed>",
        f"{a}<author><name>Of the feed</name></author><entry><title>x</title></entry></feed>", f"{a}<entry><author><name>Ada", "", "no feed", None, f"{a}</feed>",
        f"{a}<entry><author/><author><name>Ünï &#233; &lt;b&gt;</name></author></entry></feed>",
    ]

    def plain(x):
        try:
            return [n.text.strip() for n in ET.fromstring(x).findall(".//{*}entry/{*}author/{*}name") if n.text] or None
        except (ET.ParseError, TypeError):
            return None

    rows = spark.createDataFrame(list(enumerate(feeds)), "n int, feed string").select("n", lookups.atom_authors(F.col("feed")).alias("names")).collect()
    assert {r.n: r.names for r in rows} == {n: plain(x) for n, x in enumerate(feeds)}
