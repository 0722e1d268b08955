import json

from pyspark.sql import functions as F

from libraryloom.functions.text import ascii_fold
from libraryloom.sources import listings


def test_listings(spark, tmp_path):
    for folder in ("inbox", "failed", "staged"):
        (tmp_path / folder).mkdir()
    (tmp_path / "inbox" / "a.pdf").write_bytes(b"x" * 2048)
    (tmp_path / "failed" / "b.pdf").write_bytes(b"x")
    (tmp_path / "failed" / "b.pdf.log").write_text("y" * 5000)
    (tmp_path / "failed" / "c.pdf").write_bytes(b"x")
    (tmp_path / "staged" / "123e4567-e89b-12d3-a456-426614174000-d.pdf").write_bytes(b"x")
    (tmp_path / "staged" / "stray.pdf").write_bytes(b"x")
    at = lambda name: str(tmp_path / name)
    assert [r.size_text for r in listings.listing(spark, at("inbox")).collect()] == ["2.0 KB"]
    assert {r.name: len(r.log) for r in listings.quarantined(spark, at("failed")).collect()} == {"b.pdf": 4000, "c.pdf": 0}
    runs = spark.createDataFrame([(1, 0.5), (2, None), (21, 9.0)], "place int, cost_usd double")
    s = listings.status_payload(runs, listings.listing(spark, at("inbox")), listings.staged(spark, at("staged")), listings.quarantined(spark, at("failed")), listings.listing(spark, at("inbox"))).first()
    assert (s.recent_cost, s.inbox, s.in_flight, s.stray, s.failed, s.duplicate) == (0.5, 1, 1, 1, 2, 1)


def test_recorded_responses(spark, tmp_path):
    lines = [{"key": "a", "responses": [{"status": 503}, {"status": 200, "body": {"x": 1}}]}, {"key": "b", "responses": [{"status": 503}] * 4}, {"key": "c"}]
    (tmp_path / "r.jsonl").write_text("\n".join(map(json.dumps, lines)) + "\nbroken\n")
    rows = {r.key: (r.body, r.error) for r in listings.recorded_responses(spark, str(tmp_path / "r.jsonl"), 2).collect()}
    assert rows == {"a": ('{"x":1}', None), "b": (None, "status 503 after 2 attempts"), "c": (None, "no response")}


def test_ascii_fold(spark):
    assert spark.range(1).select(ascii_fold(F.lit("Ünïcode 日.pdf")).alias("x")).first().x == "Unicode _.pdf"
