"""Keyed state of the intake: claims and rows that wait, over batches, restarts and replays."""

import datetime as dt
import random


from libraryloom.streaming import keyed

FILES = "name string, modified timestamp, hash string, key string"


def plain(batches):
    """Files in order of batch, time and name; the first of a hash, then of an address, is what others match."""
    by_hash, by_key, out = {}, {}, {}
    for rows in batches:
        for _, name, h, key in sorted((m, n, h, k or "") for n, m, h, k in rows):
            first_h = by_hash.setdefault(h, name)
            first_k = by_key.setdefault(key, name) if key else name
            matched = first_h if first_h != name else first_k if first_k != name else None
            out[name] = ("duplicate" if matched else "new", matched)
    return out


def test_claims_over_batches(spark, tmp_path):
    """Outcomes are the same over all batches, a replay changes nothing, and a batch reads its own rows only."""
    rng = random.Random(3)
    at = dt.datetime(2024, 1, 1)
    session = keyed.sized(spark, 2)
    out, check, folder = str(tmp_path / "out"), str(tmp_path / "check"), tmp_path / "in"
    batches, read = [], []
    for b in range(4):
        rows = [(f"{b}-{k:02}", at + dt.timedelta(hours=b, seconds=rng.randrange(9)), rng.choice("abcdefghij") + rng.choice("xyz"), rng.choice([None, None, "u", "v", f"w{rng.randrange(9)}"])) for k in range(12)]
        batches.append(rows)
        session.createDataFrame(rows, FILES).coalesce(1).write.mode("append").parquet(f"{folder}")
        query = keyed.run(keyed.claims(session.readStream.schema(FILES).parquet(str(folder))), out, check)
        read.append(sum(p["numInputRows"] for p in query.recentProgress))
    assert {r.name: (r.outcome, r.matched) for r in spark.read.parquet(out).collect()} == plain(batches)
    assert read == [12] * 4
    keyed.run(keyed.claims(session.readStream.schema(FILES).parquet(str(folder))), out, check)  # nothing new
    again = keyed.run(keyed.claims(session.readStream.schema(FILES).parquet(str(folder))), str(tmp_path / "out2"), str(tmp_path / "check2"))
    assert again.exception() is None and spark.read.parquet(str(tmp_path / "out2")).count() == spark.read.parquet(out).count() == 48


def test_rows_wait_for_their_time(spark, tmp_path):
    """A file settles 5 seconds after it was written last, a check goes stale after 7 days; both come out once, at their time."""
    session = keyed.sized(spark, 2)
    out, check, folder = str(tmp_path / "out"), str(tmp_path / "check"), str(tmp_path / "in")
    start = dt.datetime(2024, 1, 1)
    second, day = dt.timedelta(seconds=1), dt.timedelta(days=1)
    session.createDataFrame([], "key string, due timestamp, payload string").write.parquet(folder)

    def pass_(now, rows=()):
        if rows:
            session.createDataFrame(list(rows), "key string, due timestamp, payload string").coalesce(1).write.mode("append").parquet(folder)
        keyed.pass_on(session.readStream.schema("key string, due timestamp, payload string").parquet(folder), now, out, check)
        return sorted(tuple(r) for r in spark.read.schema("key string, payload string").parquet(out).collect())

    first = pass_(start, [("old.pdf", start - second, "settled"), ("young.pdf", start + 4 * second, "one"), ("check/a", start + 7 * day, "looked up"), (None, start, "nobody's")])
    assert first == [("old.pdf", "settled")]
    assert pass_(start + 3 * second, [("young.pdf", start + 8 * second, "written again")]) == first
    second_ = pass_(start + 9 * second, [("check/a", start + 13 * day, "looked up anew")])
    assert second_ == [("old.pdf", "settled"), ("young.pdf", "written again")]
    assert pass_(start + 8 * day) == second_
    assert pass_(start + 14 * day) == [("check/a", "looked up anew"), *second_]


