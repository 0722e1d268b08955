"""op11: the operators over arrays against the rules row by row, and the streaming query on odd tables.

``test_queries`` holds the whole query against its SQL.
"""

import datetime as dt
import hashlib
import random
import zlib

import numpy as np
import pandas as pd
import pytest

from libraryloom.llm import click_windows as cw


def by_the_rules(batches, window, lateness):
    """Windows of lists of (click_id, hour, hash), one list a batch, row by row."""
    open_at, out, latest = {}, [], None
    for b, rows in enumerate(batches):
        limit = None if b == 0 or latest is None else latest - lateness
        for click, hour, digest in sorted(rows):
            if limit is not None and hour < limit:
                continue
            held = open_at.get(click)
            if held and hour <= held["start"] + window:
                held["n"] += 1
                if digest != held["hash"]:
                    held["conflicts"] += 1
                    held["crc"] += zlib.crc32(digest.hex().encode())
                continue
            if held:
                out.append((click, held["start"], b, held["n"], held["conflicts"], held["crc"], held["hash"].hex()))
            open_at[click] = {"start": hour, "hash": digest, "n": 0, "conflicts": 0, "crc": 0}
        latest = max([x for x in [latest, *[h for _, h, _ in rows]] if x is not None], default=None)
        for click, held in list(open_at.items()):
            if b == len(batches) - 1 or (latest is not None and held["start"] + window < latest - lateness):
                out.append((click, held["start"], b, held["n"], held["conflicts"], held["crc"], held["hash"].hex()))
                del open_at[click]
    return sorted(out)


def by_the_operators(batches, window, lateness):
    held, counters, out, latest = (b"", b"", b""), (b"",), [], None
    for b, rows in enumerate(batches):
        late = cw.NO_LIMIT if latest is None else latest - lateness
        latest = max([x for x in [latest, *[h for _, h, _ in rows]] if x is not None], default=None)
        expired = cw.ALL_HOURS if b == len(batches) - 1 else cw.NO_LIMIT if latest is None else latest - lateness
        counted = pd.Series(rows).value_counts() if rows else {}
        fed = [(c, h, d, n, zlib.crc32(d.hex().encode()), 0, 0, 0, b) for (c, h, d), n in counted.items()] + [(0, 0, b"", 0, 0, late, expired, 1, b)]
        random.Random(b).shuffle(fed)
        frame = pd.DataFrame(fed, columns=["click_id", "hour", "hash", "n", "crc", "late", "expired", "control", "batch"])
        held, sent = cw.tag_rows(3, frame, held, window)
        counters, closed = cw.count_windows(pd.concat(sent, ignore_index=True), counters)
        for frame in closed:
            out += [(int(r.click_id), int(r.start_hour), int(r.closed_batch), int(r.n_repeats), int(r.n_conflicts), int(r.conflict_crc), r.hash.hex()) for r in frame.itertuples()]
    assert held == (b"", b"", b"") and counters == (b"",)
    return sorted(out)


@pytest.mark.parametrize("seed", range(40))
def test_operators_follow_the_rules(seed):
    rng = random.Random(seed)
    hashes = [hashlib.sha256(bytes([k])).digest() for k in range(4)]
    ids = [rng.choice([-5, 0, 7, 2**62, 9, 10]) for _ in range(rng.choice([1, 3, 6]))]
    batches = [[(rng.choice(ids), 40 * b + rng.randrange(-80, 120), rng.choice(hashes)) for _ in range(rng.choice([0, 1, 30, 120]))] for b in range(rng.randrange(1, 7))]
    window, lateness = rng.choice([(24, 96), (0, 0), (5, 30), (24, 10)])
    assert by_the_operators(batches, window, lateness) == by_the_rules(batches, window, lateness)


def test_hashes_that_end_in_zero_bytes_stay_whole():
    tail = b"\1" * 30 + b"\0\0"
    batches = [[(1, 5, tail), (1, 6, tail), (1, 7, b"\1" * 30 + b"\0\1")], [(1, 8, tail)]]
    assert by_the_operators(batches, 24, 96) == by_the_rules(batches, 24, 96)


def test_openers_take_many_windows_of_an_id_in_order():
    hours = np.arange(0, 1000, dtype=np.int64)
    opens = cw.openers(np.zeros(1000, dtype=np.int64), hours, np.array([cw.NO_LIMIT]), 24)
    assert np.flatnonzero(opens).tolist() == list(range(0, 1000, 25))


def test_micros_do_not_follow_the_session_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    naive = spark.createDataFrame([(dt.datetime(2024, 3, 31, 2, 30, 0, 5),), (None,), (dt.datetime(1969, 12, 31, 23, 59, 59, 999999),)], "t timestamp_ntz")
    try:
        for name in ("UTC", "Europe/Berlin"):
            spark.conf.set("spark.sql.session.timeZone", name)
            assert [r[0] for r in naive.select(cw.utc_micros(naive, "t")).collect()] == [1711852200000005, None, -1]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


CLICKS = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, value double, props string, batch string, hour int"


def test_odd_rows(spark):
    """Nulls in every column, repeated rows, ids of both signs, columns whose names clash; against the rules."""
    at = dt.datetime(2024, 1, 1)
    rng = random.Random(2)
    rows = [(rng.choice([3, 4, 5, -7]), at, at + dt.timedelta(hours=rng.randrange(900)), 1, "a|b", 1.005, "{}", "x", 1) for _ in range(60)]
    rows += [(None, at, at, 1, "k", 1.0, "", "x", 1), (6, at, None, 1, "k", 1.0, "", "x", 1), (8, None, at, None, None, None, None, None, None), (8, None, at, None, None, None, None, None, None), (8, None, at, None, None, float("nan"), "", "", 0)]
    rows += [(11, at, at, 1, "k", 1.0, "", "x", 1)] * 500
    copies = cw.copies(spark.createDataFrame(rows, CLICKS), 3).cache()
    found = cw.windows(spark, copies, 3)
    batches = [[], [], []]
    for r in copies.collect():
        batches[r.batch].append((r.click_id, r.hour, bytes(r.hash)))
    copies.unpersist()
    got = sorted((r.click_id, r.start_hour, r.closed_batch, r.n_repeats, r.n_conflicts, r.conflict_crc, bytes(r.hash).hex()) for r in found.collect())
    assert got == by_the_rules(batches, cw.WINDOW, cw.LATENESS)
    assert sum(1 + r[3] for r in got) <= sum(map(len, batches))


def test_empty_table(spark):
    assert cw.windows(spark, cw.copies(spark.createDataFrame([], CLICKS)), 1).collect() == []


def test_stores_are_closed_when_their_task_ends(spark):
    """No executor holds the stores of all partitions, nor those of a run before."""
    stores = spark._jvm.java.lang.Class.forName("org.apache.spark.sql.execution.streaming.state.StateStore$")
    held = stores.getDeclaredField("loadedProviders")
    held.setAccessible(True)
    loaded = lambda: held.get(stores.getField("MODULE$").get(None)).size()
    before = loaded()
    found = cw.windows(spark, cw.copies(spark.createDataFrame([(1, None, dt.datetime(2024, 1, 1), 1, "k", 1.0, "", "x", 1)], CLICKS), 1), 1)
    assert loaded() <= before
    assert found.count() == 1
