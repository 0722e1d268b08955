"""Tests for the findings of the fourth round that led to a change."""

import re

import numpy as np

from libraryloom.functions import bounds
from libraryloom.operators import intake, matching


def test_texts_that_end_alike_are_neighbours(spark):
    left = spark.createDataFrame([("zzzz123456",)], "text string")
    right = spark.createDataFrame([("p123456",), ("p223456",), ("large ring",)], "text string")
    assert {r.other for r in matching.neighbours(left, right).collect()} == {"p123456", "p223456"}


def test_runs_of_unlike_letters_stay_closed(monkeypatch):
    looked_at = []
    plain = bounds.within_reach
    monkeypatch.setattr(bounds, "within_reach", lambda a, b, *more: looked_at.append(b) or plain(a, b, *more))
    others = [f"large ring {k}" for k in range(1000, 3000)] + ["zzzz12 copy"]
    found = [(int(p), int(q)) for x, y in bounds.near_pairs(["zzzz12345"], np.array([0.7]), others) for p, q in zip(x, y, strict=True)]
    assert len(looked_at) <= 1 and all(q == 2000 for _, q in found)


def test_copies_of_texts_in_blocks_do_not_follow_the_number_of_pairs():
    for n, m in ((120_000, 960_000), (1_200_000, 2_400_000)):
        rows, columns = matching._blocks(n, m, 24)
        assert n <= rows * matching.BLOCK and m <= columns * matching.BLOCK and n * columns + m * rows <= 40 * (n + m)


def test_random_texts_meet_under_few_segments(spark):
    some = spark.sql("SELECT sha2(cast(id AS string), 256) AS text, 0.9D AS least FROM range(400)")
    others = spark.sql("SELECT sha2(concat('x', id), 256) AS other FROM range(400) UNION SELECT concat(left(sha2('7', 256), 61), 'zzz')")
    near = matching._by_segments(some, others, 0.9).collect()
    assert any(r.other.endswith("zzz") for r in near) and len(near) < 40


def test_signatures_differ_in_no_more_bits_than_letters_without_match():
    texts = ["large ring 1234", "large ring 1243", "large rng 1234 x", "", "é" * 70, "a" * 90]
    found = bounds.signatures(texts)
    for i, a in enumerate(texts):
        for j, b in enumerate(texts):
            common = max((len(x) for x in _subsequences(a) & _subsequences(b)), default=0) if max(len(a), len(b)) < 17 else None
            if common is not None:
                assert bin(int(found[i]) ^ int(found[j])).count("1") <= len(a) + len(b) - 2 * common


def _subsequences(text: str) -> set[str]:
    out = {""}
    for letter in text:
        out |= {x + letter for x in out}
    return out


def test_a_library_is_not_sent_whole_to_all_tasks(spark):
    inputs = spark.sql("SELECT concat('i', id, '.pdf') AS name, 'h' AS hash, '' AS url, concat('zzzz', id) AS stem, '' AS meta_title, '' AS first_page FROM range(4)")
    library = spark.sql("SELECT concat('a/p', id) AS rel_path, concat('p', id) AS slug, '' AS title, '' AS url, '' AS preprint_url, '' AS source_hash, cast(null AS string) AS original_kind FROM range(50)")
    plan = intake.decide(inputs, library)._jdf.queryExecution().executedPlan().toString()
    assert not re.findall(r"BroadcastHashJoin \[(?:hash|key|name|rel_path|text|other)#", plan)  # a few kinds of lengths may be sent
