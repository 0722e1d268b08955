"""op13 against a plain trie of whole texts, split and unsplit. ``test_queries`` holds the query against its SQL."""

import hashlib
import random
import re
import zlib

import pytest

from libraryloom.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def plain(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own.setdefault(c, []).append(((turn is not None, turn or 0), hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest(), role, text))
    own = {c: [(role, text) for _, _, role, text in sorted(turns)] for c, turns in own.items()}
    nodes = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = own.get(c - int(c % 20 if c >= 0 else -(-c % 20)), [])
        path = base[:h] + turns[h:]
        for d in range(len(path) + 1):
            nodes.setdefault(tuple(path[:d]), []).append((c, d == len(path)))
    out = []
    for prefix, members in nodes.items():
        under = {p: m for p, m in nodes.items() if p[: len(prefix)] == prefix}
        parents = {p[:-1] for p in under if p}
        saved = sum((len(m) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) for p, m in under.items() if p)
        ends = ",".join(map(str, sorted(c for c, end in members if end)))
        parent = min(c for c, _ in nodes[prefix[:-1]]) if prefix else None
        out.append((len(prefix), min(c for c, _ in members), parent, len(members), sum(len(p) == len(prefix) + 1 for p in under), sum(p not in parents for p in under), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def found(spark, rows, limit, schema=SCHEMA):
    columns = [c.split(" ")[0] for c in prefix_trie.NODES.split(", ")]
    return sorted([tuple(r[c] for c in columns) for r in prefix_trie.trie(spark.createDataFrame(rows, schema), limit).collect()], key=str)


def mixed(seed, n=120):
    rng = random.Random(seed)
    words = ["hi", "two words", "", None, " \t", "née ", "a b c"]
    rows = []
    for c in range(n):
        for t in range(rng.randrange(0, 7)):
            rows.append((c, t, rng.choice(["user", "system", None]) if t else "system", rng.choice(words) if t else rng.choice(["common", "common", f"own {c}"])))
    return rows


@pytest.mark.parametrize("limit", [1000, 5])
def test_against_plain_tries(spark, limit):
    rows = mixed(limit)
    rows += [(7, None, "user", "first"), (7, None, "user", "first"), (8, 1, "user", "tie"), (8, 1, "user", "tie b"), (None, 1, "user", "of nobody"), (-3, 0, "user", "below"), (-40, 0, "user", "below"), (2**60, 0, "user", "far " * 5000)]
    random.Random(1).shuffle(rows)
    assert found(spark, rows, limit) == plain(rows)


def test_one_common_conversation(spark, monkeypatch):
    """Equal conversations of many ids: chunks of ids are digested in order."""
    monkeypatch.setattr(prefix_trie, "CHUNK_BITS", 2)
    rows = [(c, t, "user", f"turn {t}") for c in range(300) for t in range(3)]
    assert found(spark, rows, 1000) == plain(rows)


def test_split_at_every_depth(spark):
    """A common beginning of several turns is partitioned anew turn by turn; joins are not broadcast beyond their bound."""
    rows = [(20 * c, t, "user", f"common {t}" if t < 3 else f"{c} {t}") for c in range(30) for t in range(3 + c % 3)]
    assert found(spark, rows, 3) == plain(rows)


def test_split_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BROADCAST_ROWS", 0)
    rows = mixed(9, 60)
    assert found(spark, rows, 4) == plain(rows)


def test_turnless_conversations_and_other_columns(spark):
    """A short conversation whose base is not there has no turn; columns whose names clash are not read."""
    h = {c: zlib.crc32(str(c).encode()) % 4 for c in range(1, 20)}
    rows = [(c, 0, "user", "only") for c in h]
    assert any(h.values())
    wide = [(*r, b"x", 1, "y") for r in rows]
    assert found(spark, wide, 1000, SCHEMA + ", path binary, level int, bucket string") == plain(rows)
    alone = [(next(c for c in h if h[c]), 0, "user", "only")]
    assert found(spark, alone, 1000) == plain(alone)


def test_empty_table(spark):
    assert prefix_trie.trie(spark.createDataFrame([], SCHEMA)).collect() == []
    assert prefix_trie.trie(spark.createDataFrame([(None, 1, "a", "b")], SCHEMA)).collect() == []
