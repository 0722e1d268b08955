"""The registered queries over whole small tables: those with SQL against DuckDB, the others against plain versions."""

import glob
import hashlib
import os
import struct

import duckdb
import pytest
from tokenizers import Tokenizer

from libraryloom.llm import queries


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(name, spark, sf, duck):
    ours, theirs = queries.QUERIES[name](spark, sf), duck.sql(queries.ORACLE_SQL[name])
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    place = [theirs.columns.index(c) for c in columns]
    assert sorted(tuple(map(str, r)) for r in ours.select(*columns).collect()) == sorted(tuple(str(r[k]) for k in place) for r in theirs.fetchall())


@pytest.fixture(scope="module")
def texts(spark, sf):
    return {r.doc_id: r.text or "" for r in queries.table(spark, sf, "documents").collect()}


@pytest.fixture(scope="module")
def tokens(texts):
    tokenizer = Tokenizer.from_file(queries.tokenizer_file())
    return {i: tokenizer.encode(t, add_special_tokens=False).ids for i, t in texts.items()}


def test_bpe(spark, sf, texts, tokens):
    sha = lambda ids: hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
    rows = queries.op10_bpe(spark, sf).collect()
    assert sorted((r.doc_id, r.n_tokens, r.ids_sha256) for r in rows) == sorted((i, len(x), sha(x)) for i, x in tokens.items())


def test_packing(spark, sf, tokens):
    rows = queries.op1_best_fit_packing(spark, sf).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length) for r in rows) == sorted((i, k, 2048 * k, min(2048, len(x) + 1 - 2048 * k)) for i, x in tokens.items() for k in range(-(-(len(x) + 1) // 2048)))
    fill = {}
    for r in rows:
        fill.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for placed in fill.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(fill) <= -(-sum(len(x) + 1 for x in tokens.values()) // 2048) * 1.02 + 1


def test_repeats(spark, sf, texts):
    from tests.llm.test_operators import repeats_brute

    rows = queries.op7_suffix_dedup(spark, sf).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows) == repeats_brute(list(texts.items()))
