"""op12 against the tiktoken library, with the odd cases of texts and tables."""

import hashlib
import random

import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from libraryloom.llm import byte_bpe, queries


@pytest.fixture(scope="module")
def tree():
    with open(queries.rank_file(), "rb") as f:
        return byte_bpe.TreeEncoder(f.read(), queries.rank_pattern())


@pytest.fixture(scope="module")
def library(tree):
    return tiktoken.Encoding("own", pat_str=queries.rank_pattern(), mergeable_ranks=tree.rank, special_tokens={})


ODD = ["", " ", "\n\n  x", "don't WE'LL 'tis '' '", "日本語 ½ Ⅷ 𝔘 😀😀", "a\x1cb\x85c\xa0d᠎e　f", "\x00a\x00", "﻿hi​there", "a" * 1001, " " * 999 + "x", "=" * 700, "ab" * 500, "<|endoftext|>", "é é"]


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(tree, library, text):
    assert tree.encode(text) == library.encode_ordinary(text)
    assert tree.decode(tree.encode(text)) == text.encode()


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("aAbe 1\n'!=é日\t " + "st"), max_size=80))
def test_random_texts(tree, library, text):
    assert tree.encode(text) == library.encode_ordinary(text)


def test_every_code_point_is_split_alike(tree, library):
    for start in range(0, 0x110000, 64):
        text = "".join(f"a{chr(c)}1{chr(c)}!{chr(c)} {chr(c)}" for c in range(start, start + 64) if not 0xD800 <= c < 0xE000)
        assert tree.encode(text) == library.encode_ordinary(text)


def test_joins_of_any_halves(tree):
    """Joining is the same wherever a piece is cut, and grouping of joins does not matter."""
    rng = random.Random(5)
    for _ in range(400):
        piece = bytes(rng.choice(b"aabehinorst\xc3\xa9") for _ in range(rng.randrange(3, 60)))
        i, j = sorted(rng.sample(range(1, len(piece)), 2))
        a, b, c = (tree.merged(x) for x in (piece[:i], piece[i:j], piece[j:]))
        assert tree.join(tree.join(a, b), c) == tree.join(a, tree.join(b, c)) == tree.merged(piece) == tree.reduced(piece)


def test_joins_whose_window_grows_to_the_end(tree):
    for n in range(2, 300):
        left, right = tree.merged(b"a" * n), tree.merged(b"a" * 257)
        assert tree.join(left, right) == tree.merged(b"a" * (n + 257))


def test_text_trees_cut_only_where_matches_end(tree, library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "cut_places", lambda text: list(CUTS(text, 12)))
    rng = random.Random(6)
    for _ in range(400):
        text = "".join(rng.choice(["ab", " ", "  ", "\n", "'s", "12", "!", "é"]) for _ in range(60))
        assert tree.encode(text) == library.encode_ordinary(text)


CUTS = byte_bpe.cut_places


@pytest.mark.parametrize("most", [1, 7, 1000])
def test_cut_places(most):
    for text in ("", "x" * 50, "a b  c\n\nd " * 9, " " * 40):
        ends = byte_bpe.cut_places(text, most)
        assert ends[-1] == len(text) and ends == sorted(ends)
        assert all(text[e].isspace() and not text[e - 1].isspace() for e in ends[:-1])


def test_memory_of_pieces_is_bounded(tree, library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "MEMO", 50)
    text = " ".join(f"w{i * 7919 % 100003}q" for i in range(3000))
    assert tree.encode(text) == library.encode_ordinary(text)
    assert tree.encode(text) == library.encode_ordinary(text)
    assert len(tree.pairs) <= 50 and len(tree.fragments) <= 50


def test_incomplete_rank_file():
    with pytest.raises(ValueError):
        byte_bpe.read_ranks(b"YQ== 0\n")


ROWS = [(1, "two words"), (2, None), (3, ""), (None, "no id"), (5, "again"), (5, "again"), (6, "long text, " * 20_000), (7, "x" * 20_000)]


def test_query_on_odd_rows(spark, tree, library):
    docs = spark.createDataFrame([(i, t, "clash", k) for k, (i, t) in enumerate(ROWS)], "doc_id long, text string, ids string, n_tokens int")
    sha = lambda raw: hashlib.sha256(raw).hexdigest()
    truth = [(i, len(ids := library.encode_ordinary(t or "")), sha(",".join(map(str, ids)).encode()), sha((t or "").encode())) for i, t in ROWS]
    digests = byte_bpe.roundtrip_digests(spark, docs, queries.rank_file(), queries.rank_pattern())
    assert sorted(map(tuple, digests.collect()), key=str) == sorted(truth, key=str)
    encoded = byte_bpe.encode_documents(spark, docs, queries.rank_file(), queries.rank_pattern())
    assert encoded.columns == ["doc_id", "text", "n_tokens", "ids"]
    decoded = byte_bpe.decode_documents(spark, encoded, queries.rank_file())
    rows = decoded.select("doc_id", "ids", "decoded", byte_bpe.ids_digest(decoded.ids).alias("sha"), "text").collect()
    assert sorted([(r.doc_id, len(r.ids), r.sha, sha(bytes(r.decoded))) for r in rows], key=str) == sorted(truth, key=str)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert byte_bpe.roundtrip_digests(spark, docs, queries.rank_file(), queries.rank_pattern()).collect() == []
    assert byte_bpe.encode_documents(spark, docs, queries.rank_file(), queries.rank_pattern()).collect() == []


def test_whole_table(spark, sf, library):
    rows = queries.op12_byte_bpe(spark, sf).collect()
    texts = [(r.doc_id, r.text or "") for r in queries.table(spark, sf, "documents").collect()]
    truth = [(i, hashlib.sha256(",".join(map(str, library.encode_ordinary(t))).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for i, t in texts]
    assert sorted((r.doc_id, r.ids_sha256, r.decoded_sha256) for r in rows) == sorted(truth)
