"""The pipeline, stage by stage, on a small table with planted cases."""

import random

import corpus_pipeline


def test_stages(spark, tmp_path):
    rng = random.Random(11)
    w = lambda n: " ".join(f"u{rng.randrange(10**6)}" for _ in range(n))
    clean = [w(80) for _ in range(20)]
    passage = w(60)
    rows = [(i, t) for i, t in enumerate(clean)]
    rows += [(100 + i, "you idiot scum moron " + w(40)) for i in range(15)]
    rows += [(200, clean[0]), (201, clean[1].replace(" ", "  ")), (300, clean[2] + " one more"), (400, w(30) + " " + passage), (401, w(30) + " " + passage), (500, None), (500, None), (None, "free of an id")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    labels = [(i, 1, 0) for i in range(20)] + [(100 + i, 1, 1) for i in range(15)]
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept.append(sorted(-1 if r.doc_id is None else r.doc_id for r in docs.select("doc_id").collect()))
    others = [*range(20)]
    assert kept[0] == sorted([*others, 200, 201, 300, 400, 401, 500, 500, -1])
    assert kept[1] == sorted([*others[:1], *others[2:], 201, 300, 400, 401, 500, -1])
    assert kept[2] == sorted([*others[:1], *others[2:], 201, 400, 401, 500, -1])
    assert kept[3] == kept[2]
    text = {r.doc_id: r.text for r in docs.collect()}
    assert passage[:200] in text[400] and passage[100:200] not in text[401] and text[3] == clean[3]
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted({-1 if r.doc_id is None else r.doc_id for r in packed}) == kept[3]


def test_run_by_hand(spark, tmp_path):
    """The whole pipeline against its stages written out: what is kept, what is left of it, and where its pieces lie."""
    import hashlib
    import zlib

    import numpy as np
    from tokenizers import Tokenizer

    from libraryloom.llm import toxicity
    from libraryloom.llm.queries import tokenizer_file
    from tests.llm.test_operators import exact_brute, near_brute, repeats_brute

    rng = random.Random(23)
    w = lambda n: " ".join(f"v{rng.randrange(10**5)}" for _ in range(n))
    base = [w(rng.randrange(30, 120)) for _ in range(30)]
    passage = w(50)
    rows = list(enumerate(base))
    for t in base[:12]:
        near = t.split()
        near[len(near) // 2] = "changed"
        rows += [(len(rows), t.replace(" ", "\n", 2)), (len(rows) + 1, " ".join(near)), (len(rows) + 2, w(25) + " " + passage + " " + w(9))]
    toxic = [(500 + i, "you idiot scum moron " + w(30)) for i in range(25)]
    rows += [*toxic, (900, None), (901, ""), (902, "tiny"), (903, "é" * 400)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame([(i, 1, int(i >= 500)) for i, _ in rows if i < 25 or 500 <= i < 525], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")

    scores = {r.doc_id: r.predicted for r in toxicity.score_documents(spark, docs, labels).collect()}
    left = [(i, t or "") for i, t in rows if not scores[i]]
    assert not {i for i, _ in left} & {i for i, _ in toxic} and len(left) == len(rows) - len(toxic)
    kept = {keep for _, keep, _, _ in exact_brute(left)}
    left = [(i, t) for i, t in left if i in kept]
    left = [(i, t) for i, t in left if (i, i) in {(a, c) for a, _, c in near_brute(left)}]
    sha = {i: s for i, _, _, _, s in repeats_brute(left)}
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == {i for i, _ in left} == set(sha)

    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
    text = {r.doc_id: r.text for r in docs.collect()}
    assert {i: hashlib.sha256(t.encode()).hexdigest() for i, t in text.items() if t.isascii()} == {i: s for i, s in sha.items() if text[i].isascii()}
    tokenizer = Tokenizer.from_file(tokenizer_file())
    want = []
    for i, t in text.items():
        ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 0], dtype="<u4")
        want += [(i, k, len(ids[at : at + 2048]), zlib.crc32(ids[at : at + 2048].tobytes())) for k, at in enumerate(range(0, len(ids), 2048))]
    assert sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in packed) == sorted(want)
