"""The library's operators on a small invented tree."""

import collections
import datetime
import difflib
import json
import os
import random
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from libraryloom.functions import front, identifiers, measures, names, similarity, text, urls
from libraryloom.operators import intake, lifecycle, matching, mirror, preprints, records
from libraryloom.sources import listings, versions
from libraryloom.sources import records as source
from libraryloom.streaming import inbox, memo, tail

DAY = "2024-06-01"


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def record(root: Path, category: str, slug: str, lines: str, pdf: bytes | None = b"%PDF"):
    folder = root / category / slug
    folder.mkdir(parents=True)
    (folder / f"{slug}.summary.md").write_text(f"---\n{lines}---\nBody of {slug}.\n")
    if pdf is not None:
        (folder / f"{slug}.pdf").write_bytes(pdf)


GOOD = "title: {t}\nauthors:\n  - \"Stone, Ada\"\nsource_type: paper\npublication: Journal of Tides\ndate: 2024-05\nurl: https://Example.org/a/?utm_source=x\nretrieved: 2024-05-02\ncurrency_check: 2024-05-02\nsnapshot: false\ncategory: {c}\ntldr: Short | words\nstatus: active\nsuperseded_by:\n"


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    root = tmp_path_factory.mktemp("library")
    record(root, "tides", "moon", GOOD.format(t="Moon and tides", c="tides"))
    record(root, "tides", "old", GOOD.format(t="An older look", c="tides").replace("status: active", "status:").replace("superseded_by:", "superseded_by: moon").replace("2024-05\n", "2021\n"))
    record(root, "rocks", "bad", "title: 1984\nauthors: [\"Ann Lee\"]\nsource_type: essay\ndate: soon\ncategory: tides\ntldr: x\n", pdf=None)
    record(root, "rocks", "arx", "title: Deep learning of rock shapes\nauthors:\n  - \"Hill, Bo\"\nsource_type: preprint\nurl: https://arxiv.org/abs/2401.01234v2\ndate: 2024\ncategory: rocks\ntldr: y\n", pdf=None)
    record(root, "rocks", "broken", "title: [unclosed\n")
    record(root, "_hidden", "no", GOOD.format(t="Hidden", c="_hidden"))
    return str(root)


@pytest.fixture(scope="module")
def library(spark, root):
    return source.scan_library(spark, root).cache()


def test_scan(library):
    rows = {r.rel_path: r for r in library.collect()}
    assert set(rows) == {"tides/moon/moon.summary.md", "tides/old/old.summary.md", "rocks/bad/bad.summary.md", "rocks/arx/arx.summary.md", "rocks/broken/broken.summary.md"}
    assert rows["rocks/broken/broken.summary.md"].corrupt
    assert rows["rocks/bad/bad.summary.md"].title == "1984" and rows["rocks/bad/bad.summary.md"].original_kind is None
    assert rows["tides/moon/moon.summary.md"].original_kind == "pdf" and rows["tides/moon/moon.summary.md"].authors == ["Stone, Ada"]


def test_index_and_audit(spark, library):
    lines = [r.line for r in records.index_lines(library, ("tides",), spark.createDataFrame([("tides",), ("empty",)], "category string")).orderBy("place").collect()]
    assert lines[:6] == ["# Source Index", "", "## tides", "", "| Title | Tl;dr | Author(s) | Year |", "|-------|-------|-----------|------|"]
    assert lines[6] == "| [Moon and tides](tides/moon/moon.summary.md) | Short \\| words | Stone | 2024 |" and " · *superseded → moon* |" in lines[7] and lines[8:10] == ["", "## rocks"] and lines[-4:] == ["## empty", "", "*No sources yet.*", ""]
    links = spark.createDataFrame([("tides/moon/moon.summary.md",), ("gone/x/x.summary.md",)], "rel_path string")
    found = {(r.rel_path, r.issue) for r in records.audit(library, links).collect()}
    assert ("gone/x/x.summary.md", "orphan-link") in found and ("tides/old/old.summary.md", "unindexed") in found and ("rocks/broken/broken.summary.md", "corrupt") in found and ("rocks/bad/bad.summary.md", "missing-original") in found
    assert [r.slug for r in records.search(library, " MOON and ").collect()] == ["moon"]


def test_index_of_nothing(library):
    assert [r.line for r in records.index_lines(library.filter("false")).collect()] == ["# Source Index", "", "*No sources yet.*"]


def test_validation(library):
    rows = {r.rel_path.split("/")[1]: r for r in records.validated(library, DAY).collect()}
    assert rows["moon"].valid and rows["moon"].notes == []
    assert rows["old"].status == "superseded" and rows["old"].valid
    assert rows["moon"].snapshot == "false" and rows["bad"].source_type == "article" and set(rows["bad"].errors) == {"bad date", "category is not the folder", "author not as Last, First"}
    assert rows["arx"].source_type == "paper" and rows["arx"].retrieved == DAY


def test_backfills(library):
    assert {r.rel_path for r in records.backfilled_hashes(library).collect()} == {"tides/moon/moon.summary.md", "tides/old/old.summary.md", "rocks/broken/broken.summary.md"}
    assert records.backfilled_authors(library).count() == 0


def test_delete_guard(spark, library):
    asked = spark.createDataFrame([("tides/moon/moon.summary.md",), ("../x/y.summary.md",), ("_hidden/no/no.summary.md",), ("tides/nope/nope.summary.md",)], "rel_path string")
    assert [r.rel_path for r in records.deletable(library, asked).collect()] == ["tides/moon/moon.summary.md"]


def test_intake(spark, library):
    moon = library.filter("slug = 'moon'").withColumn("source_hash", F.lit("h1"))
    lib = library.filter("slug <> 'moon'").unionByName(moon)
    inputs = spark.createDataFrame(
        [("a.pdf", "h1", None, "a", None, None), ("b.txt", "h2", "https://example.org/a", "b", None, None), ("2401.01234.pdf", "h3", None, "2401.01234", None, None), ("new.pdf", "h4", None, "nothing like it", None, None)],
        "name string, hash string, url string, stem string, meta_title string, first_page string",
    )
    got = {r.name: (r.rel_path, r.reason) for r in intake.decide(inputs, lib).collect()}
    assert got["a.pdf"] == ("tides/moon/moon.summary.md", "hash") and got["b.txt"] == ("tides/moon/moon.summary.md", "url")
    assert got["2401.01234.pdf"] == ("rocks/arx/arx.summary.md", "backfill:fuzzy") and got["new.pdf"] == (None, None)


WORK = "rel_path string, error string, works array<struct<title:string,display_name:string,doi:string,authorships:array<struct<author:struct<display_name:string>>>,locations:array<struct<landing_page_url:string,is_published:boolean,version:string,source:struct<type:string,display_name:string>>>>>"


def hit(title, author, locations, doi=None):
    return (title, None, doi, [((author,),)] if author else [], locations)


def test_preprints(spark, library):
    found = preprints.preprints(library)
    assert [(r.rel_path, r.preprint_venue, r.preprint_id) for r in found.collect()] == [("rocks/arx/arx.summary.md", "arXiv", "2401.01234")]
    arxiv = ("https://arxiv.org/abs/2401.01234", False, "submittedVersion", ("repository", "arXiv"))
    journal = ("https://doi.org/10.1234/Rocks.7", True, "publishedVersion", ("journal", "Rock Letters"))
    other = hit("Deep learning of rock shapes", "Bo Else", [journal])
    own = hit("Deep learning of rock shape", "Bo Hill", [arxiv, journal], "https://doi.org/10.48550/arXiv.2401.01234")
    answer = lambda works, error=None: spark.createDataFrame([("rocks/arx/arx.summary.md", error, works)], WORK)
    r = preprints.checked(found, answer([other, own]), "2024-06-01T00:00:00Z").first()
    assert (r.status, r.publication, r.published_doi, r.confidence) == ("published", "Rock Letters", "10.1234/rocks.7", "high")
    assert preprints.checked(found, answer([other]), DAY).first().status == "unknown"
    assert preprints.checked(found, answer([hit("Deep learning of rock shapes", "Hill", [arxiv])]), DAY).first().status == "preprint-only"
    assert preprints.checked(found, answer([], "timeout"), DAY).first().status == "error"
    new = preprints.checked(found, answer([own]), "2024-06-01T00:00:00Z")
    assert [r.fresh for r in preprints.due(found, new, "2024-06-05").collect()] == [True] and [r.fresh for r in preprints.due(found, new, "2024-06-08").collect()] == [False]
    old = new.withColumn("rel_path", F.lit("gone/g/g.summary.md"))
    assert [r.rel_path for r in preprints.refreshed(old, new, found).collect()] == ["rocks/arx/arx.summary.md"]
    assert {r.status: r.n for r in preprints.buckets(found, old).collect()} == {"unchecked": 1}


def test_promotions(spark):
    entries = spark.createDataFrame([("a", "Shapes of rocks in rivers", "Shapes of rocks in rivers", "https://doi.org/10.1/x", "", "10.1234/abc"), ("b", "Tides of small lakes", "Tides of small lakes", "https://x.org/b", "", "")], "rel_path string, title string, published_title string, published_url string, doi string, published_doi string")
    pdfs = spark.createDataFrame(
        [("doi.pdf", "https://doi.org/10.1234/ABC.", "Shapes of rocks in rivers", 9, "", []), ("title.pdf", "", "Tides of Small Lakes.", 9, "", []), ("veto.pdf", "10.1234/abc", "Entirely different matter here", 9, "", []), ("vol.pdf", "", "", 80, "Proceedings of the Lake Days: Tides of small lakes p. 3", ["Shapes of rocks in river"])],
        "name string, doi string, title string, pages int, front string, outline array<string>",
    )
    got = {(r.name, r.rel_path, r.verdict) for r in intake.promotions(pdfs, entries).collect()}
    assert got == {("doi.pdf", "a", "promote"), ("title.pdf", "b", "promote"), ("vol.pdf", "b", "volume-contains"), ("vol.pdf", "a", "volume-contains")}


def test_retirement(spark, library):
    refs = spark.createDataFrame([(1, "tides/old", "Old 2021", ["3.1"]), (2, "tides/moon", "Moon 2024", [])], "place int, key string, short_cite string, cited_in array<string>")
    none = spark.createDataFrame([], "key string")
    sections = spark.createDataFrame([("s3.md", "tides/old")], "file string, key string")
    r = lifecycle.retirement_reports(library, refs, sections, none).collect()
    assert [(x.key, x.verdict, x.short_cite, x.files, x.successor_cite) for x in r] == [("tides--old", "review-citations", "Old 2021", ["s3.md"], "Moon 2024")]
    assert lifecycle.retirement_reports(library, refs, sections, spark.createDataFrame([("tides--old",)], "key string")).count() == 0


def test_cards(spark):
    signals = spark.createDataFrame([("triage_proposed", "r1"), ("triage_stale", "r1"), ("synthesis_drift", "derived/g.md"), *[("unaudited_sources", f"s{i:02}") for i in range(11)]], "signal string, entry string")
    digest = spark.createDataFrame([(2, 0, 1, 1, None)], "flagged int, landed int, added int, dismissed int, error string")
    backups = spark.createDataFrame([("ok", 40.0, 0, 0, None, None, None)], "outcome string, age_hours double, uncommitted int, unpushed int, sync_outcome string, sync_age_hours double, error string")
    gate = spark.createDataFrame([("docs/12-b.md", False), ("docs/3-a.md", False), ("c.md", True), ("derived/g.md", False)], "file string, done boolean")
    rows = lifecycle.cards(signals, digest, backups, gate, DAY).collect()
    by = {r.key: r for r in rows}
    assert len(rows) == 13 and rows[0].key == "backup-digest" and by["backup-digest"].severity == "bad" and by["backup-library"].severity == "ok"
    assert by["triage"].entries == ["r1 · over 14 days"] and by["drift-guides"]["count"] == "1" and by["drift-sections"].severity == "ok"
    assert by["backup-digest"]["count"] == "40.0h" and by["digest-flags"]["count"] == "2" and by["recalibrate"]["count"] == "1/1"
    assert len(by["unaudited"].entries) == 11 and by["gate-c"].entries == ["derived/g.md", "docs/12-b.md", "docs/3-a.md"] and by["gate-c"]["count"] == "1/4"
    many = lifecycle.cards(signals, digest, backups, spark.createDataFrame([(f"s{k}", False) for k in range(10)], "file string, done boolean"), DAY)
    assert many.filter("key = 'gate-c'").first().entries[-1] == "…and 2 more"
    lost = lifecycle.cards(signals, spark.createDataFrame([(None, None, None, None, "unreachable")], "flagged int, landed int, added int, dismissed int, error string"), backups, gate, DAY)
    assert {r.key: (r.severity, r["count"], r.error) for r in lost.collect() if r.key in ("digest-flags", "recalibrate")} == {"digest-flags": ("warn", "—", "unreachable")}
    broken = lifecycle.cards(spark.createDataFrame([("error", "no repo")], "signal string, entry string"), digest, backups, gate, DAY)
    assert {r.key: r.error for r in broken.collect()}["health"] == "no repo" and broken.filter("key = 'triage'").count() == 0
    assert lifecycle.attention(lifecycle.cards(signals, digest, backups, gate, DAY)).first().urgent == 1


def test_rhythm_and_changelog(spark):
    tasks = spark.createDataFrame([("a", "weekly", "2024-05-25"), ("b", "weekly", "2024-05-24"), ("c", "monthly", None), ("d", "event", "2000-01-01")], "task string, cadence string, last string")
    assert {r.task: r.due for r in lifecycle.rhythm(tasks, DAY).collect()} == {"a": False, "b": True, "c": False, "d": False}
    entries = spark.createDataFrame([(datetime.datetime(2024, 5, 1), 1, "one"), (datetime.datetime(2024, 5, 2), 2, "two"), (datetime.datetime(2024, 5, 2), 3, "three")], "at timestamp, seq int, text string")
    assert [r.line for r in lifecycle.changelog(entries).orderBy("place").collect()] == ["## 2024-05-02 (latest)", "- three", "- two", "## 2024-05-01", "- one"]
    ran = spark.createDataFrame([("x", "result", 0.0, 2.0, 5), ("x", "result", 1.0, None, 5), ("y", "result", None, None, None)], "input_name string, type string, total_cost_usd double, cost_usd double, duration_ms long")
    assert {r.input_name: r.cost_usd for r in lifecycle.run_summary(ran).collect()} == {"x": 3.0, "y": None}


def test_mirror_and_streaks(spark):
    side = lambda rows: spark.createDataFrame(rows, "path string, hash string")
    plan = {r.path: (r.change, r.remove) for r in mirror.mirror_plan(side([("a", "1"), ("b", "2")]), side([("a", "0"), ("c", "3")]), 1).collect()}
    assert plan == {"a": ("changed", False), "b": ("new", False), "c": ("deleted", True)}
    runs = spark.createDataFrame([(1, True), (2, False), (3, False), (4, True)], "run_at int, ok boolean")
    assert [(r.last_success, r.consecutive_failures) for r in mirror.sync_history(runs).orderBy("run_at").collect()] == [(1, 0), (1, 1), (1, 2), (4, 0)]
    paths = spark.createDataFrame([("c1", "triage/a.md"), ("c2", "triage/README.md")], "commit string, path string")
    assert not mirror.may_push(paths).first().may_push and mirror.may_push(paths.filter("commit = 'c1'")).first().may_push


def test_sources(spark, tmp_path):
    (tmp_path / "runs.jsonl").write_text('{"ts":"1","input_name":"a","outcome":"success"}\nnot json\n{"ts":"2","input_name":"b","outcome":"failure","cost_usd":0.5}\n')
    assert [r.input_name for r in source.read_runs(spark, str(tmp_path / "runs.jsonl"), 1).collect()] == ["b"]
    (tmp_path / "cache.json").write_text(json.dumps({"x/y": {"title": "T", "status": "published", "match_score": 0.9}}))
    assert source.read_checks(spark, str(tmp_path / "cache.json")).first().status == "published"
    (tmp_path / "refs.md").write_text("# Refs\n### Moon 2024\n**Library path:** `library/tides/moon/`\n**Cited in:** Sections 3.1, A.2, 7 and Z\n### None\n### Moon 2025\n**Library path:** `library/tides/moon`\n**Cited in:** B\n")
    r = source.read_references(spark, str(tmp_path / "refs.md")).orderBy("place").collect()
    assert [tuple(x) for x in r] == [(1, "tides/moon", "Moon 2025", ["B"])]
    assert value(spark, text.section_ids(F.lit("Sections 3.1, A.2, 7 and Z"))) == ["3.1", "A.2", "7"]
    lines = [json.dumps({"type": "meta", "kind": "start", "input": "a"}), "junk", json.dumps({"type": "assistant", "message": {"content": [{"type": "text", "text": "hi"}, {"type": "tool_use", "name": "Bash", "input": {"command": "ls\nx"}}, {"type": "tool_use", "name": "Odd", "input": {"p": "1", "q": "2", "r": "3"}}]}}), json.dumps({"type": "user"}), json.dumps({"type": "result", "subtype": "success", "duration_ms": 1500, "total_cost_usd": 0.25})]
    got = [(r.line, r.text) for r in source.events(spark.createDataFrame(list(enumerate(lines)), "line int, value string")).collect()]
    assert got == [(0, "started: a"), (1, "junk"), (2, "hi"), (2, "ls"), (2, "Odd(p, q)"), (4, "success (1.5s, $0.250)")]
    notes = [("m", "---\nstatus: candidate-for-intake\nsources:\n  - https://arxiv.org/pdf/2401.00001\n  - {slug: My Slug, url: 'https://x.org/a'}\n  - {url: ftp://x}\n  - https://x.org/\n---\n"), ("n", "---\nstatus: other\n---\n"), ("bad", "---\n[\n---\n"), ("empty", None)]
    got = [tuple(r) for r in source.candidate_targets(spark.createDataFrame(notes, "name string, body string")).collect()]
    assert got == [("m", 1, "arxiv-2401.00001", "https://arxiv.org/pdf/2401.00001"), ("m", 2, "my-slug", "https://x.org/a"), ("m", 4, "candidate-4", "https://x.org/")]


@pytest.mark.parametrize(
    "given, want",
    [(" HTTP://Ex.ORG/A/?b=1&utm_x=2&&a=3#f ", "http://ex.org/A?b=1&a=3"), ("mailto:X@y", "mailto:X@y"), ("https://e.org", "https://e.org"), ("https://e.org/?fbclid=1", "https://e.org"), ("https://e.org/a//?", "https://e.org/a"), ("https://e.org/a?x=1&UTM_Source=y&FBclid=2", "https://e.org/a?x=1")],
)
def test_canonical_url(spark, given, want):
    assert value(spark, urls.canonical_url(F.lit(given))) == want


def test_functions(spark):
    assert value(spark, text.normalize_title(F.lit("  Ünder the-Sea 2!"))) == "nder the sea 2"
    assert value(spark, text.first_title_line(F.lit("short\nProceedings of the Lake Days\nA fine title of things"))) == "A fine title of things"
    assert value(spark, identifiers.normalize_doi(F.lit("https://doi.org/10.1234/AbC?x=1."))) == "10.1234/abc"
    assert value(spark, identifiers.arxiv_id(F.lit("http://arxiv.org/pdf/cs.CL/0101001"))) == "cs.CL/0101001"
    for name, org in [("Stone, Ada", False), ("GAO", True), ("U.S. Office of Tides", True), ("Journal of Tides Office", False), ("One Two Three Four", True), ("", False), (None, False)]:
        assert value(spark, names.is_institution(F.lit(name).cast("string"))) == org, name
    assert value(spark, names.byline(F.array(*[F.lit(f"L{i}, F") for i in range(5)]))) == "L0, L1, L2, L3 et al."
    assert value(spark, names.looks_like_person(F.lit("Ann van Lee"))) and not value(spark, names.looks_like_person(F.lit("Lee, Ann"))) and not value(spark, names.looks_like_person(F.lit("Rock Institute")))
    assert value(spark, names.last_name(F.lit(""))) == ""
    assert value(spark, measures.size_text(F.lit(1536))) == "1.5 KB" and value(spark, measures.status(F.lit(None).cast("string"), F.lit("~"))) == "active"
    assert value(spark, similarity.title_similarity(F.lit("tide"), F.lit("diet"))) == 0.25 and value(spark, similarity.title_similarity(F.lit("diet"), F.lit("tide"))) == 0.5
    scored = spark.createDataFrame([("q", "a", 0.95), ("q", "b", 0.85), ("r", "a", 0.95), ("r", "b", 0.80), ("s", "a", 0.69)], "name string, rel string, score double")
    assert {r.name: r.accepted for r in matching.best_with_margin(scored, ["name"], "rel", "score", 0.7, 0.15).collect()} == {"q": False, "r": True, "s": False}


def test_stream(spark, tmp_path):
    folder, state, check = tmp_path / "in", str(tmp_path / "state"), str(tmp_path / "check")
    folder.mkdir()
    (folder / "a.pdf").write_bytes(b"one")
    (folder / "l.txt").write_text("see https://Ex.org/a/ .")
    assert inbox.drain(spark, str(folder), state, check) == 1
    (folder / "b.pdf").write_bytes(b"one")
    (folder / "m.url").write_text("https://ex.org/a?utm_source=z")
    (folder / "c.pdf").write_bytes(b"two")
    assert inbox.drain(spark, str(folder), state, check) == 1
    assert inbox.drain(spark, str(folder), state, check) == 0
    got = {r.name: (r.outcome, r.matched) for r in inbox.claimed(spark, state).collect()}
    assert got == {"a.pdf": ("new", None), "l.txt": ("new", None), "b.pdf": ("duplicate", "a.pdf"), "m.url": ("duplicate", "l.txt"), "c.pdf": ("new", None)}


def test_provenance_and_promoted_urls(spark, library):
    files = spark.createDataFrame([("a",), ("b",)], "name string")
    recorded = spark.createDataFrame([("a", "digest:item/7"), ("z", "manual")], "name string, discovered_via string")
    assert {r.name: r.discovered_via for r in intake.with_provenance(files, recorded).collect()} == {"a": "digest:item/7", "b": "manual"}
    assert [r.name for r in intake.unconsumed(recorded, files).collect()] == ["z"]
    for given, want in [("https://doi.org/10.1/x", "https://doi.org/10.1/x"), ("https://www.arxiv.org/abs/1", "old"), ("ftp://x", "old"), (None, "old")]:
        assert value(spark, intake.promoted_url(F.lit(given).cast("string"), F.lit("old"))) == want
    assert intake.produced_since(library, "2000-01-01").count() == 5 and intake.produced_since(library, "2999-01-01").count() == 0
    moved = intake.outcome_names(spark.createDataFrame([("a.b.pdf",), ("a.b.pdf",), ("new",)], "name string"), spark.createDataFrame([("a.b.pdf",)], "name string"))
    assert sorted(r.target for r in moved.collect()) == ["a.b.1.pdf", "a.b.2.pdf", "new"]


def test_outcome_names_never_meet(spark):
    one = intake.outcome_names(spark.createDataFrame([("a.txt",)], "name string"), spark.createDataFrame([("a.txt",), ("a.1.txt",)], "name string"))
    assert [r.target for r in one.collect()] == ["a.2.txt"]
    rng = random.Random(3)
    names_ = ["a.txt", "a.1.txt", "a.2.txt", "a.1.1.txt", "a", "a.1", "b.md", "b.10.md", ".x", "a.01.txt", "a.3"]
    for _ in range(6):
        moved, taken = [rng.choice(names_) for _ in range(25)], rng.sample(names_, 5)
        out = intake.outcome_names(spark.createDataFrame([(n,) for n in moved], "name string"), spark.createDataFrame([(n,) for n in taken], "name string")).collect()
        targets = [r.target for r in out]
        assert sorted(r.name for r in out) == sorted(moved) and len(set(targets)) == len(targets) and not set(targets) & set(taken)
        assert all(r.target == r.name or re.fullmatch(re.escape(re.match(r"^(.*?)(\.[^.]*)?$", r.name)[1]) + r"\.[1-9][0-9]*" + re.escape(re.match(r"^(.*?)(\.[^.]*)?$", r.name)[2] or ""), r.target) for r in out)
        assert {n for n in moved if n not in taken} <= set(targets)


def plain_fuzzy(f, r):
    """The score of a file (stem, meta, page) and a record (slug, title, url), written out."""
    norm = lambda x: re.sub("[^a-z0-9]+", " ", (x or "").lower()).strip()
    ratio = lambda a, b: difflib.SequenceMatcher(None, a, b).ratio()
    name, meta, page, slug, title = norm(f[0]), norm(f[1]), norm(f[2]), norm(r[0]), norm(r[1])
    m = re.search("arxiv\\.org/abs/([0-9.]+)", r[2] or "")
    if m and m[1] in f[0]:
        return 0.95
    best = 0.0
    for x in (slug, title):
        if x:
            best = max(best, ratio(name, x))
            if name and (x in name or name in x):
                best = max(best, 0.85)
    if meta and title:
        best = max(best, ratio(meta, title), 0.9 if meta in title or title in meta else 0)
    if page and title and title in page:
        best = max(best, 0.9)
    year = re.search("\\b(?:19|20)[0-9]{2}\\b", slug)
    return min(1.0, best + (0.1 if year and year[0] in name else 0))


def test_fuzzy_backfill_by_hand(spark):
    rng = random.Random(9)
    words = "moon tide rock river stone small deep old lake shape".split()
    title = lambda: " ".join(rng.choice(words) for _ in range(rng.randrange(2, 6)))
    records_ = [(f"c/r{k}/r{k}.summary.md", rng.choice([title().replace(" ", "-") + "-2019", f"r{k}"]), title(), f"https://arxiv.org/abs/2401.{k:05}" if k % 3 == 0 else "") for k in range(25)]
    files_ = [(f"f{k}.pdf", rng.choice([title(), "2401.00003 copy", records_[k % 25][2] + " 2019", "x"]), rng.choice(["", title()]), rng.choice(["", "front " + title()])) for k in range(30)]
    lib = spark.createDataFrame([(p, s, t, u, None, None, None) for p, s, t, u in records_], "rel_path string, slug string, title string, url string, preprint_url string, source_hash string, original_kind string")
    inputs = spark.createDataFrame([(n, "", "", a, b, c) for n, a, b, c in files_], "name string, hash string, url string, stem string, meta_title string, first_page string")
    got = {r.name: r.rel_path for r in intake.decide(inputs, lib).collect()}
    want = {}
    for n, *f in files_:
        ranked = sorted(((-plain_fuzzy(f, r[1:]), r[0]) for r in records_))
        first, second = -ranked[0][0], -ranked[1][0]
        want[n] = ranked[0][1] if first >= 0.7 and round(first - second, 9) >= 0.15 else None
    assert got == want and sum(x is not None for x in got.values()) > 3


def test_containing_by_hand(spark):
    rng = random.Random(5)
    text_ = lambda n: " ".join(rng.choice("ab bc cd de ef a b".split()) for _ in range(n))
    wholes = [(k, text_(rng.randrange(0, 30))) for k in range(40)] + [(40, None), (41, "")]
    parts = [(k, rng.choice(wholes[:40])[1][rng.randrange(9) :][: rng.randrange(25)]) for k in range(40)] + [(40, None), (41, ""), (42, "b c d"), (43, "ab  bc cd")]
    got = matching.containing(spark.createDataFrame(parts, "part_id int, part string"), spark.createDataFrame(wholes, "whole_id int, whole string")).collect()
    want = {(i, j) for i, p in parts for j, w in wholes if p and w is not None and p in w}  # an empty part is looked for nowhere
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_similarity_by_hand(spark):
    rng = random.Random(1)
    pairs = [("".join(rng.choice("abc ") for _ in range(rng.randrange(12))), "".join(rng.choice("abc ") for _ in range(rng.randrange(12)))) for _ in range(200)]
    df = spark.createDataFrame(pairs, "a string, b string")
    a, b = F.col("a"), F.col("b")
    common = F.size(F.array_intersect(similarity.letters(a), similarity.letters(b)))
    x, y = similarity.letter_bits(similarity.letters(a)), similarity.letter_bits(similarity.letters(b))
    bits = similarity.common_letters([x["masks"][k] for k in range(3)], x["rest"], [y["masks"][k] for k in range(3)], y["rest"])
    for r in df.select("a", "b", similarity.similarity(a, b).alias("s"), common.alias("common"), bits.alias("bits")).collect():
        assert r.common <= r.bits <= min(len(r.a), len(r.b))
        assert r.common == sum((collections.Counter(r.a) & collections.Counter(r.b)).values())
        assert r.s == difflib.SequenceMatcher(None, r.a, r.b).ratio() and r.s * (len(r.a) + len(r.b)) <= 2 * r.common + 1e-9


@pytest.mark.parametrize("floor", [0.45, 0.75, 0.9])
def test_similar_texts_miss_no_pair(spark, floor):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("aeiorstnlz 12") for _ in range(rng.randrange(1, 14)))
    some = [word() for _ in range(60)]
    left = [(t, rng.choice([floor, min(1.0, floor + 0.1)])) for t in [*some, "", "", *some[:5]]]
    right = [*[t[:5] + word()[:2] + t[5:] for t in some], *some[30:], "", None, some[0]]
    got = matching.similar_texts(spark.createDataFrame(left, "text string, least double"), spark.createDataFrame([(t,) for t in right], "text string"), floor).collect()
    pairs = {tuple(r) for r in got}
    assert len(pairs) == len(got)
    least = {t: min(x for u, x in left if u == t) for t, _ in left}
    for t in least:
        for u in set(right) - {None}:
            if t and u and difflib.SequenceMatcher(None, t, u).ratio() >= least[t]:
                assert (t, u) in pairs
    assert all(2 * similarity.common_subsequence([t], [u])[0] >= least[t] * (len(t) + len(u)) - 1e-9 for t, u in pairs)


def test_common_subsequence_bounds_the_ratio():
    rng = random.Random(12)
    word = lambda n: "".join(rng.choice("abcdé 12") for _ in range(rng.randrange(n)))

    def plain(x, y):
        row = [0] * (len(y) + 1)
        for i in x:
            new = [0]
            for j, k in enumerate(y):
                new.append(row[j] + 1 if i == k else max(row[j + 1], new[j]))
            row = new
        return row[-1]

    pairs = [(word(20), word(20)) for _ in range(300)] + [("a" * 64, "a" * 64), ("ab" * 32, "b" * 90), ("", "a"), ("x" * 70, "x" * 80)]
    got = similarity.common_subsequence([p[0] for p in pairs], [p[1] for p in pairs])
    for (x, y), n in zip(pairs, got, strict=True):
        assert difflib.SequenceMatcher(None, x, y).ratio() * (len(x) + len(y)) <= 2 * n + 1e-9
        assert n == plain(x, y)


def test_front_matter_writers(spark):
    body = "---\ntitle: T\nurl: https://arxiv.org/abs/1\ntldr: x $1 \\\\ y\nsuperseded_by:\nauthors: []\n---\nsource_hash: in the text\nurl: z\n"
    at = lambda c: value(spark, c)
    b = F.lit(body)
    hashed = at(front.with_hash(b, F.lit("h1")))
    assert hashed == body.replace("y\nsuper", 'y\nsource_hash: "h1"\nsuper', 1)
    assert at(front.with_hash(F.lit(hashed), F.lit("h2"))) == hashed and at(front.with_hash(F.lit(hashed), F.lit("h2"), True)) == hashed.replace('"h1"', '"h2"')
    assert at(front.with_origin(b, F.lit('digest:"item/7'))) == body.replace("superseded_by:\n", 'superseded_by:\ndiscovered_via: "digest:item/7"\n', 1)
    assert at(front.with_urls(b, F.lit("https://doi.org/1"), F.lit("https://arxiv.org/abs/1"))) == body.replace("url: https://arxiv.org/abs/1\n", 'url: "https://doi.org/1"\npreprint_url: "https://arxiv.org/abs/1"\n', 1)
    assert at(front.with_urls(b, F.lit(""), F.lit("https://arxiv.org/abs/1/"))) == body
    assert at(front.with_author(b, F.lit("OECD"))) == body.replace("authors: []\n", 'authors:\n  - "OECD"\n', 1)
    listed = body.replace("authors: []", "authors:\n  - Ann")
    assert at(front.with_author(F.lit(listed), F.lit("OECD"))) == listed
    assert at(front.with_hash(F.lit("no block"), F.lit("h"))) == "no block" and at(front.has(b, "source_hash")) is False


def test_versions_and_logs(spark, tmp_path):
    root = str(tmp_path / "cache")
    assert versions.current(spark, root) is None
    for n in (1, 2, 3):
        versions.publish(spark.range(n), root)
        assert versions.current(spark, root).count() == n
    (tmp_path / "cache" / "current").unlink()  # a switch cut short
    assert versions.current(spark, root).count() == 2
    log = str(tmp_path / "runs")
    run = lambda ts, name, error=None: spark.createDataFrame([(ts, name, "success", ["/lib/a/b", "/else"], error, 0.5, 3)], source.RUN)
    source.append_runs(run("2024-01-01", "a", "x" * 2500), log)
    source.append_runs(run("2024-01-02", "b").union(run("2024-01-02", "c")).coalesce(1), log)
    rows = source.read_runs(spark, log, 20, "/lib").collect()
    assert [(r.place, r.input_name) for r in rows] == [(1, "c"), (2, "b"), (3, "a")] and rows[0].output_paths == ["a/b", "/else"] and len(rows[2].error_excerpt) == 2000
    files_ = spark.createDataFrame([("a", 3), ("b", 4)], "name string, size long")
    assert [r.archive for r in source.rotated(files_, 6).collect()] == [True, True] and [r.archive for r in source.rotated(files_, 7).collect()] == [False, False]
    none = spark.createDataFrame([], "x int")
    s = listings.status_payload(source.read_runs(spark, log), none, spark.createDataFrame([], "in_flight boolean"), none, none).first()
    assert (s.recent_cost, s.runs, s.inbox) == (1.5, 3, 0)


def test_status_and_health_files(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"outcome": "ok", "last_success": "2024-06-01T00:00:00Z", "consecutive_failures": 0}, indent=1))
    (tmp_path / "bad.json").write_text("{")
    r = lifecycle.backup_age(source.read_status(spark, str(tmp_path / "s.json")), "2024-06-02T12:05:59").first()
    assert (r.outcome, r.age_hours, r.stale, r.error) == ("ok", 36.1, True, None)
    r = lifecycle.backup_age(source.read_status(spark, str(tmp_path / "bad.json")), "2024-06-02").first()
    assert (r.outcome, r.age_hours, r.stale, r.error) == ("unreadable", None, True, "unreadable status file")
    (tmp_path / "h.json").write_text(json.dumps({"synthesis_drift": [{"file": "derived/a.md"}], "triage_stale": ["t1"], "unaudited_sources": [], "other": 3}))
    assert {tuple(x) for x in source.read_signals(spark, str(tmp_path / "h.json")).collect()} == {("synthesis_drift", "derived/a.md"), ("triage_stale", "t1")}
    assert [tuple(x) for x in source.read_signals(spark, str(tmp_path / "bad.json")).collect()] == [("error", "unreadable health report")]


def test_sections_and_heads(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "s1.md").write_text("---\nsources_used:\n  - library_path: \"library/tides/moon/\"\n  - library_path: library/rocks/x\n---\n- library_path: not/this\n")
    (tmp_path / "a" / "s2.draft.md").write_text("---\nsources_used:\n  - library_path: tides/old\n---\n")
    (tmp_path / "s3.md").write_text("no block\n")
    assert sorted(map(tuple, source.read_sections(spark, str(tmp_path)).collect())) == [("s1.md", "rocks/x"), ("s1.md", "tides/moon")]
    long = "---\ntitle: " + "x" * 100 + "\n---\nbody"
    for window in (10, 1000):
        assert value(spark, source.front_matter_head(F.lit(long), window)) == "title: " + "x" * 100 + "\n"
    assert value(spark, source.front_matter_head(F.lit("text"), 10)) is None


def test_remembered_results(spark):
    calls = []
    cards = memo.Remembered(lambda: calls.append(1) or spark.range(len(calls)), 600)
    assert [cards.get(at).count() for at in (0, 599, 600, 700)] == [1, 1, 2, 2] and cards.get(701, force=True).count() == 3


def test_lone_candidates(spark):
    items = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(v).alias("v")) for n, v in (("a", 1), ("b", 3), ("c", 3))])
    best = value(spark, matching.stable_argmax(items, lambda x: x["v"]))
    assert best.score == 3 and best["item"].name == "b"
    assert [r.name for r in lifecycle.expired(spark.createDataFrame([(f"r{k:03}",) for k in range(53)], "name string")).orderBy("name").collect()] == ["r000", "r001", "r002"]


def test_stream_takes_what_has_settled(spark, tmp_path):
    folder, state, check = tmp_path / "in", str(tmp_path / "state"), str(tmp_path / "check")
    folder.mkdir()
    put = lambda name, content, at: ((folder / name).write_bytes(content), os.utime(folder / name, (at, at)))
    day = 1_700_000_000
    clock = lambda s: datetime.datetime.fromtimestamp(day + s, datetime.UTC).strftime("%Y-%m-%d %H:%M:%S")
    names_ = lambda: sorted((r.name, r.outcome) for r in inbox.claimed(spark, state).collect())
    put("old.pdf", b"one", day - 100)
    put("young.pdf", b"two", day - 1)
    assert inbox.drain(spark, str(folder), state, check, clock(0)) == 1 and names_() == [("old.pdf", "new")]
    assert inbox.drain(spark, str(folder), state, check, clock(2)) == 0 and names_() == [("old.pdf", "new")]
    for _ in range(2):  # no new file comes, and what has settled is taken once
        assert inbox.drain(spark, str(folder), state, check, clock(3600)) == 0
        assert names_() == [("old.pdf", "new"), ("young.pdf", "new")]
    put("copy.pdf", b"two", day + 3600)
    put("late.pdf", b"three", day + 7199)
    assert inbox.drain(spark, str(folder), state, check, clock(7200)) == 1
    assert names_() == [("copy.pdf", "duplicate"), ("old.pdf", "new"), ("young.pdf", "new")]
    assert inbox.drain(spark, str(folder), state, check, clock(9000)) == 0
    assert names_() == [("copy.pdf", "duplicate"), ("late.pdf", "new"), ("old.pdf", "new"), ("young.pdf", "new")]


def test_log_tail(spark, tmp_path):
    folder, state, check = tmp_path / "log", str(tmp_path / "state"), str(tmp_path / "check")
    folder.mkdir()
    (folder / "1.log").write_text('{"type": "meta", "kind": "start", "input": "a"}\none\n\ntwo\n')
    tail.drain_log(spark, str(folder), state, check, 3)
    assert [r.text for r in tail.served(spark, state).collect()] == ["started: a", "one", "two"]
    (folder / "2.log").write_text("three\nfour\n")
    tail.drain_log(spark, str(folder), state, check, 3)
    assert [(r.seq, r.text) for r in tail.served(spark, state).collect()] == [(3, "two"), (4, "three"), (5, "four")]
    tail.drain_log(spark, str(folder), state, check, 3)
    assert [r.text for r in tail.served(spark, state, 2).collect()] == ["three", "four"]


def test_log_that_grows_and_is_begun_anew(spark, tmp_path):
    folder, state, check = tmp_path / "log", str(tmp_path / "state"), str(tmp_path / "check")
    folder.mkdir()
    log = folder / "run.log"

    def served():
        tail.drain_log(spark, f"file://{folder}", state, check, 5)
        return [r.text for r in tail.served(spark, state).collect()]

    log.write_bytes(b"one\ntwo\nhal")
    assert served() == ["one", "two"]
    assert served() == ["one", "two"]  # nothing new
    with log.open("ab") as f:
        f.write(b"f \xc3\xa9 \xff\nthree\nfo")
    assert served() == ["one", "two", "half é \ufffd", "three"]
    log.write_bytes(b"A\n")  # shorter: a new run
    assert served() == ["A"]
    with log.open("ab") as f:
        f.write(b"B\n" + b"C\n" * 3)
    assert served() == ["A", "B", "C", "C", "C"]
    log.write_bytes(b"other\n" + b"lines\n" * 9)  # longer than before, but another beginning
    assert served() == ["lines"] * 5
    assert [r.seq for r in tail.served(spark, state).collect()] == [10, 11, 12, 13, 14]


def test_growing_files_in_pieces(spark, tmp_path, monkeypatch):
    """Lines of any length are read once, wherever pieces, steps and chunks end; a restart repeats and loses nothing."""
    from libraryloom.streaming import growing

    rng = random.Random(4)
    path = tmp_path / "a.log"
    text = b"".join(b"x" * rng.randrange(12) + b"\n" for _ in range(300)) + b"tail"
    path.write_bytes(text)
    for piece, step, chunk in ((7, 3, 5), (1, 1, 1), (64, 10, 1000)):
        for name, n in (("PIECE", piece), ("STEP", step), ("CHUNK", chunk)):
            monkeypatch.setattr(growing, name, n)
        reader = growing.GrowingFilesReader(str(tmp_path))
        start, end = reader.initialOffset(), reader.latestOffset()
        rows = [r for p in reader.partitions(start, end) for b in reader.read(p) for r in b.to_pylist()]
        assert [r["value"].encode() for r in rows] == text.split(b"\n")[:-1] and not any(r["reset"] for r in rows)
        assert [r["at"] for r in rows] == [0, *[i + 1 for i, c in enumerate(text) if c == 10][:-1]]
        assert reader.partitions(end, end) == []


def test_growing_files_restart_from_their_checkpoint(spark, tmp_path):
    from libraryloom.streaming import growing

    growing.register(spark)
    folder, out, check = tmp_path / "log", str(tmp_path / "out"), str(tmp_path / "check")
    folder.mkdir()
    text = ""
    for k in range(3):
        text += f"line {k}\n"
        (folder / "a.log").write_text(text)
        (folder / f"b{k}.log").write_text(f"own {k}\n")
        spark.readStream.format("growing_files").load(str(folder)).writeStream.format("parquet").option("checkpointLocation", check).option("path", out).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.value for r in spark.read.parquet(out).collect()) == [*[f"line {k}" for k in range(3)], *[f"own {k}" for k in range(3)]]


@pytest.mark.parametrize("given", ["a$1b", "?q=$b", "back\\slash \\1", "${x}", "$$"])
def test_front_matter_values_of_any_characters(spark, given):
    body = "---\ntitle: T\nurl: https://arxiv.org/abs/1\ntldr: y\nauthors: []\n---\nurl: z\n"
    kept = given.replace("\\", "")
    got = value(spark, front.with_urls(F.lit(body), F.lit(f"https://x.org/{given}"), F.lit(f"https://y.org/{given}")))
    assert got == body.replace("url: https://arxiv.org/abs/1\n", f'url: "https://x.org/{kept}"\npreprint_url: "https://y.org/{kept}"\n', 1)
    assert value(spark, front.with_hash(F.lit(body), F.lit(given))) == body.replace("tldr: y\n", f'tldr: y\nsource_hash: "{kept}"\n', 1)
    assert value(spark, front.with_author(F.lit(body), F.lit(given))) == body.replace("authors: []\n", f'authors:\n  - "{kept}"\n', 1)
    assert value(spark, front.with_origin(F.lit(body), F.lit(given))) == body.replace("authors: []\n", f'authors: []\ndiscovered_via: "{kept}"\n', 1)
    assert value(spark, front.set_line(F.lit("---\n---\nx"), "a", F.lit(f"a: {given}"))) == f"---\na: {given}\n---\nx"


def test_names_are_never_taken_in_any_reading(spark):
    frame = lambda rows: spark.createDataFrame([(n,) for n in rows], "name string")
    assert [r.target for r in intake.outcome_names(frame(["a.1"]), frame(["a.1", "a.1.1"])).collect()] == ["a.2.1"]
    assert [r.target for r in intake.outcome_names(frame(["a"]), frame(["a", "a.1"])).collect()] == ["a.2"]
    rng = random.Random(8)
    pool = ["a", "a.1", "a.2", "a.1.1", "a.1.2", "a.2.1", "a.txt", "a.1.txt", ".x", ".1.x", "a."]
    for _ in range(3):
        moved, taken = sorted(rng.choice(pool) for _ in range(40)), rng.sample(pool, 6)
        rows = spark.createDataFrame(list(enumerate(moved)), "k int, name string")
        used, want, kept = set(taken) | set(moved), {}, set(taken)
        for k, n in enumerate(moved):
            stem, ext = re.match(r"^(.*?)(\.[^.]*)?$", n).groups()
            at = 1
            while n in kept and (f"{stem}.{at}{ext or ''}" in used):
                at += 1
            want[k] = n if n not in kept else f"{stem}.{at}{ext or ''}"
            used.add(want[k])
            kept.add(want[k])
        assert {r.k: r.target for r in intake.outcome_names(rows, frame(taken)).collect()} == want


def test_a_large_family_of_names_is_split(spark):
    many = spark.range(30_000).select((F.col("id") + 0).alias("k"), F.lit("scan.pdf").alias("name"))
    taken = spark.range(1, 40_000, 3).select(F.concat(F.lit("scan."), F.col("id").cast("string"), F.lit(".pdf")).alias("name"))
    got = [r.target for r in intake.outcome_names(many, taken).orderBy("k").select("target").collect()]
    free = (n for n in range(1, 10**6) if not (n % 3 == 1 and n < 40_000))
    assert got == ["scan.pdf", *[f"scan.{next(free)}.pdf" for _ in range(29_999)]]


def test_ranked(spark):
    from libraryloom.operators.order import ranked

    rng = random.Random(1)
    rows = [(k, rng.choice([None, "a", "b", "c"]), rng.randrange(50)) for k in range(500)]
    frame = spark.createDataFrame(rows, "k int, g string, v int")
    order = sorted(rows, key=lambda r: (-r[2], r[0]))
    assert [r.k for r in sorted(ranked(frame, [F.desc("v"), "k"]).collect(), key=lambda r: r.place)] == [r[0] for r in order]
    got = {r.k: r.place for r in ranked(frame, [F.desc("v"), "k"], "place", ["g"]).collect()}
    assert got == {r[0]: 1 + [x[0] for x in order if x[1] == r[1]].index(r[0]) for r in rows}
    assert ranked(frame.limit(0), ["k"]).collect() == []


def test_volumes_whose_marker_is_broken_over_lines(spark):
    none = F.array().cast("array<string>")
    pdfs = spark.createDataFrame([("v.pdf", "", "", 90, "Proceedings \u00a0of\nthe\tDays")], "name string, doi string, title string, pages int, front string").withColumn("outline", F.array(F.lit("A fine title of things")))
    entries = spark.createDataFrame([("x/x.md", "t", "A fine title of things", "", "", "")], "rel_path string, title string, published_title string, published_url string, doi string, published_doi string")
    assert [tuple(r) for r in intake.promotions(pdfs, entries).collect()] == [("v.pdf", "x/x.md", "volume-contains")]
    assert intake.promotions(pdfs.withColumn("front", F.lit("the days")).withColumn("outline", none), entries).collect() == []


def test_addresses_in_capitals_and_with_white_space(spark):
    assert value(spark, intake.promoted_url(F.lit("HTTPS://ex.org/a"), F.lit("old"))) == "HTTPS://ex.org/a"
    assert value(spark, intake.promoted_url(F.lit("HTTPS://ArXiv.org/abs/1"), F.lit("old"))) == "old"
    assert value(spark, urls.canonical_url(F.lit("\thttps://ex.org/a/\n"))) == "https://ex.org/a"
    assert value(spark, urls.canonical_url(F.lit("\u00a0mailto:a\x1c"))) == "mailto:a"
