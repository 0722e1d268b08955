"""One test for each finding of the third round that led to a change."""

import yaml

from libraryloom.operators import matching
from libraryloom.plans import library_queries, table_queries
from libraryloom.sources import records as source
from libraryloom.streaming import inbox


def test_blocks_are_read_in_c():
    assert not yaml.__with_libyaml__ or source.yaml_loader() is yaml.CSafeLoader


def test_a_batch_is_decided_without_sorting_all_files_of_a_key(spark):
    rows = spark.sql("SELECT 'f' || id AS name, timestamp'2024-01-01' + make_interval(0, 0, 0, 0, 0, 0, 9 - id) AS modified, 'h' || id % 3 AS hash, CASE WHEN id % 2 = 1 THEN 'k' END AS key FROM range(8)")
    out = inbox.decide_batch(rows, spark.createDataFrame([], f"{inbox.CLAIMED}, batch int"))
    assert "Window" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {r.name: r.matched for r in out.collect()}
    assert got == {"f0": "f6", "f1": "f7", "f2": "f5", "f3": "f6", "f4": "f7", "f5": "f7", "f6": None, "f7": None}


def test_a_log_of_runs_is_compressed(spark, tmp_path):
    runs = spark.sql("SELECT '2024' AS ts, 'a' AS input_name, 'success' AS outcome, array('/l/x') AS output_paths, repeat('e', 3000) AS error_excerpt, 1.0D AS cost_usd, 2L AS duration_ms")
    source.append_runs(runs, str(tmp_path / "log"))
    assert [p.suffix for p in (tmp_path / "log").iterdir() if p.name.startswith("part-")] == [".gz"]
    assert source.read_runs(spark, str(tmp_path / "log")).first().error_excerpt == "e" * 2000


def test_identifiers_of_records_far_apart_are_not_shared(spark, tmp_path):
    keys = "SELECT id + 100000 * half AS k FROM range(24) CROSS JOIN (SELECT explode(array(0, 1)) AS half)"
    spark.sql(f"SELECT k AS p_partkey, 'hot bolt' AS p_name, 'Brand#1' AS p_brand, 'SMALL' AS p_type, 3 AS p_size FROM ({keys})").write.parquet(f"{tmp_path}/part.parquet")
    spark.sql("SELECT id AS doc_id FROM range(24)").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.name: r.rel_path for r in library_queries.dup_matched_to(spark, str(tmp_path)).collect()}
    assert got["d8.pdf"] == "small/p8/p8.summary.md"


def test_like_names_leave_no_winner_to_look_for(spark):
    left = spark.sql("SELECT concat('large ring ', id, ' copy') AS text FROM range(1000, 1010)")
    right = spark.sql("SELECT concat('large ring ', id) AS text FROM range(1000, 1100)")
    got = matching.neighbours(left, right).collect()
    assert {r.text for r in got} == {r.text for r in left.collect()} and len(got) < 10 * 10


def test_only_the_two_best_of_a_group_meet(spark):
    scored = spark.sql("SELECT id % 3 AS name, concat('r', id) AS rel, round(1 / (1 + id), 6) AS score FROM range(3000)")
    out = matching.best_with_margin(scored, ["name"], "rel", "score", 0.3, 0.15)
    assert "WindowGroupLimit" in out._jdf.queryExecution().optimizedPlan().toString()
    assert {tuple(r) for r in out.collect()} == {(0, "r0", 1.0, 0.25, True), (1, "r1", 0.5, 0.2, True), (2, "r2", 0.333333, 0.166667, True)}


def test_pairs_of_documents_are_counted_in_tasks_that_follow_their_number(spark, sf, monkeypatch):
    monkeypatch.setattr(table_queries, "TASK_PAIRS", 100, raising=False)
    want = -(-spark.read.parquet(f"{sf}/documents.parquet").filter("text IS NOT NULL").count() * spark.read.parquet(f"{sf}/benchmark.parquet").count() // 100)
    plan = table_queries.best_match_margin(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(doc_id" in plan and f", {want}), REPARTITION_BY_NUM" in plan
