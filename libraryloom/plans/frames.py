"""The driver's tables shaped as the tables of a library, for Spark and, as text, for DuckDB.

One expression for each column serves both engines, so the library's operators and the SQL beside them start from the same
rows. What the columns hold is spread by the key so that every rule of the operators has rows that it fits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Author lists by the remainder of the key.
AUTHORS = ([], ["Stone, Ada"], ["GAO", "Hill, Bo"], ["Ann Lee"], ["Stone, Ada", "Hill, Bo", "Rock Institute", "Lee, Ann", "Moss, Cy"], ["Lee, Ann", "et al."])


def _array(items: list[str], spark: bool) -> str:
    inside = ", ".join(f"'{x}'" for x in items)
    if spark:
        return f"cast(array({inside}) as array<string>)"
    return f"CAST([{inside}] AS VARCHAR[])"


def _library(spark: bool) -> dict[str, str]:
    sha = (lambda x: f"sha2({x}, 256)") if spark else (lambda x: f"sha256({x})")
    k = "p_partkey"
    out = {
        "k": k,
        "folder": "lower(p_type)",
        "slug": f"'p' || {k}",
        "slug_folder": f"CASE WHEN {k} % 59 = 0 THEN 'other' ELSE 'p' || {k} END",
        "rel_path": f"lower(p_type) || '/p' || {k} || '/p' || {k} || '.summary.md'",
        "corrupt": f"{k} % 97 = 0",
        "title": f"CASE WHEN {k} % 41 = 0 THEN NULL ELSE p_name || ' ' || {k} END",
        "tldr": f"CASE WHEN {k} % 13 = 0 THEN '' ELSE 'A ' || p_name || ' | of size ' || p_size END",
        "date": f"CASE WHEN {k} % 19 = 0 THEN 'soon' WHEN {k} % 7 = 0 THEN '' ELSE (2000 + p_size % 25) || '-0' || (1 + {k} % 9) END",
        "url": f"CASE {k} % 4 WHEN 0 THEN 'https://arxiv.org/abs/2401.' || lpad(cast({k} % 100000 as string), 5, '0') || 'v2' WHEN 1 THEN 'https://papers.ssrn.com/sol3/papers.cfm?abstract_id=' || (100000 + {k}) WHEN 2 THEN 'HTTP://Ex.ORG/part/' || {k} || '/?UTM_Source=x&b=2#top' ELSE '' END",
        "preprint_url": f"CASE WHEN {k} % 5 = 0 THEN 'https://www.ex.net/pre/' || {k} || '/' END",
        "source_type": "CASE p_size % 6 WHEN 0 THEN 'paper' WHEN 1 THEN 'Essay' WHEN 2 THEN 'working-paper' WHEN 3 THEN 'preprint' WHEN 4 THEN 'widget' ELSE '' END",
        "publication": f"CASE {k} % 8 WHEN 0 THEN 'arXiv' WHEN 1 THEN 'Journal of Tides' WHEN 2 THEN 'OECD' WHEN 3 THEN 'Rock Institute' WHEN 4 THEN 'SSRN Electronic' WHEN 5 THEN 'preprint server' ELSE '' END",
        "status": f"CASE {k} % 10 WHEN 0 THEN '' WHEN 1 THEN 'retracted' WHEN 2 THEN 'superseded' WHEN 3 THEN 'odd' ELSE 'active' END",
        "superseded_by": f"CASE WHEN {k} % 10 IN (0, 2) AND {k} % 4 = 0 THEN 'p' || ({k} + 1) WHEN {k} % 10 = 5 THEN 'null' ELSE '' END",
        "retrieved": f"CASE WHEN {k} % 3 = 0 THEN '' ELSE '2024-01-0' || (1 + {k} % 9) END",
        "currency_check": f"CASE {k} % 6 WHEN 0 THEN 'none' WHEN 1 THEN '2031-01-01' ELSE '2024-02-0' || (1 + {k} % 9) END",
        "snapshot": f"CASE WHEN {k} % 5 = 2 THEN 'true' ELSE 'false' END",
        "category": f"CASE WHEN {k} % 53 = 0 THEN 'other' ELSE lower(p_type) END",
        "discovered_via": f"CASE {k} % 9 WHEN 0 THEN 'digest:item/' || {k} WHEN 1 THEN 'manual' WHEN 2 THEN 'somewhere' ELSE '' END",
        "source_hash": f"CASE WHEN {k} % 3 <> 0 THEN {sha(f'p_name || {k}')} END",
        "original_kind": f"CASE {k} % 5 WHEN 0 THEN 'pdf' WHEN 1 THEN 'pdf' WHEN 2 THEN 'snapshot' END",
        "original_hash": f"CASE WHEN {k} % 5 <= 2 THEN {sha(f"'o' || {k}")} END",
        "authors": f"CASE {k} % 6 " + " ".join(f"WHEN {n} THEN {_array(a, spark)}" for n, a in enumerate(AUTHORS)) + " END",
        "tags": f"{'array' if spark else ''}{'(' if spark else '['}lower(p_brand){')' if spark else ']'}",
    }
    return out


LINES = ("title", "source_type", "publication", "date", "url", "retrieved", "currency_check", "snapshot", "category", "tldr", "status", "superseded_by", "discovered_via")


def library(spark: SparkSession, d: str) -> DataFrame:
    """The records of a library: one for each part, with its front matter as text and as fields."""
    from pyspark.sql import functions as F

    rows = spark.read.parquet(f"{d}/part.parquet").selectExpr(*[f"{e} AS {c}" for c, e in _library(True).items()])
    fields = [F.concat(F.lit(f"{c}: "), F.coalesce(c, F.lit(""))) for c in LINES]
    people = F.when(F.size("authors") > 0, F.concat(F.lit("authors:"), F.array_join(F.transform("authors", lambda a: F.concat(F.lit('\n  - "'), a, F.lit('"'))), ""))).otherwise("authors: []")
    block = F.concat_ws("\n", *fields, people)
    rows = rows.withColumn("block", F.concat(block, F.lit("\n"))).withColumn("modified", F.lit("2024-06-01 00:00:00").cast("timestamp"))
    return rows.withColumn("body", F.concat(F.lit("---\n"), block, F.lit("\n---\nBody of "), "slug", F.lit(".\n")))


def library_sql() -> str:
    """``lib``: the same rows as a common table expression."""
    return "lib AS (SELECT " + ", ".join(f"{e} AS {c}" for c, e in _library(False).items()) + " FROM part)"


#: The cells of ``projected`` records in SQL: byline of AUTHORS, status, year and defaults.
BYLINE = "CASE k % 6 WHEN 0 THEN '' WHEN 1 THEN 'Stone' WHEN 2 THEN 'GAO, Hill' WHEN 3 THEN 'Lee' WHEN 4 THEN 'Stone, Hill, Rock Institute, Lee et al.' ELSE 'Lee, al.' END"
STATUS = "CASE WHEN status <> '' THEN lower(status) WHEN lower(superseded_by) NOT IN ('', 'null', '~', 'none') THEN 'superseded' ELSE 'active' END"
YEAR = "CASE WHEN length(date) >= 4 THEN left(date, 4) ELSE '' END"
TITLE = "coalesce(title, slug || '.summary')"
