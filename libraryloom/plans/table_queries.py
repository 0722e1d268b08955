"""Column functions and matching on the tables of the driver as they are, beside the SQL that DuckDB runs on the same files.

``now`` is always a literal, ties are broken by keys, and sums of doubles are rounded, so both engines agree. A null text
counts as empty; null keys match nothing. The operators on records are in ``library_queries``.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from libraryloom.functions import identifiers, measures, names, text, urls
from libraryloom.operators import matching
from libraryloom.plans.register import CANON, ORACLE_SQL, QUERIES, read, register

__all__ = ["ORACLE_SQL", "QUERIES"]
NOW = "2024-01-30 00:00:00"


def stamp(c: str):
    return F.col(c).cast("timestamp")


# -- addresses, titles, names --------------------------------------------------------------------------------------------

@register(f"SELECT page_id, {CANON} AS canonical FROM pages")
def url_canonical(spark, d):
    return read(spark, d, "pages").select("page_id", urls.canonical_url(F.col("url")).alias("canonical"))


@register(f"SELECT canonical, min(page_id) AS keep_id, count(*) AS copies FROM (SELECT page_id, {CANON} AS canonical FROM pages) GROUP BY canonical")
def url_dedup(spark, d):
    rows = read(spark, d, "pages").select("page_id", urls.canonical_url(F.col("url")).alias("canonical"))
    return rows.groupBy("canonical").agg(F.min("page_id").alias("keep_id"), F.count(F.lit(1)).alias("copies"))


@register("""
SELECT page_id, CASE WHEN last <> '' THEN last ELSE 'candidate-' || page_id END AS slug FROM (
  SELECT page_id, regexp_replace(regexp_replace(lower(regexp_replace(regexp_extract(regexp_replace(regexp_extract(url, '(?i)^https?://[^/?#]*([^?#]*)', 1), '/+$', ''), '([^/]*)$', 1), '(?i)\\.(pdf|html?|md|txt)$', '')), '[^a-z0-9.]+', '-', 'g'), '^[-.]+|[-.]+$', '', 'g') AS last FROM pages)
""")
def url_slug(spark, d):
    return read(spark, d, "pages").select("page_id", urls.slug_from_url(F.col("url"), F.col("page_id")).alias("slug"))


@register("""
SELECT page_id, CASE WHEN regexp_matches(url, '(?i)arxiv\\.org/(abs|pdf|html)/') THEN 'arXiv' WHEN regexp_matches(url, '(?i)ssrn\\.com/') THEN 'SSRN'
  WHEN regexp_matches(host, 'example\\.org$') THEN 'org' WHEN regexp_matches(host, 'example\\.net$') THEN 'net' WHEN starts_with(host, 'www.') THEN 'www' ELSE 'other' END AS kind
FROM (SELECT page_id, url, lower(regexp_extract(url, '(?i)^https?://([^/?#]*)', 1)) AS host FROM pages)
""")
def url_classify(spark, d):
    u, h = F.col("url"), urls.host(F.col("url"))
    venue = identifiers.preprint_venue(u, F.lit(""), F.lit(""))["venue"]
    kind = F.when(h.endswith("example.org"), "org").when(h.endswith("example.net"), "net").when(h.startswith("www."), "www").otherwise("other")
    return read(spark, d, "pages").select("page_id", F.coalesce(venue, kind).alias("kind"))


@register("""
SELECT 'document' AS kind, doc_id AS id, trim(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', ' ', 'g')) AS title FROM documents
UNION ALL SELECT 'benchmark', item_id, trim(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', ' ', 'g')) FROM benchmark
""")
def title_normalize(spark, d):
    a = read(spark, d, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), text.normalize_title(F.col("text")).alias("title"))
    b = read(spark, d, "benchmark").select(F.lit("benchmark").alias("kind"), F.col("item_id").alias("id"), text.normalize_title(F.col("text")).alias("title"))
    return a.union(b)


@register("""
SELECT doc_id, coalesce(list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x)), lambda x: length(x) >= 12
  AND NOT regexp_matches(lower(x), 'untitled|microsoft word|\\.dvi|\\.tex|preprint\\.pdf|annual meeting of the association|conference on empirical methods|\\(c\\)|^(proceedings of|findings of the|in proceedings)|^pages?[ \\t]+[0-9]|^vol(\\.|ume)[ \\t]')
  AND NOT contains(x, '©'))[1], '') AS title FROM documents
""")
def first_title_line(spark, d):
    return read(spark, d, "documents").select("doc_id", text.first_title_line(F.col("text")).alias("title"))


ORGS = f"({'|'.join((*names.ORG_WORDS, *names.ORG_TERMS))})"
INSTITUTION = f"""
CASE WHEN trim(n) = '' THEN false WHEN trim(n) IN ({", ".join(f"'{x}'" for x in names.KNOWN_ORGS)}) THEN true
  WHEN regexp_matches(trim(n), '\\b({"|".join(names.VENUE_WORDS)})\\b') THEN false WHEN regexp_matches(trim(n), '\\b{ORGS}\\b') THEN true
  ELSE NOT contains(n, ',') AND len(list_filter(regexp_split_to_array(trim(n), '[ \\t\\n\\r]+'), lambda w: w <> '')) >= 4 END
"""


@register(f"""
SELECT kind, id, CASE WHEN {INSTITUTION} THEN n WHEN trim(n) = '' THEN '' WHEN contains(n, ',') THEN trim(string_split(trim(n), ',')[1]) ELSE list_last(regexp_split_to_array(trim(n), '[ \\t\\n\\r]+')) END AS author
FROM (SELECT 'customer' AS kind, c_custkey AS id, c_name AS n FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_name FROM supplier UNION ALL SELECT 'part', p_partkey, p_name FROM part)
""")
def author_display(spark, d):
    def of(table, key, name):
        return read(spark, d, table).select(F.lit(table).alias("kind"), F.col(key).alias("id"), names.display_name(F.col(name)).alias("author"))

    return of("customer", "c_custkey", "c_name").union(of("supplier", "s_suppkey", "s_name")).union(of("part", "p_partkey", "p_name"))


# -- duplicates ----------------------------------------------------------------------------------------------------------


@register("SELECT sha256(coalesce(text, '')) AS digest, min(doc_id) AS keep_id, count(*) AS copies FROM documents GROUP BY 1")
def content_hash_dedup(spark, d):
    rows = read(spark, d, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))
    return rows.groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("copies"))


# -- index and audit -----------------------------------------------------------------------------------------------------


@register("""
SELECT source, n, row_number() OVER (ORDER BY CASE source WHEN 'src5' THEN 1 WHEN 'src1' THEN 2 WHEN 'src3' THEN 3 ELSE 1000 END, source) AS place
FROM (SELECT source, count(*) AS n FROM documents GROUP BY source)
""")
def category_order(spark, d):
    counts = read(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    rank = F.array_position(F.array(*[F.lit(x) for x in ("src5", "src1", "src3")]), F.col("source"))
    order = Window.orderBy(F.when(rank > 0, rank).otherwise(1000), "source")  # one row for each category
    return counts.select("source", "n", F.row_number().over(order).cast("long").alias("place"))


# -- runs, states, ages --------------------------------------------------------------------------------------------------


@register(f"""
SELECT event_id, epoch(TIMESTAMP '{NOW}') - epoch(ts) < 7 * 86400 AND event_type <> 'error' AS fresh, ts >= TIMESTAMP '{NOW}' - INTERVAL 7 DAY AS flagged FROM
(SELECT event_id, event_type, date_trunc('second', ts) AS ts FROM events)
""")
def freshness_split(spark, d):
    now = F.lit(NOW).cast("timestamp")
    ts = F.date_trunc("second", stamp("ts"))
    return read(spark, d, "events").select("event_id", measures.is_fresh(ts, now, 7, F.col("event_type") == "error").alias("fresh"), (ts >= now - F.expr("INTERVAL 7 DAY")).alias("flagged"))


@register("""
SELECT event_type, severity, CASE severity WHEN 'bad' THEN 0 WHEN 'warn' THEN 1 ELSE 2 END AS rank, n FROM
(SELECT event_type, CASE WHEN event_type = 'error' THEN 'bad' WHEN event_type IN ('signup', 'view') THEN 'warn' ELSE 'ok' END AS severity, count(*) AS n FROM events GROUP BY 1, 2)
ORDER BY rank, event_type
""")
def severity_sort(spark, d):
    t = F.col("event_type")
    rows = read(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    rows = rows.withColumn("severity", F.when(t == "error", "bad").when(t.isin("signup", "view"), "warn").otherwise("ok"))
    return rows.withColumn("rank", measures.severity_rank(F.col("severity")).cast("int")).orderBy("rank", "event_type")


AGE = "epoch(TIMESTAMP '2024-02-01 00:00:00') - epoch(date_trunc('second', ts))"


@register(f"""
SELECT event_id, CASE WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN CAST(floor(s / 60) AS BIGINT) || 'm ago' WHEN s < 86400 THEN CAST(floor(s / 3600) AS BIGINT) || 'h ago' ELSE CAST(floor(s / 86400) AS BIGINT) || 'd ago' END AS age
FROM (SELECT event_id, {AGE} AS s FROM events)
""")
def age_human(spark, d):
    return read(spark, d, "events").select("event_id", measures.age_text(stamp("ts"), F.lit("2024-02-01 00:00:00").cast("timestamp")).alias("age"))


@register("SELECT doc_id, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN printf('%.1f KB', n / 1024.0) ELSE printf('%.1f MB', n / 1048576.0) END AS size FROM (SELECT doc_id, strlen(coalesce(text, '')) AS n FROM documents)")
def size_human(spark, d):
    return read(spark, d, "documents").select("doc_id", measures.size_text(F.octet_length(F.coalesce("text", F.lit("")))).alias("size"))


# -- matching ------------------------------------------------------------------------------------------------------------

#: Pairs of an item and a document that a task counts at most, on average.
TASK_PAIRS = 250_000


@register("""
WITH q AS (SELECT item_id, unnest(list_distinct(string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' '))) AS w FROM benchmark),
     t AS (SELECT doc_id, unnest(list_distinct(string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' '))) AS w FROM documents),
     qn AS (SELECT item_id, count(*) AS n FROM q GROUP BY item_id), tn AS (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id),
     p AS (SELECT item_id, doc_id, count(*) AS c FROM q JOIN t ON q.w = t.w GROUP BY item_id, doc_id),
     s AS (SELECT p.item_id, p.doc_id, round(c / (qn.n + tn.n - c)::DOUBLE, 6) AS score FROM p JOIN qn ON p.item_id = qn.item_id JOIN tn ON p.doc_id = tn.doc_id),
     r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS k, lead(score, 1, 0.0) OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS runner_up FROM s)
SELECT item_id, doc_id, score, runner_up, score >= 0.3 AND round(score - runner_up, 9) >= 0.15 AS accepted FROM r WHERE k = 1
""")
def best_match_margin(spark, d):
    def words(table, key, n):
        w = F.array_distinct(F.split(text.normalize_title(F.col("text")), " "))
        return read(spark, d, table).filter("text IS NOT NULL").select(key, w.alias("ws")).select(key, F.size("ws").alias(n), "ws")

    # a document's words stay in one task, which counts its pairs; so many tasks that none has to hold more than TASK_PAIRS
    documents, items = words("documents", "doc_id", "tn"), words("benchmark", "item_id", "qn")
    documents = documents.repartition(max(1, -(-documents.count() * items.count() // TASK_PAIRS)), "doc_id")
    # the number of words goes along with each word, so that pairs need no further joins
    each = lambda rows: rows.withColumn("w", F.explode("ws")).drop("ws")
    pairs = each(documents).join(each(items), "w").groupBy("item_id", "qn", "doc_id", "tn").agg(F.count(F.lit(1)).alias("c"))
    scored = pairs.select("item_id", "doc_id", F.round(F.col("c") / (F.col("qn") + F.col("tn") - F.col("c")), 6).alias("score"))
    return matching.best_with_margin(scored, ["item_id"], "doc_id", "score", 0.30, 0.15)


@register("SELECT l_orderkey, min(l_suppkey) AS l_suppkey FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT l_suppkey) = 1")
def unique_match_gate(spark, d):
    return matching.only_match(read(spark, d, "lineitem"), ["l_orderkey"], "l_suppkey")


# -- mirrors, retirement, provenance -------------------------------------------------------------------------------------


@register("SELECT doc_id FROM documents WHERE contains(lower(concat_ws(' ', source, lang, text)), 'src3 en')")
def free_text_search(spark, d):
    return read(spark, d, "documents").filter(text.matches_search(" Src3 EN ", F.col("source"), F.col("lang"), F.col("text"))).select("doc_id")


@register("""
SELECT c_custkey, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000) THEN 0 WHEN c_nationkey BETWEEN 10 AND 20 THEN 1 ELSE 2 END AS priority FROM customer
""")
def review_priority(spark, d):
    flagged = read(spark, d, "orders").filter("o_totalprice > 300000").select(F.col("o_custkey").alias("flag")).distinct()
    rows = read(spark, d, "customer").join(flagged, F.col("c_custkey") == F.col("flag"), "left")
    return rows.select("c_custkey", F.when(F.col("flag").isNotNull(), 0).when(F.col("c_nationkey").between(10, 20), 1).otherwise(2).alias("priority"))
