"""The library's operators on the driver's tables shaped as a library, beside SQL that says what they must give.

The SQL never follows the operators' way: it says the result from the columns of the frames, for DuckDB on the same files.
A null in a text column counts as empty, a null key matches nothing; each operator's docstring says more.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from libraryloom.functions import front, identifiers, measures, names, paths, similarity, text, urls
from libraryloom.operators import intake, lifecycle, matching, mirror, preprints, records
from libraryloom.plans.frames import BYLINE, LINES, STATUS, TITLE, YEAR, library, library_sql
from libraryloom.plans.register import QUERIES, read, register
from libraryloom.sources import listings, scratch
from libraryloom.sources import records as source

LIB = f"WITH {library_sql()}"
NOW = "2024-06-10 00:00:00"
TODAY = "2024-06-01"


def joined(c, by: str = "; "):
    return F.array_join(c, by)


# -- index, audit, search ------------------------------------------------------------------------------------------------

DASH = lambda x: f"CASE WHEN {x} = '' THEN '—' ELSE {x} END"
CELL = lambda x: f"replace(replace(coalesce({x}, ''), '|', '\\|'), chr(10), ' ')"


@register(f"""{LIB}, good AS (SELECT *, {TITLE} AS t, {STATUS} AS st, CASE folder WHEN 'standard' THEN 1 WHEN 'economy' THEN 2 ELSE 3 END AS a FROM lib WHERE NOT corrupt),
body AS (SELECT a, folder AS b, 3 + row_number() OVER (PARTITION BY folder ORDER BY date DESC, t DESC, rel_path) AS c,
  '| [' || {CELL("t")} || '](' || rel_path || ')' || CASE WHEN st = 'active' THEN '' ELSE ' · *' || st || CASE WHEN superseded_by IN ('', 'null') THEN '' ELSE ' → ' || superseded_by END || '*' END || ' | ' || {DASH(CELL("trim(tldr)"))} || ' | ' || {BYLINE} || ' | ' || {DASH(f"({YEAR})")} || ' |' AS line FROM good),
head AS (SELECT a, folder AS b, unnest([0, 1, 2, 3, 1000000000]) AS c, unnest(['## ' || folder, '', '| Title | Tl;dr | Author(s) | Year |', '|-------|-------|-----------|------|', '']) AS line FROM good GROUP BY a, folder),
every AS (SELECT * FROM head UNION ALL SELECT * FROM body UNION ALL SELECT 1000000, 'empty', unnest([0, 1, 2, 3]), unnest(['## empty', '', '*No sources yet.*', '']) UNION ALL SELECT -1, '', unnest([0, 1]), unnest(['# Source Index', '']))
SELECT row_number() OVER (ORDER BY a, b, c) AS place, line FROM every""")
def category_index(spark, d):
    lib = library(spark, d)
    folders = lib.select(F.col("folder").alias("category")).distinct().union(spark.createDataFrame([("empty",)], "category string"))
    return records.index_lines(lib, ("standard", "economy"), folders)


LINKS = "links AS (SELECT CASE WHEN k % 31 = 0 THEN 'gone/g' || k || '/g' || k || '.summary.md' ELSE rel_path END AS rel_path FROM lib WHERE k % 11 <> 0)"
ISSUES = f"""{LIB}, {LINKS},
issues AS (SELECT rel_path, 'corrupt' AS issue FROM lib WHERE corrupt UNION ALL SELECT rel_path, 'missing-original' FROM lib WHERE original_kind IS NULL
  UNION ALL SELECT rel_path, 'unindexed' FROM lib WHERE rel_path NOT IN (SELECT rel_path FROM links) UNION ALL SELECT DISTINCT rel_path, 'orphan-link' FROM links WHERE rel_path NOT IN (SELECT rel_path FROM lib))"""


def index_text(lib):
    """The links of an index, read from its lines by the library's own reader."""
    at = F.when(F.col("k") % 31 == 0, F.concat(F.lit("gone/g"), "k", F.lit("/g"), "k", F.lit(".summary.md"))).otherwise(F.col("rel_path"))
    lines = lib.filter("k % 11 <> 0").select(F.concat(F.lit("| [x y]("), at, F.lit(") | [web](http://a.b/c) |")).alias("line"))
    return lines.select(F.explode(source.index_links(F.col("line"))).alias("rel_path"))


@register(f"{ISSUES} SELECT rel_path, issue FROM issues")
def audit_orphans(spark, d):
    lib = library(spark, d)
    return records.audit(lib, index_text(lib))


@register(f"{ISSUES} SELECT row_number() OVER (PARTITION BY issue ORDER BY coalesce(folder, ''), lower(CASE WHEN folder IS NULL THEN '' ELSE {TITLE} END), i.rel_path) AS place, issue, folder AS category, CASE WHEN folder IS NOT NULL THEN {TITLE} END AS title, i.rel_path FROM issues i LEFT JOIN lib ON lib.rel_path = i.rel_path")
def audit_report(spark, d):
    lib = library(spark, d)
    return records.audit_report(lib, index_text(lib))


@register(f"{ISSUES} SELECT (SELECT count(*) FROM lib) AS summaries, count(*) FILTER (issue = 'orphan-link') AS orphan_link, count(*) FILTER (issue = 'unindexed') AS unindexed, count(*) FILTER (issue = 'missing-original') AS missing_original, count(*) FILTER (issue = 'corrupt') AS corrupt, count(*) AS issues FROM issues")
def audit_tiles(spark, d):
    lib = library(spark, d)
    return records.audit_tiles(lib, index_text(lib))


@register(f"{LIB} SELECT rel_path, folder AS category, {TITLE} AS title, trim(tldr) AS tldr, {STATUS} AS status, {YEAR} AS year, url, original_kind FROM lib WHERE NOT corrupt")
def record_projection(spark, d):
    return records.projected(library(spark, d)).select("rel_path", "category", "title", "tldr", "status", "year", "url", "original_kind")


@register(f"{LIB} SELECT rel_path, 'Filed *' || coalesce(title, slug) || '* (' || CASE k % 6 WHEN 0 THEN 'unattributed' WHEN 3 THEN 'Ann Lee' WHEN 4 THEN 'Stone et al.' WHEN 5 THEN 'Lee, et al.' ELSE {BYLINE} END || ', ' || left(date, 4) || ') into `' || folder || '/' || slug || '/`. Key finding: ' || tldr || '.' AS text FROM lib WHERE NOT corrupt")
def filed_entries(spark, d):
    return records.filed_entries(library(spark, d).withColumn("tldr", F.concat(F.lit(" "), "tldr", F.lit(".. "))))


@register(f"{LIB} SELECT rel_path, {TITLE} AS title FROM lib WHERE NOT corrupt AND contains(lower(concat_ws(' ', {TITLE}, trim(tldr), array_to_string(authors, ' '), lower(tags[1]), folder)), 'hill, bo')")
def library_search(spark, d):
    return records.search(library(spark, d), "  HILL, Bo ").select("rel_path", "title")


@register(f"{LIB} SELECT folder AS category, count(*) AS n FROM lib WHERE NOT corrupt GROUP BY folder")
def category_counts(spark, d):
    return records.projected(library(spark, d)).groupBy("category").agg(F.count(F.lit(1)).alias("n"))


# -- front matter --------------------------------------------------------------------------------------------------------


@register(f"{LIB} SELECT rel_path, coalesce(title, '') AS title, date, status, superseded_by, array_to_string(authors, '; ') AS authors, 'Body of ' || slug || '.' || chr(10) AS body FROM lib")
def front_matter_lines(spark, d):
    """Title, date, status and successor by the line dialect, authors by YAML, of records written as text."""
    rows = library(spark, d).select("rel_path", F.col("body").alias("whole"))
    rows = rows.withColumn("block", source.front_matter(F.col("whole")))
    line = lambda c: source.line_scalar(F.col("block"), c).alias(c)
    rows = source.parse_yaml(rows)
    return rows.select("rel_path", line("title"), line("date"), line("status"), line("superseded_by"), joined(F.col("fields.authors")).alias("authors"), source.body_after(F.col("whole")).alias("body"))


ODD = "CASE k % 3 WHEN 0 THEN '/?q=$b' WHEN 1 THEN '/a$1b$$' ELSE '/c#$(x)$' END"


@register(f"""{LIB}, w AS (SELECT *, k % 4 = 3 AS p, k % 4 = 3 AND k % 5 = 0 AS q FROM lib)
SELECT rel_path, replace(replace(body, CASE WHEN p THEN chr(10) || 'url: ' || chr(10) ELSE '' END, CASE WHEN p THEN chr(10) || 'url: "https://doi.org/10.1/' || k || {ODD} || '"' || chr(10) || CASE WHEN q THEN 'preprint_url: "https://www.ex.net/pre/' || k || '/"' || chr(10) ELSE '' END ELSE '' END),
  CASE WHEN original_kind IS NULL THEN '' ELSE chr(10) || 'status: ' END, CASE WHEN original_kind IS NULL THEN '' ELSE chr(10) || 'source_hash: "' || original_hash || '$2' || '"' || chr(10) || 'status: ' END) AS text
FROM (SELECT w.*, '---' || chr(10) || {" || chr(10) || ".join(f"'{line}: ' || coalesce({line}, '')" for line in LINES)} || chr(10) || CASE WHEN len(authors) > 0 THEN 'authors:' || array_to_string(list_transform(authors, lambda a: chr(10) || '  - "' || a || '"'), '') ELSE 'authors: []' END || chr(10) || '---' || chr(10) || 'Body of ' || slug || '.' || chr(10) AS body FROM w)""")
def written_fields(spark, d):
    """The whole text of records after hash, origin and addresses were written into it; values hold ``$`` and braces."""
    c = F.col
    rows = library(spark, d)
    published = F.when(c("k") % 4 == 3, F.concat(F.lit("https://doi.org/10.1/"), c("k").cast("string"), F.expr(ODD))).otherwise("")
    preprint = F.when(c("k") % 4 == 3, c("preprint_url"))
    new = front.with_urls(front.with_origin(c("body"), F.lit("manual")), published, preprint)
    return rows.select("rel_path", F.when(c("original_hash").isNotNull(), front.with_hash(new, F.concat("original_hash", F.lit("$2")))).otherwise(new).alias("text"))


# -- validation ----------------------------------------------------------------------------------------------------------

FILLED = lambda x: f"CASE WHEN lower(trim({x})) NOT IN ('', 'null', '~', 'none') THEN trim({x}) END"
NORMAL = f"""{LIB}, n0 AS (SELECT *, coalesce({FILLED("superseded_by")}, '') AS n_succ, coalesce({FILLED("retrieved")}, '{TODAY}') AS n_retr FROM lib),
norm AS (SELECT *, coalesce({FILLED("status")}, CASE WHEN n_succ <> '' THEN 'superseded' ELSE 'active' END) AS n_stat, CASE WHEN original_kind = 'snapshot' THEN 'true' ELSE 'false' END AS n_snap,
  CASE WHEN regexp_matches(currency_check, '^\\d{{4}}-\\d\\d-\\d\\d$') AND currency_check <= '{TODAY}' THEN currency_check ELSE n_retr END AS n_curr,
  CASE source_type WHEN 'essay' THEN 'article' WHEN 'working-paper' THEN 'paper' WHEN 'preprint' THEN 'paper' ELSE source_type END AS n_kind FROM n0)"""


@register(NORMAL + """ SELECT rel_path, array_to_string(list_filter([
  CASE WHEN superseded_by <> n_succ THEN 'superseded_by: ' || superseded_by || ' -> ' || n_succ END, CASE WHEN status <> n_stat THEN 'status: ' || status || ' -> ' || n_stat END,
  CASE WHEN snapshot <> n_snap THEN 'snapshot: ' || snapshot || ' -> ' || n_snap END, CASE WHEN retrieved <> n_retr THEN 'retrieved: ' || retrieved || ' -> ' || n_retr END,
  CASE WHEN currency_check <> n_curr THEN 'currency_check: ' || currency_check || ' -> ' || n_curr END, CASE WHEN source_type <> n_kind THEN 'source_type: ' || source_type || ' -> ' || n_kind END], lambda x: x IS NOT NULL), '; ') AS notes FROM norm""")
def normalize_notes(spark, d):
    return records.validated(library(spark, d), TODAY).select("rel_path", joined(F.col("notes")).alias("notes"))


ERRORS = """list_filter([CASE WHEN title IS NULL THEN 'title is empty' END, CASE WHEN tldr = '' THEN 'tldr is empty' END, CASE WHEN date = '' THEN 'date is empty' END,
  CASE WHEN n_kind NOT IN ('paper', 'documentation', 'article', 'report', 'book-chapter', 'opinion', 'book') THEN 'unknown source_type: ' || n_kind END,
  CASE WHEN n_stat NOT IN ('active', 'superseded', 'retracted', 'withdrawn') THEN 'unknown status: ' || n_stat END, CASE WHEN n_stat = 'superseded' AND n_succ = '' THEN 'superseded without successor' END,
  CASE WHEN discovered_via IN ('', 'somewhere') THEN 'bad discovered_via' END, CASE WHEN date = 'soon' THEN 'bad date' END, CASE WHEN category <> folder THEN 'category is not the folder' END,
  CASE WHEN slug <> slug_folder THEN 'slug is not the folder' END, CASE WHEN k % 6 = 0 THEN 'no authors' END, CASE WHEN k % 6 = 5 THEN 'et al. among authors' END, CASE WHEN k % 6 = 3 THEN 'author not as Last, First' END,
  CASE WHEN k % 7 = 3 AND k % 6 IN (1, 2, 3, 4) AND k % 6 NOT IN (1, 4) THEN 'first author differs' END, CASE WHEN k % 7 = 3 AND k % 6 IN (2, 4) THEN 'number of authors differs' END], lambda x: x IS NOT NULL)"""


@register(f"{NORMAL} SELECT rel_path, array_to_string({ERRORS}, '; ') AS errors, len({ERRORS}) = 0 AS valid FROM norm")
def validate_errors(spark, d):
    lib = library(spark, d)
    external = lib.filter("k % 7 = 3").select("rel_path", F.array(F.lit("Ada Stone")).alias("external_authors"))
    return records.validated(lib, TODAY, external).select("rel_path", joined(F.col("errors")).alias("errors"), "valid")


@register(f"{LIB} SELECT rel_path, 'hash' AS kind, original_hash AS value FROM lib WHERE original_kind IS NOT NULL AND source_hash IS NULL UNION ALL SELECT rel_path, 'author', publication FROM lib WHERE k % 6 = 0 AND publication IN ('OECD', 'Rock Institute')")
def backfills(spark, d):
    lib = library(spark, d)
    a = records.backfilled_hashes(lib).select("rel_path", F.lit("hash").alias("kind"), F.col("source_hash").alias("value"))
    return a.union(records.backfilled_authors(lib).select("rel_path", F.lit("author"), F.element_at("authors", 1)))


@register(f"{LIB} SELECT rel_path, 'Removed ' || coalesce('*' || title || '*', '`' || folder || '/' || slug || '`') || ' from `' || folder || '/' || slug || '/`. Deleted via the dashboard.' AS text, row_number() OVER (ORDER BY rel_path) AS seq, (SELECT count(*) FROM lib) - count(*) OVER () AS left_over FROM lib WHERE k % 50 = 7")
def deletions(spark, d):
    """Requests that are safe and name a record, with the changelog's text and how many records are left."""
    lib = library(spark, d)
    bad = spark.createDataFrame([("../x/x.summary.md",), ("a/b.summary.md",), ("_hidden/p7/p7.summary.md",), ("gone/g/g.summary.md",)], "rel_path string")
    asked = lib.filter("k % 50 = 7").select("rel_path").union(bad)
    left, log = records.after_deletion(lib, asked, NOW)
    gone = records.deletable(lib, asked)
    count = left.agg(F.count(F.lit(1)).alias("left_over"))
    order = gone.select("rel_path", F.row_number().over(matching.Window.orderBy("rel_path")).cast("long").alias("seq"))
    return order.join(log, "seq").crossJoin(F.broadcast(count)).select("rel_path", "text", "seq", "left_over")  # one row


SPELT = "CASE k % 9 WHEN 0 THEN rel_path WHEN 1 THEN '../' || rel_path WHEN 2 THEN '/' || rel_path WHEN 3 THEN folder || '/./' || slug || '.PDF' WHEN 4 THEN folder || '/../' || slug || '.md' WHEN 5 THEN folder || '//' || slug || '.exe' WHEN 6 THEN '' WHEN 7 THEN slug || '.md' ELSE folder || '/..' || slug || '.html' END"


@register(f"""{LIB} SELECT k, {SPELT} AS asked, CASE k % 9 WHEN 0 THEN rel_path WHEN 3 THEN folder || '/' || slug || '.PDF' WHEN 4 THEN slug || '.md' WHEN 5 THEN folder || '/' || slug || '.exe' WHEN 6 THEN '' WHEN 7 THEN slug || '.md' WHEN 8 THEN folder || '/..' || slug || '.html' END AS resolved,
  k % 9 IN (0, 7) AS viewable, k % 9 IN (0, 3, 7, 8) AS servable, k % 9 = 7 AS safe_name FROM lib""")
def path_guards(spark, d):
    """Which spellings of a record's path may be shown, served or taken as a name; some would leave the library."""
    asked = F.col("asked")
    rows = library(spark, d).select("k", F.expr(SPELT).alias("asked"))
    return rows.select("k", "asked", paths.resolved(asked).alias("resolved"), paths.viewable(asked).alias("viewable"), paths.servable(asked).alias("servable"), paths.safe_name(asked).alias("safe_name"))


# -- incoming files ------------------------------------------------------------------------------------------------------

@register(f"""{LIB}, own AS (SELECT doc_id, doc_id % 4 AS m, doc_id % 12 = 8 AS named, 'd' || doc_id || CASE doc_id % 4 WHEN 0 THEN '.pdf' WHEN 1 THEN '.url' WHEN 2 THEN '.md' ELSE '.zip' END AS name FROM documents WHERE doc_id % 4 <> 2 OR doc_id % 3 <> 0)
SELECT o.name, l.rel_path, CASE WHEN l.k IS NULL THEN NULL WHEN m = 1 THEN 'url' WHEN named THEN 'backfill:fuzzy' WHEN l.original_kind IS NULL AND m IN (0, 2) THEN 'backfill:hash' ELSE 'hash' END AS reason
FROM own o LEFT JOIN lib l ON CASE WHEN m = 1 THEN l.k = o.doc_id + 1 AND l.k % 4 = 2 WHEN named THEN l.k = o.doc_id AND l.original_kind IS NULL ELSE o.doc_id % 3 = 1 AND l.k = o.doc_id AND l.source_hash IS NOT NULL END""")
def dup_matched_to(spark, d):
    """What happens to incoming files: by hash, by address, by the identifier in a name; other names are like no record's.

    An identifier's month goes on with each 100,000 records, so no two records share one.
    """
    c = F.col
    lib = library(spark, d)
    month = lambda k: F.lpad((2401 + F.floor(k / 100000)).cast("string"), 4, "0")
    lib = lib.withColumn("url", F.when(c("k") % 4 == 0, F.regexp_replace("url", F.lit("/2401\\."), F.concat(F.lit("/"), month(c("k")), F.lit(".")))).otherwise(c("url")))
    m = c("doc_id") % 4
    docs = read(spark, d, "documents").filter("doc_id % 4 <> 2 OR doc_id % 3 <> 0").select("doc_id", m.alias("m"))
    known = lib.select(c("k").alias("doc_id"), "source_hash")
    ext = F.when(c("m") == 0, ".pdf").when(c("m") == 1, ".url").when(c("m") == 2, ".md").otherwise(".zip")
    rows = docs.join(matching.whole(known), "doc_id", "left")
    named = F.concat(F.lit("a paper "), month(c("doc_id")), F.lit("."), F.lpad((c("doc_id") % 100000).cast("string"), 5, "0"), F.lit(" final"))
    inputs = rows.select(
        F.concat(F.lit("d"), "doc_id", ext).alias("name"), F.when((c("m") != 1) & (c("doc_id") % 3 == 1), c("source_hash")).alias("hash"),
        F.when(c("m") == 1, F.concat(F.lit("http://ex.org/part/"), c("doc_id") + 1, F.lit("?b=2"))).alias("url"),
        F.when(c("doc_id") % 12 == 8, named).otherwise(F.concat(F.lit("zzzz"), "doc_id")).alias("stem"), F.lit("").alias("meta_title"), F.lit("").alias("first_page"),
    )
    return intake.decide(inputs, lib)


@register("""
WITH f AS (SELECT event_id, 'e' || event_id || CASE WHEN event_id % 2 = 0 THEN '.pdf' ELSE '.url' END AS name, sha256(event_type || user_id) AS hash, ts,
  CASE WHEN event_id % 2 = 1 THEN 'http://ex.org/' || (user_id % 50) END AS key FROM events),
r AS (SELECT *, first_value(name) OVER (PARTITION BY hash ORDER BY ts, name) AS h, CASE WHEN key IS NOT NULL THEN first_value(name) OVER (PARTITION BY key ORDER BY ts, name) END AS u FROM f)
SELECT name, CASE WHEN h <> name OR coalesce(u <> name, false) THEN 'duplicate' ELSE 'new' END AS outcome, CASE WHEN h <> name THEN h WHEN u <> name THEN u END AS matched FROM r""")
def batch_dedup(spark, d):
    """All events as one batch of the inbox against an empty state."""
    from libraryloom.streaming import inbox

    c = F.col
    rows = read(spark, d, "events")
    name = F.concat(F.lit("e"), "event_id", F.when(c("event_id") % 2 == 0, ".pdf").otherwise(".url"))
    key = F.when(c("event_id") % 2 == 1, F.concat(F.lit("http://ex.org/"), c("user_id") % 50))
    batch = rows.select(name.alias("name"), c("ts").cast("timestamp").alias("modified"), F.sha2(F.concat("event_type", c("user_id").cast("string")), 256).alias("hash"), key.alias("key"))
    none = spark.createDataFrame([], f"{inbox.CLAIMED}, batch int")
    return inbox.decide_batch(batch, none).select("name", "outcome", "matched")


@register("""
WITH m AS (SELECT p_partkey AS id, p_name || CASE p_partkey % 10 WHEN 4 THEN '.1.pdf' WHEN 6 THEN '' WHEN 8 THEN '.1' ELSE '.pdf' END AS name FROM part WHERE p_partkey % 2 = 0),
t AS (SELECT p_name || CASE p_size % 4 WHEN 0 THEN '.pdf' WHEN 1 THEN '.2.pdf' WHEN 2 THEN '.1.1' ELSE '.' || (p_size % 7) END AS name FROM part WHERE p_size > 25),
r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY id) - CASE WHEN name IN (SELECT name FROM t) THEN 0 ELSE 1 END AS turn, regexp_extract(name, '^(.*?)(\\.[^.]*)?$', 1) AS stem, regexp_extract(name, '^(.*?)(\\.[^.]*)?$', 2) AS ext FROM m),
free AS (SELECT name, n, row_number() OVER (PARTITION BY name ORDER BY n) AS turn FROM (SELECT name, stem, ext, unnest(range(1, max(turn) + 60)) AS n FROM r GROUP BY name, stem, ext) f
  WHERE stem || '.' || n || ext NOT IN (SELECT name FROM t UNION SELECT name FROM m))
SELECT id, r.name, CASE WHEN r.turn = 0 THEN r.name ELSE stem || '.' || n || ext END AS target FROM r LEFT JOIN free ON free.name = r.name AND free.turn = r.turn""")
def outcome_names(spark, d):
    """Each moved file with its target; names have extensions that are numbers, or none, and many files share one."""
    c = F.col
    part = read(spark, d, "part")
    last, size = c("p_partkey") % 10, c("p_size")
    moved = part.filter("p_partkey % 2 = 0").select(c("p_partkey").alias("id"), F.concat("p_name", F.when(last == 4, ".1.pdf").when(last == 6, "").when(last == 8, ".1").otherwise(".pdf")).alias("name"))
    other = F.when(size % 4 == 0, ".pdf").when(size % 4 == 1, ".2.pdf").when(size % 4 == 2, ".1.1").otherwise(F.concat(F.lit("."), size % 7))
    return intake.outcome_names(moved, part.filter("p_size > 25").select(F.concat("p_name", other).alias("name")))


@register("""
WITH r AS (SELECT p_partkey % 300 AS id, min('digest:item/' || p_size) AS via FROM part WHERE p_partkey % 3 = 0 GROUP BY 1)
SELECT 'file' AS kind, s_suppkey AS id, coalesce(via, 'manual') AS via FROM supplier LEFT JOIN r ON r.id = s_suppkey
UNION ALL SELECT 'waiting', p_partkey % 300, 'digest:item/' || p_size FROM part WHERE p_partkey % 3 = 0 AND p_partkey % 300 NOT IN (SELECT s_suppkey FROM supplier)""")
def provenance(spark, d):
    """Where incoming files were found, and the notes that wait for files that did not come."""
    files = read(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("name"))
    notes = read(spark, d, "part").filter("p_partkey % 3 = 0").select((F.col("p_partkey") % 300).cast("string").alias("name"), F.concat(F.lit("digest:item/"), "p_size").alias("discovered_via"))
    a = intake.with_provenance(files, notes).select(F.lit("file").alias("kind"), F.col("name").cast("long").alias("id"), F.col("discovered_via").alias("via"))
    return a.union(intake.unconsumed(notes, files).select(F.lit("waiting"), F.col("name").cast("long"), "discovered_via"))


@register(f"{LIB} SELECT rel_path, CASE WHEN k % 4 = 2 THEN 'http' WHEN k % 4 IN (0, 1) THEN 'server' ELSE 'none' END AS kind, CASE WHEN k % 4 = 2 THEN url ELSE 'old' END AS promoted FROM lib")
def promoted_urls(spark, d):
    u = F.col("url")
    kind = F.when(u.rlike("(?i)ex\\.org"), "http").when(u != "", "server").otherwise("none")
    return library(spark, d).select("rel_path", kind.alias("kind"), intake.promoted_url(u, F.lit("old")).alias("promoted"))


ENTRY = f"entry AS (SELECT k, rel_path, {TITLE} AS title, '10.1234/p.' || k AS doi FROM lib WHERE k % 3 = 0 AND NOT corrupt)"


@register(f"""{LIB}, {ENTRY} SELECT 'f' || k || '.pdf' AS name, rel_path, 'promote' AS verdict FROM entry WHERE k % 2 = 0 OR k % 12 = 3
UNION ALL SELECT 'v' || (k // 300) || '.pdf', rel_path, 'volume-contains' FROM entry WHERE k % 9 = 0 AND (k % 2 = 1 OR length(title) >= 12)""")
def promotions(spark, d):
    """Incoming files against published entries: by identifier, by title, some with other letters at its end, vetoed where
    the preprint's title is unlike; else as volumes that list titles in their text or, with other letters, in their outline.
    The last digit of a title is a letter here, so no title is the beginning of another and stands in volumes that have that."""
    c = F.col
    lib = library(spark, d).filter("k % 3 = 0 AND NOT corrupt")
    ended = F.concat(F.left("title", F.length("title") - 1), F.translate(F.right("title", F.lit(1)), "0123456789", "abcdefghij"))
    plain, odd = F.coalesce(ended, F.concat("slug", F.lit(".summary"))), c("k") % 2 == 1
    own = F.sha2(F.concat(F.lit("t"), c("k").cast("string")), 256)  # a title like no other
    lib = lib.withColumn("shown", F.when(odd, own).otherwise(plain)).withColumn("near", F.concat(F.left(own, F.lit(61)), F.lit("zzz")))
    title = F.when(c("k") % 12 == 9, plain).otherwise(c("shown"))
    entries = lib.select("rel_path", title.alias("title"), c("shown").alias("published_title"), F.lit("").alias("published_url"), F.concat(F.lit("https://doi.org/10.1234/P."), c("k").cast("string"), F.lit("?x=1")).alias("doi"), F.lit("").alias("published_doi"))
    none = F.array().cast("array<string>")
    doi = F.when(~odd, F.concat(F.lit("doi:10.1234/p."), c("k").cast("string"))).otherwise("")
    single = lib.select(F.concat(F.lit("f"), c("k").cast("string"), F.lit(".pdf")).alias("name"), doi.alias("doi"), F.when(odd, F.when(c("k") % 4 == 3, c("near")).otherwise(c("shown"))).otherwise("").alias("title"), F.lit(9).alias("pages"), F.lit("").alias("front"), none.alias("outline"))
    listed = lib.filter("k % 9 = 0").groupBy(F.floor(c("k") / 300).alias("v")).agg(F.array_join(F.sort_array(F.collect_list(F.when(~odd, plain))), " . ").alias("t"), F.collect_list(F.when(odd, c("near"))).alias("outline"))
    volumes = listed.select(F.concat(F.lit("v"), c("v").cast("string"), F.lit(".pdf")), F.lit(""), F.lit(""), F.lit(80), F.concat(F.lit("Proceedings  of\nthe Days. . "), "t", F.lit(" .")), "outline")
    return intake.promotions(single.union(volumes), entries)


GONE = "k % 30 = 0 AND k + 1 IN (SELECT k FROM lib)"


@register(f"{LIB}, {ENTRY} SELECT 'library' AS kind, rel_path, CASE WHEN k % 30 = 1 THEN 'https://doi.org/10.9/' || (k - 1) ELSE url END AS url FROM lib WHERE NOT ({GONE}) UNION ALL SELECT 'check', rel_path, NULL FROM lib WHERE k % 2 = 0 AND NOT ({GONE})")
def applied_promotions(spark, d):
    """The library and the cache after promotions of which some failed: a preprint whose successor did not come stays."""
    c = F.col
    lib = library(spark, d)
    checks = lib.filter("k % 2 = 0").select("rel_path", F.concat(F.lit("https://doi.org/10.9/"), c("k").cast("string")).alias("published_url"))
    entries = lib.filter("k % 15 = 0").select(F.concat(F.lit("n"), c("k").cast("string")).alias("name"), "rel_path")
    new = lib.filter("k % 15 = 1").select(F.concat(F.lit("n"), (c("k") - 1).cast("string")).alias("name"), "rel_path", (c("k") % 2 == 1).alias("ok"))
    rows, left = intake.applied_promotions(lib, checks, entries, new)
    return rows.select(F.lit("library").alias("kind"), "rel_path", "url").union(left.select(F.lit("check"), "rel_path", F.lit(None).cast("string")))


@register("SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)")
def volume_contains(spark, d):
    parts = read(spark, d, "benchmark").select(F.col("item_id").alias("part_id"), F.col("text").alias("part"))
    wholes = read(spark, d, "documents").select(F.col("doc_id").alias("whole_id"), F.col("text").alias("whole"))
    return matching.containing(parts, wholes, "[ \\n]").select(F.col("part_id").alias("item_id"), F.col("whole_id").alias("doc_id"))


# -- preprints -----------------------------------------------------------------------------------------------------------

VENUE = """CASE WHEN k % 4 = 0 THEN 'arXiv' WHEN k % 4 = 1 THEN 'SSRN' WHEN k % 8 = 0 THEN 'arXiv' WHEN k % 8 = 4 THEN 'SSRN' WHEN source_type = 'preprint' OR k % 8 = 5 THEN 'preprint' END"""
PREID = "CASE k % 4 WHEN 0 THEN '2401.' || lpad(cast(k % 100000 as string), 5, '0') WHEN 1 THEN cast(100000 + k as string) ELSE '' END"


@register(f"{LIB} SELECT rel_path, {VENUE} AS venue, {PREID} AS id FROM lib WHERE NOT corrupt AND ({VENUE}) IS NOT NULL")
def preprint_records(spark, d):
    return preprints.preprints(library(spark, d)).select("rel_path", F.col("preprint_venue").alias("venue"), F.col("preprint_id").alias("id"))


@register(f"{LIB} SELECT rel_path, k % 4 IN (0, 1) OR source_type = 'preprint' OR k % 8 IN (0, 4, 5) AS looks FROM lib")
def preprint_looks(spark, d):
    return library(spark, d).select("rel_path", preprints.looks_preprint(F.col("url"), F.col("source_type"), F.col("publication")).alias("looks"))


def checks_of(lib):
    """A cache of checks: of every second record, some of them gone, with states and times by the key."""
    c = F.col
    status = F.when(c("k") % 6 == 0, "published").when(c("k") % 6 == 2, "preprint-only").when(c("k") % 24 == 4, "error").when(c("k") % 24 == 10, "").otherwise("unknown")
    at = F.when(c("k") % 22 == 0, "").otherwise(F.concat(F.lit("2024-06-0"), c("k") % 9 + 1, F.lit("T00:00:00Z")))
    path = F.when(c("k") % 26 == 0, F.concat(F.lit("gone/"), "k")).otherwise(c("rel_path"))
    return lib.filter("k % 2 = 0").select(path.alias("rel_path"), "title", status.alias("status"), at.alias("checked_at"))


CHECKS = """checks AS (SELECT k, CASE WHEN k % 26 = 0 THEN 'gone/' || k ELSE rel_path END AS rel_path, title, CASE WHEN k % 6 = 0 THEN 'published' WHEN k % 6 = 2 THEN 'preprint-only' WHEN k % 24 = 4 THEN 'error' ELSE 'unknown' END AS status,
  CASE WHEN k % 22 = 0 THEN '' ELSE '2024-06-0' || (k % 9 + 1) || 'T00:00:00Z' END AS checked_at FROM lib WHERE k % 2 = 0)"""
FOUND = f"found AS (SELECT * FROM lib WHERE NOT corrupt AND ({VENUE}) IS NOT NULL)"


@register(f"{LIB}, {CHECKS}, {FOUND} SELECT f.rel_path, coalesce(c.checked_at >= '2024-06-04' AND c.status <> 'error', false) AS fresh FROM found f LEFT JOIN checks c ON c.rel_path = f.rel_path")
def preprints_due(spark, d):
    lib = library(spark, d)
    return preprints.due(preprints.preprints(lib), checks_of(lib), "2024-06-10 12:00:00").select("rel_path", "fresh")


@register(f"""{LIB}, {CHECKS}, {FOUND}, old AS (SELECT c.rel_path, f.title, c.status FROM checks c JOIN found f ON f.rel_path = c.rel_path WHERE f.k % 4 <> 0)
SELECT rel_path, coalesce(title, 'none') AS title, status FROM old UNION ALL SELECT rel_path, 'looked up', 'published' FROM found WHERE k % 4 = 0""")
def cache_upsert_prune(spark, d):
    """The cache after a run: looked-up entries replace old ones, the others get the record's title, those of gone records go."""
    lib = library(spark, d)
    found = preprints.preprints(lib)
    old = checks_of(lib).withColumn("title", F.when(F.col("title").isNotNull(), "stale")).withColumn("preprint_venue", F.lit("")).withColumn("preprint_id", F.lit(""))
    old = old.withColumn("status", F.when(F.col("status") == "", "unknown").otherwise(F.col("status")))
    new = found.join(lib.filter("k % 4 = 0").select("rel_path"), "rel_path", "left_semi").select("rel_path", F.lit("looked up").alias("title"), F.lit("published").alias("status"))
    return preprints.refreshed(old, new, found).select("rel_path", F.coalesce("title", F.lit("none")).alias("title"), "status")


@register(f"{LIB}, {CHECKS}, {FOUND} SELECT coalesce(c.status, 'unchecked') AS status, count(*) AS n FROM found f LEFT JOIN checks c ON c.rel_path = f.rel_path GROUP BY 1")
def status_tiles(spark, d):
    lib = library(spark, d)
    checks = checks_of(lib).withColumn("status", F.when(F.col("status") == "", "unknown").otherwise(F.col("status")))
    return preprints.buckets(preprints.preprints(lib), checks)


LOOKED = "looked AS (SELECT * FROM lib WHERE k % 4 IN (0, 1) OR source_type = 'preprint' OR k % 8 = 5)"
NEWEST = "epoch(TIMESTAMP '2024-06-10 00:00:00')"


def looked_like(lib):
    return lib.filter(preprints.looks_preprint(F.col("url"), F.col("source_type"), F.col("publication")))


@register(f"""{LIB}, {CHECKS}, {LOOKED}, v AS (
  SELECT status AS bucket, CASE status WHEN 'published' THEN 0 ELSE 1 END AS a, coalesce(title, rel_path) AS title, rel_path, CASE WHEN checked_at = '' THEN '—' ELSE (9 - k % 9) || 'd ago' END AS checked_ago FROM checks
  UNION ALL SELECT 'unchecked', 2, NULL, rel_path, NULL FROM looked WHERE rel_path NOT IN (SELECT rel_path FROM checks))
SELECT bucket, row_number() OVER (ORDER BY a, lower(coalesce(title, '')), rel_path) AS place, rel_path, title, checked_ago FROM v""")
def preprint_view(spark, d):
    lib = library(spark, d)
    return preprints.view(looked_like(lib), checks_of(lib), NOW)


@register(f"{LIB}, {CHECKS} SELECT rel_path, title, status, checked_at FROM checks")
def cache_file(spark, d):
    """The cache written as its one JSON file and read back."""
    checks = checks_of(library(spark, d)).withColumn("status", F.when(F.col("status") == "", "unknown").otherwise(F.col("status")))
    path = scratch.fresh(spark, "cache")
    source.checks_text(checks).write.text(path)
    return source.read_checks(spark, path).select("rel_path", "title", "status", "checked_at")


@register(f"{LIB}, {CHECKS} SELECT rel_path FROM checks WHERE status = 'published' AND rel_path IN (SELECT rel_path FROM lib)")
def published_entries(spark, d):
    lib = library(spark, d)
    return intake.published(checks_of(lib), lib).select("rel_path")


@register(f"""{LIB}, {CHECKS}, {LOOKED}, u AS (SELECT count(*) AS n FROM looked WHERE rel_path NOT IN (SELECT rel_path FROM checks))
SELECT count(*) + max(u.n) AS total, count(*) FILTER (status = 'published') AS published, count(*) FILTER (status = 'preprint-only') AS preprint_only, count(*) FILTER (status = 'unknown') AS unknown, count(*) FILTER (status = 'error') AS error, max(u.n) AS unchecked, max(checked_at) AS newest FROM checks, u""")
def preprint_view_stats(spark, d):
    lib = library(spark, d)
    return preprints.view_stats(looked_like(lib), checks_of(lib))


@register(f"""{LIB}, {CHECKS}, {FOUND}, n AS (SELECT * FROM found WHERE k % 5 = 0)
SELECT (SELECT count(*) FROM n) AS checked, (SELECT count(*) FROM found) - (SELECT count(*) FROM n) AS skipped, (SELECT count(*) FROM n WHERE k % 10 = 5) AS errors, (SELECT count(*) FROM n WHERE k % 10 = 0) AS found_published,
  (SELECT count(*) FROM checks WHERE rel_path NOT IN (SELECT rel_path FROM found)) AS pruned, (SELECT count(*) FROM found) AS total_preprints""")
def preprint_run_stats(spark, d):
    lib = library(spark, d)
    found = preprints.preprints(lib)
    new = found.join(lib.filter("k % 5 = 0").select("rel_path", "k"), "rel_path").select("rel_path", F.when(F.col("k") % 10 == 5, "error").otherwise("published").alias("status"))
    return preprints.run_stats(found, checks_of(lib), new)


WORK = "array<struct<title:string,display_name:string,doi:string,authorships:array<struct<author:struct<display_name:string>>>,locations:array<struct<landing_page_url:string,is_published:boolean,version:string,source:struct<type:string,display_name:string>>>>>"


@register(f"""{LIB}, {FOUND} SELECT rel_path, CASE WHEN title IS NULL THEN 'unknown' WHEN k % 16 = 12 THEN 'error' WHEN k % 16 = 8 THEN 'preprint-only' WHEN k % 16 = 4 AND k % 6 <> 0 THEN 'unknown' ELSE 'published' END AS status,
  CASE WHEN title IS NOT NULL AND k % 16 NOT IN (8, 12) AND NOT (k % 16 = 4 AND k % 6 <> 0) THEN 'high' END AS confidence, CASE WHEN title IS NOT NULL AND k % 16 NOT IN (8, 12) AND NOT (k % 16 = 4 AND k % 6 <> 0) THEN 'Rock Letters' END AS publication,
  CASE WHEN title IS NOT NULL AND k % 16 NOT IN (8, 12) AND NOT (k % 16 = 4 AND k % 6 <> 0) THEN '10.7777/r.' || k END AS published_doi FROM found""")
def preprint_checks(spark, d):
    """Recorded search results against the preprints: by identifier and author, by title, without a place, and failed."""
    c = F.col
    lib = library(spark, d)
    found = preprints.preprints(lib)
    rows = lib
    place = lambda url, published, version, kind, name: F.struct(url.alias("landing_page_url"), F.lit(published).alias("is_published"), F.lit(version).alias("version"), F.struct(F.lit(kind).alias("type"), F.lit(name).alias("display_name")).alias("source"))
    own = place(c("url"), False, "submittedVersion", "repository", "arXiv")
    shop = place(F.lit("https://books.example/x"), False, "", "ebook platform", "Book Shop")
    journal = place(F.concat(F.lit("https://doi.org/10.7777/R."), "k", F.lit("?x")), True, "publishedVersion", "journal", "Rock Letters")
    first = F.when(F.size("authors") > 0, F.element_at("authors", 1)).otherwise("Nobody Known")
    spoken = F.concat(F.lit("A. "), F.element_at(names.surnames(F.array(first)), 1))
    people = F.when(c("k") % 16 == 4, F.array(F.struct(F.struct(F.lit("Someone Else").alias("display_name")).alias("author")))).otherwise(F.array(F.struct(F.struct(spoken.alias("display_name")).alias("author"))))
    places = F.when(c("k") % 16 == 8, F.array(own)).otherwise(F.array(own, shop, journal))
    work = F.struct(c("title").alias("title"), F.lit(None).cast("string").alias("display_name"), F.lit("https://doi.org/10.48550/x").alias("doi"), people.alias("authorships"), places.alias("locations"))
    answers = rows.select("rel_path", F.when(c("k") % 16 == 12, "timeout").alias("error"), F.array(work).cast(WORK).alias("works"))
    return preprints.checked(found, answers, NOW).select("rel_path", "status", "confidence", "publication", "published_doi")


@register("""SELECT p_partkey::VARCHAR AS key, CASE WHEN p_partkey % 4 IN (0, 1) THEN '{"name":"' || p_name || '"}' END AS body,
  CASE p_partkey % 4 WHEN 2 THEN 'status 503 after 3 attempts' WHEN 3 THEN 'no response' END AS error FROM part""")
def recorded_answers(spark, d):
    """Recorded answers written as JSON lines and read back: good at once, good at the third try, too late, and none."""
    c = F.col
    k = c("p_partkey")
    body = F.concat(F.lit('{"status": 200, "body": {"name": "'), c("p_name"), F.lit('"}}'))
    late = F.lit('{"status": 503}, ')
    tries = F.when(k % 4 == 0, body).when(k % 4 == 1, F.concat(late, late, body)).when(k % 4 == 2, F.concat(late, late, late, body)).otherwise("")
    path = scratch.fresh(spark, "answers")
    read(spark, d, "part").select(F.concat(F.lit('{"key": "'), k.cast("string"), F.lit('", "responses": ['), tries, F.lit("]}")).alias("value")).write.text(path)
    return listings.recorded_responses(spark, path, 3)


@register("""
SELECT l_orderkey, arg_max(l_linenumber, (score, -l_linenumber)) AS best_line, max(score) AS score FROM (
  SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'N' THEN 3 WHEN 'A' THEN 2 ELSE 0 END + CASE l_linestatus WHEN 'F' THEN 3 ELSE 1 END + CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END AS score FROM lineitem)
GROUP BY l_orderkey
""")
def location_argmax(spark, d):
    c = F.col
    version = F.when(c("l_returnflag") == "N", "publishedVersion").when(c("l_returnflag") == "A", "acceptedVersion")
    kind = F.when(c("l_linestatus") == "F", "journal").otherwise("ebook platform")
    item = F.struct("l_linenumber", version.alias("version"), kind.alias("kind"), (c("l_discount") > 0.05).alias("flag"))
    rows = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(item)).alias("items"))
    best = matching.stable_argmax(c("items"), lambda x: identifiers.location_score(x["version"], x["kind"], x["flag"]))
    return rows.select("l_orderkey", best.alias("b")).select("l_orderkey", c("b.item.l_linenumber").alias("best_line"), "b.score")


@register("""
WITH h AS (SELECT l_orderkey, l_linenumber, l_discount >= 0.09 AS fast, round(l_quantity / 50, 2) AS score FROM lineitem)
SELECT l_orderkey, l_linenumber, fast FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY fast DESC, CASE WHEN fast THEN l_linenumber END, score DESC, l_linenumber) AS r FROM h) WHERE r = 1
""")
def first_or_better(spark, d):
    c = F.col
    hits = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (c("l_discount") >= 0.09).alias("fast"), F.round(c("l_quantity") / 50, 2).alias("score"))
    return matching.first_or_better(hits, ["l_orderkey"], "fast", "score", "l_linenumber").select("l_orderkey", "l_linenumber", "fast")


# -- runs, mirrors, changelog --------------------------------------------------------------------------------------------


@register("""
SELECT 'e' || user_id AS input_name, round(sum(CASE WHEN event_type = 'purchase' THEN round(value, 2) WHEN event_type = 'error' THEN 0.5 END), 2) AS cost, sum(CASE WHEN event_type IN ('purchase', 'error') THEN event_id END)::BIGINT AS duration_ms
FROM events WHERE event_type <> 'view' GROUP BY user_id""")
def run_rollup(spark, d):
    """Cost and time of runs from their result events, null where none was seen."""
    c = F.col
    t = c("event_type")
    kind = F.when(t == "view", "system").otherwise("result")
    total = F.when(t == "purchase", F.round("value", 2)).when(t == "error", 0.0)
    rows = read(spark, d, "events").select(F.concat(F.lit("e"), "user_id").alias("input_name"), kind.alias("type"), total.alias("total_cost_usd"), F.when(t == "error", 0.5).alias("cost_usd"), F.when(t.isin("purchase", "error"), c("event_id")).alias("duration_ms"))
    return lifecycle.run_summary(rows).select("input_name", F.round("cost_usd", 2).alias("cost"), "duration_ms")


@register("""
WITH r AS (SELECT user_id, event_id, ts, event_type <> 'error' AS ok, sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM events)
SELECT event_id, strftime(max(CASE WHEN ok THEN ts END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), '%Y-%m-%d %H:%M:%S') AS last_success, count(*) FILTER (NOT ok) OVER (PARTITION BY user_id, island ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS consecutive_failures FROM r""")
def failure_streak(spark, d):
    """Last success and failures in a row as of each run of each mirror."""
    rows = read(spark, d, "events").select("event_id", F.col("user_id").alias("mirror"), F.col("ts").alias("run_at"), (F.col("event_type") != "error").alias("ok"))
    return mirror.sync_history(rows).select("event_id", F.date_format("last_success", "yyyy-MM-dd HH:mm:ss").alias("last_success"), "consecutive_failures")


MIRROR = """a AS (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderdate < TIMESTAMP '1997-01-01' GROUP BY 1), b AS (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' GROUP BY 1),
     j AS (SELECT coalesce(a.o_custkey, b.o_custkey) AS path, CASE WHEN b.o_custkey IS NULL THEN 'deleted' WHEN a.o_custkey IS NULL THEN 'new' WHEN a.n <> b.n THEN 'changed' ELSE 'same' END AS change FROM a FULL JOIN b ON a.o_custkey = b.o_custkey)"""


def _mirror(spark, d, most):
    orders = read(spark, d, "orders")
    side = lambda cond: orders.filter(cond).groupBy(F.col("o_custkey").alias("path")).agg(F.count(F.lit(1)).alias("hash"))
    return mirror.mirror_plan(side("o_orderdate >= '1997-01-01'"), side("o_orderdate < '1997-01-01'"), most)


@register(f"WITH {MIRROR} SELECT path, change, change = 'deleted' AND (SELECT count(*) FROM j WHERE change = 'deleted') <= 25 AS remove FROM j")
def mirror_diff_guard(spark, d):
    return _mirror(spark, d, 25).select("path", "change", "remove")


@register(f"WITH {MIRROR} SELECT path, change, 'history/1/' || path AS kept FROM j WHERE change IN ('changed', 'deleted')")
def mirror_history(spark, d):
    return mirror.kept_history(_mirror(spark, d, 10**6).withColumn("path", F.col("path")), "history/1")


@register(f"WITH {MIRROR}, g AS (SELECT count(*) FILTER (change = 'deleted') AS gone, count(*) FILTER (change = 'changed') AS replaced FROM j) SELECT gone <= 25 AS ok, CASE WHEN gone <= 25 THEN gone ELSE 0 END AS mirror_deleted, replaced, CASE WHEN replaced + CASE WHEN gone <= 25 THEN gone ELSE 0 END > 0 THEN 'history/1' ELSE '' END AS history_dir, CASE WHEN gone <= 25 THEN '' ELSE gone || ' files would be deleted from the mirror (limit 25); deleted none' END AS detail FROM g")
def mirror_record(spark, d):
    return mirror.sync_record(_mirror(spark, d, 25), "history/1", NOW, 25).select("ok", "mirror_deleted", "replaced", "history_dir", "detail")


PATHS = "p AS (SELECT o_custkey AS c, CASE WHEN o_orderkey % 40 = 0 THEN 'triage/README.md' WHEN o_orderkey % 15 = 0 THEN 'INDEX.md' ELSE 'triage/r' || o_orderkey || '.md' END AS path FROM orders)"


def _commits(spark, d):
    k = F.col("o_orderkey")
    path = F.when(k % 40 == 0, "triage/README.md").when(k % 15 == 0, "INDEX.md").otherwise(F.concat(F.lit("triage/r"), k, F.lit(".md")))
    return read(spark, d, "orders").select(F.col("o_custkey").alias("commit"), path.alias("path"))


@register(f"WITH {PATHS} SELECT c AS \"commit\", bool_and(starts_with(path, 'triage/r')) AS only_reports, count(*) AS paths FROM p GROUP BY c")
def report_commits(spark, d):
    return mirror.report_commits(_commits(spark, d))


@register(f"WITH {PATHS}, g AS (SELECT c, bool_and(starts_with(path, 'triage/r')) AS o FROM p WHERE c % 2 = 0 GROUP BY c) SELECT coalesce(bool_and(o), true) AS may_push, count(*) AS ahead FROM g")
def push_guard(spark, d):
    return mirror.may_push(_commits(spark, d).filter("commit % 2 = 0"))


@register(f"WITH {PATHS} SELECT DISTINCT path, CASE WHEN path IN (SELECT path FROM p WHERE c % 3 = 0) THEN 'changed' ELSE 'new' END AS kind FROM p WHERE c % 2 = 0 AND starts_with(path, 'triage/r')")
def report_changes(spark, d):
    paths = _commits(spark, d)
    return mirror.report_changes(paths.filter("commit % 2 = 0"), paths.filter("commit % 3 = 0"))


@register("""
WITH e AS (SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, event_type || ' ' || user_id AS t FROM events),
r AS (SELECT day, NULL::BIGINT AS seq, '## ' || day || CASE WHEN day = (SELECT max(day) FROM e) THEN ' (latest)' ELSE '' END AS line FROM (SELECT DISTINCT day FROM e) UNION ALL SELECT day, event_id, '- ' || t FROM e)
SELECT row_number() OVER (ORDER BY day DESC, seq DESC NULLS FIRST) AS place, line FROM r""")
def changelog_latest(spark, d):
    rows = read(spark, d, "events").select(F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("seq"), F.concat("event_type", F.lit(" "), F.col("user_id").cast("string")).alias("text"))
    return lifecycle.changelog(rows)


@register("SELECT 'run-' || o_orderkey AS name FROM orders QUALIFY row_number() OVER (ORDER BY 'run-' || o_orderkey DESC) > 50")
def expired_archives(spark, d):
    return lifecycle.expired(read(spark, d, "orders").select(F.concat(F.lit("run-"), "o_orderkey").alias("name")), 50)


EVENT = """CASE event_type WHEN 'click' THEN ['▶', 'started: f' || user_id] WHEN 'error' THEN ['❌', 'error (1.5s, $0.250)'] WHEN 'purchase' THEN ['✏️', 'Edit /a/' || user_id]
  WHEN 'signup' THEN ['🔍', 'Grep ''x' || user_id || ''' in .'] ELSE ['?', 'view ' || user_id] END"""


@register(f"SELECT event_id AS line, e[1] AS icon, e[2] AS text FROM (SELECT event_id, {EVENT} AS e FROM events)")
def event_parse(spark, d):
    """Lines of a run log, one of each kind by the type of event."""
    c = F.col
    t, u = c("event_type"), c("user_id").cast("string")
    call = lambda name, key, value: F.concat(F.lit('{"type": "assistant", "message": {"content": [{"type": "tool_use", "name": "' + name + '", "input": {"' + key + '": "'), value, F.lit('"}}]}}'))
    line = (
        F.when(t == "click", F.concat(F.lit('{"type": "meta", "kind": "start", "input": "f'), u, F.lit('"}')))
        .when(t == "error", F.lit('{"type": "result", "subtype": "error", "duration_ms": 1500, "total_cost_usd": 0, "cost_usd": 0.25}'))
        .when(t == "purchase", call("Edit", "file_path", F.concat(F.lit("/a/"), u))).when(t == "signup", call("Grep", "pattern", F.concat(F.lit("x"), u))).otherwise(F.concat(F.lit("view "), u))
    )
    return source.events(read(spark, d, "events").select(c("event_id").alias("line"), line.alias("value")))


@register("SELECT event_type || ' ' || event_id AS last FROM events WHERE event_type <> 'view' ORDER BY ts DESC, event_id DESC LIMIT 1")
def last_log_line(spark, d):
    text = F.when(F.col("event_type") == "view", "  ").otherwise(F.concat("event_type", F.lit(" "), "event_id"))
    return source.last_line(read(spark, d, "events").select(F.struct("ts", "event_id").alias("line"), text.alias("value")))


@register("SELECT round(sum(CASE WHEN event_type = 'purchase' THEN value ELSE 0 END) FILTER (place <= 20), 4) AS recent_cost, count(*) FILTER (place <= 20) AS runs, (SELECT count(*) FROM supplier) AS inbox, (SELECT count(*) FROM part WHERE p_size > 10) AS in_flight, (SELECT count(*) FROM part WHERE p_size <= 10) AS stray, (SELECT count(*) FROM nation) AS failed, (SELECT count(*) FROM region) AS duplicate FROM (SELECT *, row_number() OVER (ORDER BY ts DESC, event_id DESC) AS place FROM events)")
def status_payload(spark, d):
    w = matching.Window.orderBy(F.desc("ts"), F.desc("event_id"))
    last = read(spark, d, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(100)
    runs = last.select(F.row_number().over(w).alias("place"), F.when(F.col("event_type") == "purchase", F.col("value")).alias("cost_usd"))
    staged = read(spark, d, "part").select((F.col("p_size") > 10).alias("in_flight"))
    out = listings.status_payload(runs, read(spark, d, "supplier"), staged, read(spark, d, "nation"), read(spark, d, "region"))
    return out.withColumn("recent_cost", F.round("recent_cost", 4))


@register(f"{LIB} SELECT rel_path FROM lib WHERE k % 20 > 11")
def produced_files(spark, d):
    """Records that were written after a run began."""
    at = F.timestamp_seconds(F.lit(1_717_200_000) + F.col("k") % 20)
    return intake.produced_since(library(spark, d).withColumn("modified", at), "2024-06-01 00:00:11").select("rel_path")


@register(f"{LIB}, r AS (SELECT *, row_number() OVER (PARTITION BY k // 1000 ORDER BY k) AS place FROM lib) SELECT place, folder || '/' || slug AS key, 'Cite ' || k AS short_cite, '3.1, A.' || k AS cited_in FROM r")
def reference_blocks(spark, d):
    """Markdown files of references, one for each thousand records, written and read back; places are places in a file."""
    c = F.col
    block = F.concat(F.lit("### Cite "), "k", F.lit("\n**Library path:** `library/"), "folder", F.lit("/"), "slug", F.lit("/`\n**Cited in:** §3.1 and A."), "k", F.lit("\n"))
    rows = library(spark, d).groupBy(F.floor(c("k") / 1000).alias("book")).agg(F.sort_array(F.collect_list(F.struct("k", block.alias("b")))).alias("e"))
    path = scratch.fresh(spark, "references")
    rows.select("book", F.concat(F.lit("# References\n"), F.array_join("e.b", "")).alias("value")).write.partitionBy("book").text(path)
    return source.read_references(spark, path).select(c("place").cast("long").alias("place"), "key", "short_cite", joined(c("cited_in"), ", ").alias("cited_in"))


# -- lifecycle and console -----------------------------------------------------------------------------------------------


@register(f"""{LIB}, refs AS (SELECT k, k * 2 AS place, folder || '/' || slug AS key, 'Cite ' || k AS cite FROM lib WHERE k % 4 = 0 OR k % 7 = 1)
SELECT folder || '--' || lib.slug AS key, lib.rel_path, {STATUS} AS status, CASE WHEN (lib.k % 4 = 0 OR lib.k % 7 = 1) AND lib.k % 5 = 1 OR lib.k % 3 = 1 THEN 'review-citations' ELSE 'no-effect' END AS verdict, CASE WHEN lib.k % 4 = 0 OR lib.k % 7 = 1 THEN 'Cite ' || lib.k END AS short_cite,
  CASE WHEN (lib.k % 4 = 0 OR lib.k % 7 = 1) AND lib.k % 5 = 1 THEN '3.1, A.2' ELSE '' END AS cited_in, CASE WHEN lib.k % 3 = 1 THEN 's' || (lib.k % 10) || '.md' ELSE '' END AS files, CASE WHEN superseded_by IN ('', 'null') THEN '' ELSE superseded_by END AS successor, s.cite AS successor_cite
FROM lib LEFT JOIN refs s ON superseded_by = 'p' || s.k WHERE (lower(status) IN ('superseded', 'retracted', 'withdrawn') OR status = '' AND superseded_by NOT IN ('', 'null')) AND lib.k % 12 <> 2""")
def retirement_triage(spark, d):
    c = F.col
    lib = library(spark, d)
    key = F.concat("folder", F.lit("/"), "slug")
    cited = F.when(c("k") % 5 == 1, text.section_ids(F.lit("see 3.1 and A.2"))).otherwise(F.array().cast("array<string>"))
    references = lib.filter("k % 4 = 0 OR k % 7 = 1").select((c("k") * 2).cast("int").alias("place"), key.alias("key"), F.concat(F.lit("Cite "), "k").alias("short_cite"), cited.alias("cited_in"))
    sections = lib.filter("k % 3 = 1").select(F.concat(F.lit("s"), c("k") % 10, F.lit(".md")).alias("file"), key.alias("key"))
    existing = lib.filter("k % 12 = 2").select(F.concat("folder", F.lit("--"), "slug").alias("key"))
    out = lifecycle.retirement_reports(lib, references, sections, existing)
    return out.withColumn("cited_in", joined(c("cited_in"), ", ")).withColumn("files", joined(c("files"), ", "))


@register(f"{LIB} SELECT rel_path, {STATUS} AS status, lower(status) IN ('superseded', 'retracted', 'withdrawn') OR status = '' AND superseded_by NOT IN ('', 'null') AS retired FROM lib")
def lifecycle_states(spark, d):
    a, b = F.col("status"), F.col("superseded_by")
    return library(spark, d).select("rel_path", measures.status(a, b).alias("status"), measures.is_retired(a, b).alias("retired"))


@register("""
SELECT o_orderpriority AS task, cadence, age_days, coalesce(age_days > CASE cadence WHEN 'weekly' THEN 7 WHEN 'monthly' THEN 31 WHEN 'quarterly' THEN 92 END, false) AS due FROM (
  SELECT o_orderpriority, CASE left(o_orderpriority, 1) WHEN '1' THEN 'weekly' WHEN '2' THEN 'monthly' WHEN '3' THEN 'quarterly' ELSE 'event' END AS cadence,
    date_diff('day', max(CAST(o_orderdate AS DATE)), DATE '1998-10-01') AS age_days FROM orders GROUP BY o_orderpriority)
""")
def cadence_due(spark, d):
    c = F.col
    first = F.left(c("o_orderpriority"), F.lit(1))
    cadence = F.when(first == "1", "weekly").when(first == "2", "monthly").when(first == "3", "quarterly").otherwise("event")
    orders = read(spark, d, "orders")
    tasks = orders.select(c("o_orderpriority").alias("task"), cadence.alias("cadence"), F.concat(F.lit("t/"), first, F.lit("/")).alias("path")).distinct()
    commits = orders.select(c("o_orderdate").cast("timestamp").alias("at"), F.concat(F.lit("t/"), first, F.lit("/o"), c("o_orderkey").cast("string")).alias("path"))
    return lifecycle.rhythm(lifecycle.last_done(commits, tasks), "1998-10-01").select("task", "cadence", "age_days", "due")


ITEMS = "items AS (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'item' ELSE 'scout' END AS kind, event_id // 2 AS id, ts, event_id % 3 <> 0 AS open, CASE event_type WHEN 'click' THEN 'flagged' WHEN 'view' THEN 'downloaded' WHEN 'purchase' THEN 'added' WHEN 'error' THEN 'dismissed' ELSE 'odd' END AS s FROM events)"


def _items(spark, d):
    c = F.col
    t = c("event_type")
    status = F.when(t == "click", "flagged").when(t == "view", "downloaded").when(t == "purchase", "added").when(t == "error", "dismissed").otherwise("odd")
    at = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    return read(spark, d, "events").select(F.when(c("event_id") % 2 == 0, "item").otherwise("scout").alias("kind"), F.expr("event_id div 2").alias("id"), F.when(c("event_id") % 17 == 0, "unreadable").otherwise(at).alias("ts"), (c("event_id") % 3 != 0).alias("open"), status.alias("library_status"), F.when(c("event_id") % 5 != 0, F.date_format("ts", "yyyy-MM-dd")).alias("library_reviewed_at"))


@register(f"""{LIB}, {ITEMS} SELECT count(*) FILTER (open AND s = 'flagged') AS flagged, count(*) FILTER (open AND s = 'downloaded') AS downloaded, count(*) FILTER (event_id % 17 <> 0 AND date_trunc('second', ts) >= TIMESTAMP '2024-01-23') AS flagged_this_week,
  count(*) FILTER (s = 'added' AND event_id % 5 <> 0 AND CAST(ts AS DATE) > DATE '2024-01-10') AS added, count(DISTINCT CASE WHEN s = 'dismissed' AND event_id % 5 <> 0 AND CAST(ts AS DATE) > DATE '2024-01-10' THEN CAST(ts AS DATE) END) AS dismissed,
  count(*) FILTER (open AND s = 'downloaded' AND 'digest:' || kind || '/' || id IN (SELECT discovered_via FROM lib)) AS landed,
  count(*) FILTER (s = 'added' AND event_id % 5 <> 0 AND CAST(ts AS DATE) > DATE '2024-01-10') >= 5 AND count(DISTINCT CASE WHEN s = 'dismissed' AND event_id % 5 <> 0 AND CAST(ts AS DATE) > DATE '2024-01-10' THEN CAST(ts AS DATE) END) >= 20 AS ready FROM items""")
def labels_since(spark, d):
    return lifecycle.digest_signals(_items(spark, d), library(spark, d), "2024-01-30", "2024-01-10").drop("error")


@register(f"{LIB}, {ITEMS} SELECT kind, id FROM items WHERE s = 'downloaded' AND 'digest:' || kind || '/' || id IN (SELECT discovered_via FROM lib)")
def provenance_semi(spark, d):
    return lifecycle.landed(_items(spark, d), library(spark, d)).select("kind", "id")


@register(f"WITH {ITEMS} SELECT kind, id FROM items WHERE open AND s = 'flagged' ORDER BY CASE WHEN event_id % 17 = 0 THEN 'unreadable' ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S') END, kind, id LIMIT 5")
def oldest_open(spark, d):
    return lifecycle.oldest_open(_items(spark, d)).select("kind", "id")


@register("""
WITH s AS (SELECT user_id, max(CASE WHEN event_type <> 'error' THEN date_trunc('second', ts) END) AS last, arg_max(event_type, (ts, event_id)) AS t FROM events GROUP BY user_id),
a AS (SELECT user_id, t, round((epoch(TIMESTAMP '2024-01-31') - epoch(last)) / 3600, 1) AS age_hours FROM s)
SELECT user_id, age_hours, age_hours IS NULL OR age_hours > 36 OR t = 'error' AS stale FROM a""")
def backup_ages(spark, d):
    c = F.col
    ok = c("event_type") != "error"
    status = read(spark, d, "events").groupBy("user_id").agg(F.date_format(F.max(F.when(ok, c("ts"))), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("last_success"), F.max_by("event_type", F.struct("ts", "event_id")).alias("t"))
    status = status.withColumn("outcome", F.when(c("t") == "error", "failed").otherwise("ok"))
    return lifecycle.backup_age(status, "2024-01-31").select("user_id", "age_hours", "stale")


def _signals(spark, d):
    """Signals of a health report from documents: each source of text stands for one kind of finding."""
    c = F.col
    kind = F.when(c("source") == "src0", "triage_proposed").when(c("source") == "src1", "triage_approved").when(c("source") == "src2", "cites_inactive_source").when(c("source").isin("src3", "src4"), "synthesis_drift").when(c("source") == "src5", "unaudited_sources").when(c("source") == "src6", "sections_overdue")
    entry = F.concat(F.when(c("source") == "src3", "derived/").otherwise(""), F.lpad(c("doc_id").cast("string"), 7, "0"))
    rows = read(spark, d, "documents").select(kind.alias("signal"), entry.alias("entry"), "doc_id", "source").filter("signal IS NOT NULL")
    late = rows.filter("source = 'src0' AND doc_id % 3 = 0").select(F.lit("triage_stale"), "entry")
    return rows.select("signal", "entry").union(late)


def _cards(spark, d):
    digest = spark.createDataFrame([(0, 0, 6, 25, None)], "flagged int, landed int, added int, dismissed int, error string")
    backups = spark.createDataFrame([("ok", 12.0, 3, 0, "ok", 80.04, None)], "outcome string, age_hours double, uncommitted int, unpushed int, sync_outcome string, sync_age_hours double, error string")
    c = F.col
    own = F.lpad(c("doc_id").cast("string"), 7, "0")
    file = F.when(c("source").isin("src2", "src4"), own).otherwise(F.concat(F.lit("docs/"), (c("doc_id") % 40).cast("string"), F.lit("-"), own))
    gate = read(spark, d, "documents").filter("doc_id % 2 = 0").select(file.alias("file"), (c("doc_id") % 6 == 0).alias("done"))
    return lifecycle.cards(_signals(spark, d), digest, backups, gate, NOW)


_ALL = "coalesce(array_to_string(list_sort(list(entry) FILTER (entry IS NOT NULL)), '; '), '')"
CARDS = f"""
WITH s AS (SELECT source, doc_id, CASE source WHEN 'src3' THEN 'derived/' ELSE '' END || lpad(doc_id::VARCHAR, 7, '0') || CASE WHEN source = 'src0' AND doc_id % 3 = 0 THEN ' · over 14 days' ELSE '' END AS entry FROM documents),
cards AS (SELECT * FROM (VALUES (5, 'triage', 'src0'), (6, 'triage-approved', 'src1'), (7, 'retired-cites', 'src2'), (8, 'drift-guides', 'src3'), (9, 'drift-sections', 'src4'), (10, 'unaudited', 'src5'), (11, 'currency', 'none'), (12, 'overdue', 'src6')) v(place, key, source)),
listed AS (SELECT place, key, entry, count(entry) OVER (PARTITION BY place) AS n FROM cards LEFT JOIN s ON s.source = cards.source),
g AS (SELECT CASE WHEN source IN ('src2', 'src4') THEN '' ELSE 'docs/' || (doc_id % 40) || '-' END || lpad(doc_id::VARCHAR, 7, '0') AS entry, CASE WHEN source IN ('src2', 'src4') THEN 0 WHEN doc_id % 40 BETWEEN 10 AND 29 THEN 1 ELSE 2 END AS p FROM documents WHERE doc_id % 2 = 0 AND doc_id % 6 <> 0),
q AS (SELECT entry, row_number() OVER (ORDER BY p, entry) AS r, count(*) OVER () AS n FROM g),
every AS (SELECT place, key, CASE WHEN max(n) > 0 THEN 'warn' ELSE 'ok' END AS severity, max(n)::VARCHAR AS count, {_ALL} AS entries FROM listed GROUP BY place, key
  UNION ALL SELECT 20, 'gate-c', 'warn', (SELECT count(*) FILTER (doc_id % 6 = 0) || '/' || count(*) FROM documents WHERE doc_id % 2 = 0), array_to_string(list(entry ORDER BY r) FILTER (r <= 8) || CASE WHEN max(n) > 8 THEN ['…and ' || (max(n) - 8) || ' more'] ELSE [] END, '; ') FROM q
  UNION ALL SELECT * FROM (VALUES (0, 'backup-digest', 'ok', '12.0h', ''), (1, 'backup-library', 'bad', '3', ''), (2, 'digest-flags', 'ok', '0', ''), (3, 'recalibrate', 'warn', '6/25', '')) v)"""


@register(f"{CARDS} SELECT place::INTEGER AS place, key, severity, count, entries FROM every")
def topn_overflow(spark, d):
    """The console's cards with their first entries and how many more there are."""
    return _cards(spark, d).select("place", "key", "severity", "count", joined(F.col("entries")).alias("entries"))


@register(f"{CARDS} SELECT count(*) FILTER (severity <> 'ok') AS need, count(*) FILTER (severity = 'bad') AS urgent FROM every")
def console_attention(spark, d):
    return lifecycle.attention(_cards(spark, d))


@register(f"{CARDS} SELECT CASE WHEN count(*) FILTER (severity <> 'ok') = 0 THEN 'Nothing needs you this week.' ELSE count(*) FILTER (severity <> 'ok') || ' item(s) need you' || CASE WHEN count(*) FILTER (severity = 'bad') > 0 THEN ', ' || count(*) FILTER (severity = 'bad') || ' urgent' ELSE '' END || ' — open http://c' END AS message FROM every")
def console_notification(spark, d):
    return lifecycle.notification(_cards(spark, d), "http://c")


TITLES = "CASE key " + " ".join(f"WHEN '{k}' THEN '{t}'" for k, t in [*lifecycle.OTHER_TITLES.items(), *((k, t) for k, t, _ in lifecycle.LIST_CARDS)]) + " END"


@register(f"""{CARDS}, l AS (SELECT 0 AS a, 0 AS b, 'Currency console — {TODAY}' AS line UNION ALL SELECT 0, 1, 'http://c' UNION ALL SELECT 0, 2, '' UNION ALL SELECT 1, CASE severity WHEN 'bad' THEN 0 ELSE 1000 END + place, '[' || upper(severity) || '] ' || {TITLES} || ': ' || count FROM every WHERE severity <> 'ok'
  UNION ALL SELECT 2, 0, '' UNION ALL SELECT 2, 1, 'Overdue routines: scan, sweep') SELECT row_number() OVER (ORDER BY a, b) AS place, line FROM l""")
def console_text(spark, d):
    tasks = spark.createDataFrame([(2, "sweep", "weekly", "2024-05-01"), (1, "scan", "monthly", "2024-01-01"), (3, "rest", "quarterly", "2024-06-01")], "place int, task string, cadence string, last string")
    return lifecycle.summary_text(_cards(spark, d), lifecycle.rhythm(tasks, NOW), TODAY, "http://c")


# -- texts, names, identifiers -------------------------------------------------------------------------------------------


@register(f"{LIB} SELECT rel_path, {BYLINE} AS byline, CASE k % 6 WHEN 0 THEN 'unattributed' WHEN 3 THEN 'Ann Lee' WHEN 4 THEN 'Stone et al.' WHEN 5 THEN 'Lee, et al.' ELSE {BYLINE} END AS short, CASE k % 6 WHEN 0 THEN '' WHEN 1 THEN 'stone' WHEN 2 THEN 'gao, hill' WHEN 3 THEN 'lee' WHEN 4 THEN 'stone, hill, institute, lee, moss' ELSE 'lee, al.' END AS surnames FROM lib")
def authors_et_al(spark, d):
    a = F.col("authors")
    return library(spark, d).select("rel_path", names.byline(a).alias("byline"), names.changelog_byline(a).alias("short"), joined(names.surnames(a), ", ").alias("surnames"))


@register(f"{LIB}, a AS (SELECT DISTINCT unnest(authors) AS author FROM lib) SELECT author, author = 'Ann Lee' AS person, author = 'et al.' AS placeholder, author IN ('GAO', 'Rock Institute') AS institution FROM a")
def author_kinds(spark, d):
    a = F.col("author")
    rows = library(spark, d).select(F.explode("authors").alias("author")).distinct()
    return rows.select("author", names.looks_like_person(a).alias("person"), names.is_placeholder(a).alias("placeholder"), names.is_institution(a).alias("institution"))


@register(r"""
SELECT p_partkey, lower(replace(p_name, ' ', '-')) || '-' || p_partkey || '.v2' AS kebab, p_name || ' ' || p_brand AS search, 'a\|' || p_name || ' b' AS cell, p_size || '.1, B.' || p_size || ', 3' AS sections, 'log_' || replace(p_name, ' ', '_') || '_.x-1' AS safe,
  p_name || '.pdf' AS unstaged, right(p_name, 5) AS tail, left(p_name, 6) || '…' AS snippet, '"' || p_name || ' \"q\" \\ "' AS json, '"' || p_name || ' q  "' AS yaml FROM part""")
def text_functions(spark, d):
    n = F.col("p_name")
    size = F.col("p_size").cast("string")
    staged = F.concat(F.lit("123e4567-e89b-12d3-a456-4266141740aF_"), n, F.lit(".pdf"))
    return read(spark, d, "part").select(
        "p_partkey", text.kebab(F.concat(F.lit("-"), n, F.lit("  "), F.col("p_partkey").cast("string"), F.lit(".V2!."))).alias("kebab"), text.search_text(F.concat(F.lit(" ?"), n, F.lit("|*  "), F.col("p_brand"))).alias("search"),
        text.escape_cell(F.concat(F.lit("a|"), n, F.lit("\nb"))).alias("cell"), joined(text.section_ids(F.concat(F.lit("see "), size, F.lit(".1 or §B."), size, F.lit("; c.3"))), ", ").alias("sections"),
        text.safe_log_name(F.concat(F.lit("log/"), n, F.lit("é.x-1"))).alias("safe"), text.without_upload_prefix(staged).alias("unstaged"), text.tail(n, 5).alias("tail"), text.snippet(F.concat(n, F.lit("......")), 6).alias("snippet"),
        text.json_string(F.concat(n, F.lit("\x01 \"q\" \\ "))).alias("json"), text.yaml_string(F.concat(n, F.lit(" \"q\" \\ "))).alias("yaml"),
    )


@register("SELECT doc_id, regexp_replace(strip_accents(coalesce(text, '')), '[^\\x00-\\x7F]', '_', 'g') AS folded FROM documents")
def folded_names(spark, d):
    return read(spark, d, "documents").select("doc_id", text.ascii_fold(F.coalesce("text", F.lit(""))).alias("folded"))


@register("""
SELECT o_orderkey, '10.' || (1000 + o_custkey) || '/ab.' || o_orderkey AS doi, CASE WHEN o_orderkey % 2 = 0 THEN '24' || lpad((o_orderkey % 12 + 1)::VARCHAR, 2, '0') || '.' || lpad((o_orderkey % 100000)::VARCHAR, 5, '0') ELSE 'cs.cl/' || lpad((o_orderkey % 10000000)::VARCHAR, 7, '0') END AS arxiv, (o_orderkey + 7)::VARCHAR AS ssrn,
  CASE WHEN o_totalprice > 400000 OR o_orderkey % 5 = 0 THEN 'high' WHEN o_totalprice > 300000 THEN 'medium' ELSE 'low' END AS band, o_orderkey % 3 <> 2 AS server, o_orderkey % 4 = 0 AS full_date, o_orderkey % 4 <> 3 AS partial_date FROM orders""")
def identifier_functions(spark, d):
    c = F.col
    k = c("o_orderkey")
    s = k.cast("string")
    doi = F.concat(F.lit("See https://doi.org/10."), (c("o_custkey") + 1000).cast("string"), F.lit("/Ab."), s, F.lit(").,"))
    arxiv = F.when(k % 2 == 0, F.concat(F.lit("http://arxiv.org/pdf/24"), F.lpad((k % 12 + 1).cast("string"), 2, "0"), F.lit("."), F.lpad((k % 100000).cast("string"), 5, "0"), F.lit("v3.pdf"))).otherwise(F.concat(F.lit("https://arxiv.org/abs/cs.cl/"), F.lpad((k % 10000000).cast("string"), 7, "0")))
    score = F.when(c("o_totalprice") > 400000, 0.97).when(c("o_totalprice") > 300000, 0.9).otherwise(0.89)
    kind = F.when(k % 3 == 0, "Repository").otherwise("journal")
    page = F.when(k % 3 == 1, "https://www.bioRxiv.org/x").otherwise("https://journal.example/y")
    date = F.when(k % 4 == 0, "2024-01-02").when(k % 4 == 1, "2024-01").when(k % 4 == 2, "2024").otherwise("May 2024")
    return read(spark, d, "orders").select(
        "o_orderkey", identifiers.doi_in(doi).alias("doi"), identifiers.arxiv_id(arxiv).alias("arxiv"), identifiers.ssrn_id(F.concat(F.lit("https://ssrn.com/abstract="), (k + 7).cast("string"))).alias("ssrn"),
        identifiers.confidence(k % 5 == 0, score).alias("band"), identifiers.is_preprint_location(kind, page).alias("server"), measures.is_full_date(date).alias("full_date"), measures.is_partial_date(date).alias("partial_date"),
    )


@register("SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'pdf' WHEN 1 THEN 'note' WHEN 2 THEN 'page' ELSE 'link' END AS kind, url AS first, page_id % 2 = 0 AS local, page_id % 3 = 0 AS crossed FROM pages")
def page_predicates(spark, d):
    c = F.col
    k = c("page_id")
    name = F.when(k % 4 == 1, "a.MD").when(k % 4 == 2, "b.html").otherwise("c.url")
    body = F.when(k % 4 == 0, F.lit("%PDF-1.7")).otherwise(F.lit("%PD"))
    asked = F.when(k % 2 == 0, "LOCALHOST:8080").otherwise("evil.example")
    origin = F.when(k % 3 == 0, "http://other.example").when(k % 3 == 1, F.concat(F.lit("http://"), asked)).otherwise("")
    return read(spark, d, "pages").select("page_id", text.file_kind(name, body.cast("binary")).alias("kind"), urls.first_url(F.concat(F.lit("see\n"), c("url"), F.lit(").,\nhttp://x"))).alias("first"), urls.is_local_request(asked).alias("local"), urls.is_cross_origin(origin, asked).alias("crossed"))


@register("""
SELECT p_partkey, 'p' || p_partkey || '.md' AS name, (u.i + 1)::BIGINT AS place, CASE u.i WHEN 0 THEN 'arxiv-2401.' || lpad((p_partkey % 100000)::VARCHAR, 5, '0') WHEN 1 THEN lower(replace(p_name, ' ', '-')) ELSE 'candidate-4' END AS slug,
  CASE u.i WHEN 0 THEN 'https://arxiv.org/pdf/2401.' || lpad((p_partkey % 100000)::VARCHAR, 5, '0') WHEN 1 THEN 'https://x.org/' || p_partkey ELSE 'https://x.org/' END AS url FROM part, (SELECT unnest([0, 1, 3]) AS i) u WHERE p_partkey % 3 <> 0""")
def manifest_explode(spark, d):
    """The fetchable entries of candidate notes; other notes have none."""
    c = F.col
    k = c("p_partkey").cast("string")
    status = F.when(c("p_partkey") % 3 == 0, "other").otherwise("candidate-for-intake")
    entries = F.concat(F.lit("  - https://arxiv.org/pdf/2401."), F.lpad((c("p_partkey") % 100000).cast("string"), 5, "0"), F.lit("\n  - {slug: "), c("p_name"), F.lit(", url: 'https://x.org/"), k, F.lit("'}\n  - {url: ftp://x}\n  - https://x.org/\n"))
    body = F.concat(F.lit("---\nstatus: "), status, F.lit("\nsources:\n"), entries, F.lit("\n---\n"))
    out = source.candidate_targets(read(spark, d, "part").select(F.concat(F.lit("p"), k, F.lit(".md")).alias("name"), body.alias("body")))
    return out.select(F.regexp_extract("name", "[0-9]+", 0).cast("long").alias("p_partkey"), "name", c("place").cast("long").alias("place"), "slug", "url")


@register("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'https://x.org/' || p_partkey || '.pdf' WHEN 1 THEN 'https://x.org/' || p_partkey WHEN 2 THEN 'NONE' END AS url FROM part")
def note_urls(spark, d):
    c = F.col
    k = c("p_partkey")
    s = k.cast("string")
    fields = F.when(k % 4 == 0, F.concat(F.lit("url: https://x.org/a\npdf_url: \"https://x.org/"), s, F.lit('.pdf"'))).when(k % 4 == 1, F.concat(F.lit("url: https://x.org/"), s)).otherwise("url: ftp://x.org/")
    body = F.concat(F.lit("---\nstatus: "), F.when(k % 4 == 3, "draft").otherwise("candidate-for-intake"), F.lit("\n"), fields, F.lit("\n---\ntext\n"))
    return read(spark, d, "part").select("p_partkey", source.note_url(body).alias("url"))


@register("SELECT l_orderkey * 10 + l_linenumber AS id, CASE WHEN l_linenumber % 2 = 1 THEN 'pdf' ELSE 'snapshot' END AS kind FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber % 2 DESC, l_linenumber) = 1")
def sidecar_priority(spark, d):
    c = F.col
    found = read(spark, d, "lineitem").select(c("l_orderkey").cast("string").alias("rel_path"), F.when(c("l_linenumber") % 2 == 1, 1).otherwise(2).alias("rank"), F.lpad((c("l_orderkey") * 10 + c("l_linenumber")).cast("string"), 12, "0").alias("original_hash"))
    return source.best_original(found).select(c("original_hash").cast("long").alias("id"), c("original_kind").alias("kind"))


@register("SELECT row_number() OVER (ORDER BY ts DESC, event_id DESC) AS place, event_type || event_id AS input_name, CASE WHEN event_type = 'error' THEN 'failure' ELSE 'success' END AS outcome, 'a/' || event_id AS path FROM events ORDER BY ts DESC, event_id DESC LIMIT 20")
def recent_runs(spark, d):
    """Runs written to a log of JSON lines and read back, the newest first, with paths below the library."""
    c = F.col
    rows = read(spark, d, "events").select(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("ts"), F.concat("event_type", "event_id").alias("input_name"), F.when(c("event_type") == "error", "failure").otherwise("success").alias("outcome"),
        F.array(F.concat(F.lit("/library/a/"), "event_id")).alias("output_paths"), F.lit("e" * 3000).alias("error_excerpt"), c("value").alias("cost_usd"), c("event_id").alias("duration_ms"),
    )
    path = scratch.fresh(spark, "runs")
    source.append_runs(rows, path)
    return source.read_runs(spark, path, 20, "/library").select(c("place").cast("long").alias("place"), "input_name", "outcome", F.element_at("output_paths", 1).alias("path"))


def title_similarity(spark, d):
    """Longest-blocks similarity of neighbouring titles; SQL has no such function, pytest holds it against difflib."""
    rows = read(spark, d, "part").select("p_partkey", "p_name", F.reverse("p_name").alias("other"))
    score = similarity.title_similarity(F.col("p_name"), F.col("other"))
    return rows.select("p_partkey", F.round(score, 6).alias("score"))


def fuzzy_backfill(spark, d):
    """Incoming files with names like the titles of records without an original; pytest holds it against a plain loop.

    A search: a file's number is its part's key plus 2, and the queries are the files whose number is divisible by 20, against
    all records.
    """
    c = F.col
    lib = library(spark, d)
    stem = F.concat("p_name", F.lit("-"), c("p_partkey").cast("string"), F.lit(" copy"))
    files = read(spark, d, "part").filter("(p_partkey + 2) % 20 = 0").select(F.concat(F.lit("i"), "p_partkey", F.lit(".pdf")).alias("name"), F.lit("").alias("hash"), F.lit("").alias("url"), stem.alias("stem"), F.lit("").alias("meta_title"), F.lit("").alias("first_page"))
    return intake.decide(files, lib)


QUERIES |= {"title_similarity": title_similarity, "fuzzy_backfill": fuzzy_backfill}
