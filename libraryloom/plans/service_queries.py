"""Recovery after a failed run and recorded answers of services, on the driver's tables, beside their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from libraryloom.operators import recovery
from libraryloom.plans.register import read, register
from libraryloom.sources import lookups as service

STAGED_SQL = "^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}-"


@register(f"""
WITH s AS (SELECT lpad(o_orderkey::VARCHAR, 8, '0') || CASE o_orderkey % 7 WHEN 0 THEN '-0a1b-' WHEN 1 THEN '-0A1B-' ELSE '-0a1b-4c2d-8e3f-0123456789ab-' END || 'c' || (o_custkey // 2) || CASE WHEN o_custkey % 2 = 0 THEN '.pdf' ELSE '' END AS staged FROM orders),
m AS (SELECT staged, regexp_replace(staged, '{STAGED_SQL}', '') AS name FROM s WHERE regexp_matches(staged, '{STAGED_SQL}')),
t AS (SELECT 'c' || c_custkey || CASE c_custkey % 3 WHEN 0 THEN '.pdf' WHEN 1 THEN '.1.pdf' ELSE '.2' END AS name FROM customer),
r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY staged) - CASE WHEN name IN (SELECT name FROM t) THEN 0 ELSE 1 END AS turn,
  regexp_extract(name, '^(.*?)(\\.[^.]*)?$', 1) AS stem, regexp_extract(name, '^(.*?)(\\.[^.]*)?$', 2) AS ext FROM m),
free AS (SELECT name, n, row_number() OVER (PARTITION BY name ORDER BY n) AS turn FROM (SELECT name, stem, ext, unnest(range(1, max(turn) + 9)) AS n FROM r GROUP BY name, stem, ext) f
  WHERE stem || '.' || n || ext NOT IN (SELECT name FROM t UNION SELECT name FROM m))
SELECT staged, 'return' AS action, CASE WHEN r.turn = 0 THEN r.name ELSE stem || '.' || n || ext END AS target FROM r LEFT JOIN free ON free.name = r.name AND free.turn = r.turn
UNION ALL SELECT staged, 'remove', NULL FROM s WHERE NOT regexp_matches(staged, '{STAGED_SQL}')""")
def recovered(spark, d):
    """Staged files of a run that was cut short: inputs by order and customer, some strays, names that are taken."""
    c = F.col
    prefix = F.when(c("o_orderkey") % 7 == 0, "-0a1b-").when(c("o_orderkey") % 7 == 1, "-0A1B-").otherwise("-0a1b-4c2d-8e3f-0123456789ab-")
    own = F.concat(F.lit("c"), F.floor(c("o_custkey") / 2), F.when(c("o_custkey") % 2 == 0, ".pdf").otherwise(""))
    key = c("o_orderkey").cast("string")
    staged = read(spark, d, "orders").select(F.concat(F.lpad(key, 8, "0"), prefix, own).alias("name"))
    k = c("c_custkey")
    inbox = read(spark, d, "customer").select(F.concat(F.lit("c"), k, F.when(k % 3 == 0, ".pdf").when(k % 3 == 1, ".1.pdf").otherwise(".2")).alias("name"))
    return recovery.recovered(staged, inbox)


@register("""
WITH f AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 10 = 3 THEN 'fresh' || (p_partkey % 37) ELSE lower(split_part(p_type, ' ', 1)) END || '/p' || (p_partkey % 400) || CASE WHEN p_partkey % 7 = 2 THEN '/sub' ELSE '' END AS folder FROM part),
after AS (SELECT k, folder, folder || '/' || k || CASE WHEN k % 5 = 0 THEN '.pdf' ELSE '.summary.md' END AS rel_path, k % 20 AS s FROM f),
before AS (SELECT *, CASE WHEN k % 2 = 0 THEN s ELSE s - 60 END AS was FROM after WHERE k % 3 = 0),
found AS (SELECT DISTINCT folder FROM after WHERE k % 5 <> 0 AND s > 11 AND rel_path NOT IN (SELECT rel_path FROM before WHERE was = s)),
new AS (SELECT folder FROM found WHERE NOT EXISTS (SELECT 1 FROM before WHERE starts_with(before.rel_path, found.folder || '/'))),
moved AS (SELECT folder, regexp_extract(folder, '([^/]*)$', 1) AS name FROM new WHERE NOT EXISTS (SELECT 1 FROM new n WHERE starts_with(new.folder, n.folder || '/'))),
t AS (SELECT 'p' || (p_size * 8) || CASE WHEN p_size % 2 = 0 THEN '' ELSE '.1' END AS name FROM part),
r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY folder) - CASE WHEN name IN (SELECT name FROM t) THEN 0 ELSE 1 END AS turn FROM moved),
free AS (SELECT name, n, row_number() OVER (PARTITION BY name ORDER BY n) AS turn FROM (SELECT name, unnest(range(1, max(turn) + 9)) AS n FROM r GROUP BY name) f
  WHERE name || '.' || n NOT IN (SELECT name FROM t UNION SELECT name FROM moved)),
sized AS (SELECT moved.folder, count(*) AS files FROM moved JOIN after ON starts_with(after.rel_path, moved.folder || '/') GROUP BY 1),
stay AS (SELECT rel_path FROM after WHERE NOT EXISTS (SELECT 1 FROM moved WHERE starts_with(after.rel_path, moved.folder || '/'))),
o AS (SELECT r.*, regexp_extract(folder, '^(.*)/[^/]*$', 1) AS around FROM r)
SELECT o.folder, 'move' AS action, '_partial/' || CASE WHEN o.turn = 0 THEN o.name ELSE o.name || '.' || n END AS target, files,
  CASE WHEN NOT EXISTS (SELECT 1 FROM stay WHERE starts_with(stay.rel_path, around || '/')) THEN around END AS emptied
FROM o JOIN sized USING (folder) LEFT JOIN free ON free.name = o.name AND free.turn = o.turn
UNION ALL SELECT folder, 'keep', NULL, 0, NULL FROM found WHERE folder NOT IN (SELECT folder FROM new)""")
def quarantine(spark, d):
    """Folders of a failed run: new ones, nested ones, the user's own, and names that are taken in the quarantine."""
    c = F.col
    k = c("p_partkey")
    start = 1_717_200_000
    category = F.when(k % 10 == 3, F.concat(F.lit("fresh"), k % 37)).otherwise(F.lower(F.split_part("p_type", F.lit(" "), F.lit(1))))
    path = F.concat(category, F.lit("/p"), k % 400, F.when(k % 7 == 2, "/sub").otherwise(""), F.lit("/"), k, F.when(k % 5 == 0, ".pdf").otherwise(".summary.md"))
    after = read(spark, d, "part").select(k.alias("k"), path.alias("rel_path"), F.timestamp_seconds(start + k % 20).alias("modified"))
    before = after.filter("k % 3 = 0").withColumn("modified", F.when(c("k") % 2 == 0, c("modified")).otherwise(c("modified") - F.expr("interval 60 seconds")))
    taken = read(spark, d, "part").select(F.concat(F.lit("p"), c("p_size") * 8, F.when(c("p_size") % 2 == 0, "").otherwise(".1")).alias("name"))
    begun = spark.range(1).select(F.timestamp_seconds(F.lit(start + 11)).cast("string")).first()[0]  # in the session's zone
    return recovery.quarantine(before, after.drop("k"), begun, taken)


def _requests(spark, d):
    """A request for each part: a third goes to one service; good at once or late, gone, refused, failing, without answers."""
    k, name = F.col("p_partkey"), F.col("p_name")
    good = F.concat(F.lit('{"status": 200, "body": {"name": "'), name, F.lit('"}}'))
    torn = F.concat(F.lit('{"status": 200, "body": "{\\"name\\": \\"'), name, F.lit('"}'))
    busy, down, none = F.lit('{"status": 429}, '), F.lit('{"status": 503}, '), F.lit("{}, ")
    kinds = [good, F.concat(busy, none, good), F.concat(busy, down, down, good), F.lit('{"status": 404}'), F.concat(down, F.lit('{"status": 400}, '), good), F.lit(""), F.concat(torn, F.lit(", "), good), F.lit('{"status": 200, "body": ""}')]
    answers = F.element_at(F.array(*kinds), (k % 8 + 1).cast("int"))
    where = F.when(k % 3 == 0, "catalogue").otherwise(F.concat(F.lit("s"), k % 20))
    line = F.concat(F.lit('{"key": "'), F.lpad(k.cast("string"), 9, "0"), F.lit('", "service": "'), where, F.lit('", "responses": ['), answers, F.lit("]}"))
    return service.requests(read(spark, d, "part").select(line.alias("value")).union(spark.range(1).select(F.lit("broken {"))))


ASKED = "asked AS (SELECT p_partkey % 8 AS m, lpad(p_partkey::VARCHAR, 9, '0') AS key, CASE WHEN p_partkey % 3 = 0 THEN 'catalogue' ELSE 's' || (p_partkey % 20) END AS service, '{\"name\":\"' || p_name || '\"}' AS doc, '{\"name\": \"' || p_name AS torn FROM part)"


@register(f"""WITH {ASKED}
SELECT key, service, ['good', 'good', 'failed', 'missing', 'refused', 'unanswered', 'good', 'failed'][m + 1] AS outcome, [1, 3, 3, 1, 2, 0, 2, 1][m + 1]::INTEGER AS attempts,
  [0.0, 4.5, 4.5, 0.0, 1.5, 0.0, 1.5, 0.0][m + 1]::DOUBLE AS waited, CASE WHEN m IN (0, 1, 6) THEN doc END AS body,
  CASE m WHEN 2 THEN 'status 503 after 3' WHEN 4 THEN 'status 400 after 2' WHEN 7 THEN 'status 200 after 1' END AS error FROM asked""")
def lookups(spark, d):
    """Searches with attempts, waits and errors."""
    return service.searched(_requests(spark, d))


@register(f"""WITH {ASKED}, b AS (SELECT *, CASE WHEN m IN (0, 1) THEN doc WHEN m = 6 THEN torn WHEN m = 7 THEN '' END AS got FROM asked)
SELECT key, service, CASE WHEN strlen(got) < 30 THEN 'small' ELSE ['good', 'good', 'failed', 'refused', 'refused', 'unanswered', 'good', 'good'][m + 1] END AS outcome, [1, 3, 3, 1, 2, 0, 1, 1][m + 1]::INTEGER AS attempts,
  [0.0, 3.0, 3.0, 0.0, 1.0, 0.0, 0.0, 0.0][m + 1]::DOUBLE AS waited, coalesce(strlen(got), 0)::BIGINT AS size, CASE WHEN strlen(got) >= 30 THEN got END AS body,
  CASE m WHEN 2 THEN 'status 503 after 3' WHEN 3 THEN 'status 404 after 1' WHEN 4 THEN 'status 400 after 2' END AS error FROM b""")
def downloads(spark, d):
    """Documents of at least 30 bytes."""
    return service.downloaded(_requests(spark, d), 30)


@register(f"""WITH {ASKED}, t AS (SELECT *, row_number() OVER (PARTITION BY service ORDER BY key) AS turn FROM asked) SELECT key, service, turn, (turn - 1) * 0.4::DOUBLE AS due FROM t""")
def paced_requests(spark, d):
    """When each request may start at the earliest, by the pace of its service."""
    return service.paced(_requests(spark, d)).select("key", "service", "turn", "due")


@register("""SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN s_name || '; Ada & Bo' WHEN 1 THEN s_name END AS names FROM supplier""")
def atom_authors(spark, d):
    """Author lists of recorded feeds: two entries, one with a prefix of its namespace, none, and a feed cut short."""
    c = F.col
    head = '<?xml version="1.0"?><feed xmlns="http://www.w3.org/2005/Atom"><title>t</title>'
    two = F.concat(F.lit(head + "<entry><title>x</title><author><name>\n "), c("s_name"), F.lit(" </name></author></entry><entry><author><name>Ada &amp; Bo</name></author><author><name/></author></entry></feed>"))
    one = F.concat(F.lit('<a:feed xmlns:a="http://www.w3.org/2005/Atom"><a:entry><a:author><a:name>'), c("s_name"), F.lit("</a:name></a:author></a:entry></a:feed>"))
    feed = F.when(c("s_suppkey") % 4 == 0, two).when(c("s_suppkey") % 4 == 1, one).when(c("s_suppkey") % 4 == 2, F.lit(head + "</feed>")).otherwise(F.substring(two, 1, 120))
    return read(spark, d, "supplier").select("s_suppkey", F.array_join(service.atom_authors(feed), "; ").alias("names"))
