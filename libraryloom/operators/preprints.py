"""Preprint checks: which are due, what recorded search results say, and how the cache is brought up to date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from libraryloom.functions import identifiers, measures, names, similarity
from libraryloom.functions.text import blank
from libraryloom.operators.matching import first_or_better
from libraryloom.operators.order import ranked

REFRESH_DAYS = 7
SANE, NEAR = 0.70, 0.85
#: Fixed value: what stands for a venue without a name.
UNKNOWN_VENUE = "(venue unknown to OpenAlex)"


def preprints(library: DataFrame) -> DataFrame:
    """rel_path, title, authors, url, venue and id of the records that are preprints."""
    venue = identifiers.preprint_venue(F.col("url"), F.col("source_type"), F.col("publication"))
    return library.filter("NOT corrupt").withColumn("v", venue).filter("v IS NOT NULL").select("rel_path", "title", "authors", "url", F.col("v.venue").alias("preprint_venue"), F.col("v.id").alias("preprint_id"))


def looks_preprint(url: Column, source_type: Column, publication: Column) -> Column:
    """The looser rule of the view; it may take in records that ``preprints`` leaves out."""
    low, address = F.lower(blank(publication)), F.lower(blank(url))
    return address.contains("arxiv.org") | address.contains("ssrn.com") | (F.lower(blank(source_type)) == "preprint") | low.startswith("arxiv") | low.startswith("ssrn") | low.startswith("preprint")


def due(found: DataFrame, checks: DataFrame, now: str, days: int = REFRESH_DAYS) -> DataFrame:
    """``found`` with fresh: whether the cache holds a recent answer that was no error."""
    c = checks.select("rel_path", F.try_to_timestamp("checked_at").alias("at"), (F.col("status") == "error").alias("failed"))
    rows = found.join(c, "rel_path", "left")
    return rows.withColumn("fresh", measures.is_fresh(F.col("at"), F.lit(now).cast("timestamp"), days, F.col("failed"))).drop("at", "failed")


def best_location(locations: Column) -> Column:
    """struct(score, place, item) of the strongest location that is no preprint and no mere submission; null if none."""
    usable = F.filter(locations, lambda x: ~identifiers.is_preprint_location(x["source"]["type"], x["landing_page_url"]) & (F.lower(blank(x["version"])) != "submittedversion"))
    score = lambda x: identifiers.location_score(x["version"], x["source"]["type"], x["is_published"])
    keyed = F.transform(usable, lambda x, i: F.struct(score(x).alias("score"), (-i).alias("place"), F.coalesce(F.nullif(F.trim(blank(x["source"]["display_name"])), F.lit("")), F.lit(UNKNOWN_VENUE)).alias("publication"), F.coalesce(F.nullif(F.lower(blank(x["source"]["type"])), F.lit("")), F.lit("unknown")).alias("venue_type"), blank(x["landing_page_url"]).alias("published_url"), F.lower(blank(x["version"])).alias("version")))
    return F.array_max(keyed)


def checked(stale: DataFrame, answers: DataFrame, now: str) -> DataFrame:
    """Cache entries for preprints that are due, from recorded answers (rel_path, error, works: array of hits in order).

    The first hit with the same identifier, a sane title and a common author (or none known) is taken at once; else the
    best title of at least 0.85 with a common author where the preprint's are known, the first of equals.
    """
    c = F.col
    rows = stale.join(answers, "rel_path", "left")
    hits = rows.filter(c("error").isNull() & (blank(c("title")) != "")).select("rel_path", "title", "authors", "preprint_venue", "preprint_id", F.posexplode("works").alias("place", "w"))
    theirs = F.array_compact(F.transform(c("w.authorships"), lambda a: F.nullif(F.lower(F.element_at(F.concat(F.array(F.lit("")), names.words_of(a["author"]["display_name"])), -1)), F.lit(""))))
    hits = hits.withColumn("ours", names.surnames(c("authors"))).withColumn("theirs", F.coalesce(theirs, F.array().cast("array<string>")))
    hits = hits.withColumn("t", F.coalesce(c("w.title"), c("w.display_name"))).withColumn("score", similarity.title_similarity(c("title"), c("t")))
    own = F.filter(F.transform(c("w.locations"), lambda x: F.lower(identifiers.arxiv_id(x["landing_page_url"]))), lambda i: i != "")
    same = (c("preprint_venue") == "arXiv") & (c("preprint_id") != "") & (F.get(own, F.lit(0)) == F.lower("preprint_id"))  # the first that a hit names
    agree = (F.size("ours") == 0) | (F.size("theirs") == 0) | F.arrays_overlap("ours", "theirs")
    hits = hits.withColumn("fast", F.coalesce(same, F.lit(False)) & (c("score") >= SANE) & agree)
    by_title = (c("score") >= NEAR) & ((F.size("ours") == 0) | F.arrays_overlap("ours", "theirs"))
    best = first_or_better(hits.filter(c("fast") | by_title), ["rel_path"], "fast", "score", "place")
    best = best.select("rel_path", c("fast"), F.when(c("fast"), F.greatest("score", F.lit(0.95))).otherwise(c("score")).alias("s"), best_location(c("w.locations")).alias("l"), F.regexp_replace(blank(c("w.doi")), "https?://doi\\.org/", "").alias("doi"), F.trim(blank(c("t"))).alias("published_title"))
    rows = rows.join(best, "rel_path", "left")
    found = c("s").isNotNull()
    status = F.when(blank(c("title")) == "", "unknown").when(c("error").isNotNull(), "error").when(~found, "unknown").when(c("l").isNull(), "preprint-only").otherwise("published")
    ok = status == "published"
    return rows.select(
        "rel_path", "title", "preprint_venue", "preprint_id", c("url").alias("preprint_url"), F.lit(now).alias("checked_at"), status.alias("status"),
        F.when(ok, identifiers.confidence(c("fast"), c("s"))).alias("confidence"), F.when(found, F.round("s", 3)).alias("match_score"), *[F.when(ok, c(f"l.{k}")).alias(k) for k in ("publication", "venue_type", "version", "published_url")],
        F.when(ok, c("doi")).alias("doi"), F.when(ok, identifiers.doi_in(c("l.published_url"))).alias("published_doi"), F.when(ok, c("published_title")).alias("published_title"), "error",
    )


def refreshed(checks: DataFrame, new: DataFrame, found: DataFrame, prune: bool = True) -> DataFrame:
    """The cache after a run: new entries replace old ones, fresh ones get the record's present fields, others are pruned."""
    shown = found.select("rel_path", F.col("title").alias("_t"), F.col("preprint_venue").alias("_v"), F.col("preprint_id").alias("_i"), F.col("url").alias("_u"))
    old = checks.join(new.select("rel_path"), "rel_path", "left_anti").join(shown, "rel_path", "inner" if prune else "left")
    now = {"title": "_t", "preprint_venue": "_v", "preprint_id": "_i", "preprint_url": "_u"}
    old = old.select(*[F.coalesce(now[c], c).alias(c) if c in now else F.col(c) for c in checks.columns])
    return old.unionByName(new, allowMissingColumns=True)


#: The lists of the view.
BUCKETS = ("published", "preprint-only", "unknown", "error", "unchecked")


def view(looked_like: DataFrame, checks: DataFrame, now: str) -> DataFrame:
    """bucket, place, rel_path, title and checked_ago of the view: what the cache says, and records that it does not hold.

    ``looked_like``: rel_path of the records that look like preprints. Published entries come first, then all by title
    without case; places count within the whole view, unchecked records by path at its end.
    """
    c = F.col
    at = F.try_to_timestamp("checked_at")
    ago = F.when(at.isNull() & (blank(c("checked_at")) != ""), c("checked_at")).otherwise(measures.age_text(at, F.lit(now).cast("timestamp")))
    rows = checks.select("rel_path", F.coalesce(F.nullif(c("title"), F.lit("")), c("rel_path")).alias("title"), F.coalesce(F.nullif(c("status"), F.lit("")), F.lit("unknown")).alias("bucket"), ago.alias("checked_ago"))
    rows = rows.select("bucket", F.when(c("bucket") == "published", 0).otherwise(1).alias("_a"), F.lower("title").alias("_b"), "rel_path", "title", "checked_ago")
    new = looked_like.select("rel_path").distinct().join(checks.select("rel_path"), "rel_path", "left_anti")
    new = new.select(F.lit("unchecked").alias("bucket"), F.lit(2).alias("_a"), F.lit("").alias("_b"), "rel_path", F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("checked_ago"))
    placed = ranked(rows.union(new), ["_a", "_b", "rel_path", "title", "checked_ago"])
    return placed.select("bucket", c("place").cast("long").alias("place"), "rel_path", "title", "checked_ago")


def view_stats(looked_like: DataFrame, checks: DataFrame) -> DataFrame:
    """One row: how many are in each list of the view, their total, and the newest time of a check (empty if none)."""
    status = F.coalesce(F.nullif(F.col("status"), F.lit("")), F.lit("unknown"))
    known = checks.agg(F.count(F.lit(1)).alias("entries"), *[F.count_if(status == b).alias(b.replace("-", "_")) for b in BUCKETS[:-1]], F.coalesce(F.max(F.nullif(F.col("checked_at"), F.lit(""))), F.lit("")).alias("newest"))
    new = looked_like.select("rel_path").distinct().join(checks.select("rel_path"), "rel_path", "left_anti").agg(F.count(F.lit(1)).alias("unchecked"))
    return known.crossJoin(F.broadcast(new)).select((F.col("entries") + F.col("unchecked")).alias("total"), *[b.replace("-", "_") for b in BUCKETS], "newest")  # one row each


def run_stats(found: DataFrame, checks: DataFrame, new: DataFrame) -> DataFrame:
    """One row on a run: checked, skipped, errors, found_published, pruned and total_preprints.

    ``found``: the library's preprints; ``checks``: the cache before the run; ``new``: what the run looked up.
    """
    c = F.col
    looked = new.agg(F.count(F.lit(1)).alias("checked"), F.count_if(c("status") == "error").alias("errors"), F.count_if(c("status") == "published").alias("found_published"))
    gone = checks.join(found.select("rel_path"), "rel_path", "left_anti").join(new.select("rel_path"), "rel_path", "left_anti").agg(F.count(F.lit(1)).alias("pruned"))
    total = found.agg(F.count(F.lit(1)).alias("total_preprints"))
    rows = looked.crossJoin(F.broadcast(gone)).crossJoin(F.broadcast(total))  # one row each
    return rows.select("checked", (c("total_preprints") - c("checked")).alias("skipped"), "errors", "found_published", "pruned", "total_preprints")


def buckets(found: DataFrame, checks: DataFrame) -> DataFrame:
    """status and n: how many preprints of the library are in each state, unchecked ones too."""
    rows = found.select("rel_path").join(checks.select("rel_path", "status"), "rel_path", "left")
    return rows.groupBy(F.coalesce("status", F.lit("unchecked")).alias("status")).agg(F.count(F.lit(1)).alias("n"))
