"""Operators over the records of a library: index, audit, validation, backfill and search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from libraryloom.functions import measures as m
from libraryloom.functions import names
from libraryloom.functions.text import blank, escape_cell, matches_search
from libraryloom.operators.matching import places
from libraryloom.sources.records import line_scalar

# Kinds of source and the spellings that mean them.
KINDS = ("paper", "documentation", "article", "report", "book-chapter", "opinion", "book")
KIND_OF = {
    "paper": ("empirical-study", "empirical_study", "empirical-paper", "empirical paper", "preprint", "research-article", "journal-article", "journal_article", "working-paper", "working_paper", "review", "conference-paper", "law-review-article", "position paper", "position-paper", "study"),
    "article": ("blog-post", "blog post", "essay", "post", "news", "magazine-article"),
    "report": ("policy-report", "policy-brief", "white-paper", "whitepaper", "technical-report"),
    "documentation": ("docs", "doc"),
    "opinion": ("ethics-opinion", "formal-opinion", "court-order"),
}
VIA = "^(digest:(item|scout)/[0-9]+|candidate-note:\\S.*|manual)$"


def projected(library: DataFrame) -> DataFrame:
    """The columns that reports show, with their defaults; unreadable records are left out."""
    year = F.when(F.length(blank(F.col("date"))) >= 4, F.left("date", F.lit(4))).otherwise("")
    return library.filter("NOT corrupt").select(
        "rel_path", F.col("folder").alias("category"), "slug", F.coalesce("title", F.concat("slug", F.lit(".summary"))).alias("title"), F.trim(blank(F.col("tldr"))).alias("tldr"),
        F.coalesce("authors", F.array().cast("array<string>")).alias("authors"), F.coalesce("tags", F.array().cast("array<string>")).alias("tags"), blank(F.col("date")).alias("date"), year.alias("year"),
        m.status(F.col("status"), F.col("superseded_by")).alias("status"), blank(F.col("url")).alias("url"), "original_kind",
    )


def search(library: DataFrame, query: str) -> DataFrame:
    cols = [F.col(c) for c in ("title", "tldr")] + [F.array_join("authors", " "), F.array_join("tags", " "), F.col("category")]
    return projected(library).filter(matches_search(query, *cols))


#: The lines of an index.
INDEX_HEAD = ("# Source Index", "")
INDEX_TABLE = ("", "| Title | Tl;dr | Author(s) | Year |", "|-------|-------|-----------|------|")
NO_SOURCES = "*No sources yet.*"


def index_lines(library: DataFrame, preferred: tuple[str, ...] = (), folders: DataFrame | None = None, most_authors: int = 4) -> DataFrame:
    """place and line of the index: preferred categories, the others by name, newest first; then empty categories.

    ``folders``: category of every folder. Without any record there is no list of empty folders. Retired records stay
    listed, marked with their state and successor.
    """
    rows = projected(library).join(library.select("rel_path", F.coalesce(m.filled(F.col("superseded_by")), F.lit("")).alias("successor")), "rel_path")
    rank = F.array_position(F.array(*[F.lit(p) for p in preferred]).cast("array<string>"), F.col("category"))
    rank = F.when(rank > 0, rank).otherwise(len(preferred) + 1)
    dash = lambda c: F.when(c == "", "—").otherwise(c)
    state = F.concat("status", F.when(F.col("successor") != "", F.concat(F.lit(" → "), "successor")).otherwise(""))
    mark = F.when(F.col("status") == "active", "").otherwise(F.concat(F.lit(" · *"), escape_cell(state), F.lit("*")))
    link = F.concat(F.lit("["), escape_cell(F.col("title")), F.lit("]("), "rel_path", F.lit(")"), mark)
    cells = [link, dash(escape_cell(F.col("tldr"))), escape_cell(names.byline(F.col("authors"), most_authors)), dash(F.col("year"))]
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    order = [F.desc("date"), F.desc("title"), F.asc("rel_path")]
    body = places(rows.select("category", "date", "title", "rel_path", line.alias("line")), ["category"], [F.left("date", F.lit(7)), F.left("title", F.lit(2))], order, "c")
    spark = rows.sparkSession
    start = len(INDEX_HEAD)
    head = spark.createDataFrame([(k + 1, x) for k, x in enumerate(INDEX_HEAD)], "place long, line string")
    if rows.isEmpty():
        return head.union(spark.createDataFrame([(start + 1, NO_SOURCES)], "place long, line string"))
    # each category has its heading, the lines of the table's head, its records and an empty line
    extra = len(INDEX_TABLE) + 2
    groups = rows.groupBy("category").agg(F.count(F.lit(1)).alias("n")).withColumn("a", rank)
    if folders is not None:
        empty = folders.select("category").distinct().join(groups.select("category"), "category", "left_anti")
        groups = groups.union(empty.select("category", F.lit(0).cast("long"), F.lit(10**6)))
    lines = F.when(F.col("n") > 0, F.col("n") + extra).otherwise(4)
    above = Window.orderBy("a", "category").rowsBetween(Window.unboundedPreceding, -1)  # a row for each category
    groups = groups.withColumn("base", F.lit(start) + F.coalesce(F.sum(lines).over(above), F.lit(0)))
    at = lambda k, text: F.struct((F.col("base") + k).cast("long").alias("place"), text.alias("line"))
    title = at(1, F.concat(F.lit("## "), "category"))
    full = F.array(title, *[at(2 + k, F.lit(x)) for k, x in enumerate(INDEX_TABLE)], at(F.col("n") + extra, F.lit("")))
    bare = F.array(title, at(2, F.lit("")), at(3, F.lit(NO_SOURCES)), at(4, F.lit("")))
    fixed = groups.select(F.explode(F.when(F.col("n") > 0, full).otherwise(bare)).alias("x")).select("x.place", "x.line")
    body = body.join(groups.select("category", "base"), "category").select((F.col("base") + len(INDEX_TABLE) + 1 + F.col("c")).cast("long").alias("place"), "line")
    return head.union(fixed).union(body)


def audit(library: DataFrame, links: DataFrame) -> DataFrame:
    """rel_path and issue: corrupt front matter, no original, not in the index; and links without a record.

    ``links``: rel_path of every link of the index.
    """
    issue = lambda rows, name: rows.select("rel_path", F.lit(name).alias("issue"))
    seen = library.select("rel_path")
    return (
        issue(library.filter("corrupt"), "corrupt").union(issue(library.filter("original_kind IS NULL"), "missing-original"))
        .union(issue(seen.join(links, "rel_path", "left_anti"), "unindexed")).union(issue(links.distinct().join(seen, "rel_path", "left_anti"), "orphan-link"))
    )


def audit_report(library: DataFrame, links: DataFrame) -> DataFrame:
    """``audit`` in the order of the report: place, issue, category, title and rel_path.

    Issues of records go by category and title without case; paths without a record have neither and go by path.
    """
    known = library.select("rel_path", F.col("folder").alias("category"), F.coalesce("title", F.concat("slug", F.lit(".summary"))).alias("title"))
    rows = audit(library, links).join(known, "rel_path", "left")
    order = Window.partitionBy("issue").orderBy(F.coalesce("category", F.lit("")), F.lower(F.coalesce("title", F.lit(""))), "rel_path")
    return rows.select(F.row_number().over(order).cast("long").alias("place"), "issue", "category", "title", "rel_path")


def audit_tiles(library: DataFrame, links: DataFrame) -> DataFrame:
    """One row: records on disk, the number of each issue, and of all issues together."""
    issue = F.col("issue")
    found = audit(library, links).agg(*[F.count_if(issue == name).alias(name.replace("-", "_")) for name in ("orphan-link", "unindexed", "missing-original", "corrupt")], F.count(F.lit(1)).alias("issues"))
    return library.agg(F.count(F.lit(1)).alias("summaries")).crossJoin(F.broadcast(found))  # one row each


def validated(library: DataFrame, today: str, external: DataFrame | None = None) -> DataFrame:
    """rel_path, normalised fields, notes and errors of each record; valid where there are no errors.

    Scalars are those of the line dialect. ``external``: rel_path and external_authors of records whose author list was
    fetched; without a row the comparison is skipped.
    """
    rows = library
    for c in ("superseded_by", "status", "retrieved", "currency_check", "snapshot", "source_type", "title", "tldr", "category", "date", "discovered_via"):
        raw = line_scalar(F.col("block"), c)
        rows = rows.withColumn(f"_{c}", F.regexp_replace(F.regexp_replace(raw, "^[\"'](.*)[\"']$", "$1"), "\\s+$", ""))
    v = lambda c: F.col(f"_{c}")
    successor = blank(m.filled(v("superseded_by")))
    status = F.when(m.filled(v("status")).isNotNull(), F.lower(v("status"))).otherwise(F.when(successor != "", "superseded").otherwise("active"))
    beside = F.col("has_snapshot") if "has_snapshot" in library.columns else F.col("original_kind") == "snapshot"
    snapshot = F.when(F.coalesce(beside, F.lit(False)), "true").otherwise("false")
    retrieved = F.when(m.is_full_date(v("retrieved")), v("retrieved")).otherwise(today)
    currency = F.when(m.is_full_date(v("currency_check")) & (v("currency_check") <= today), v("currency_check")).otherwise(retrieved)
    kind = blank(v("source_type"))
    mapped = kind
    for to, spellings in KIND_OF.items():
        mapped = F.when(kind.isin(*spellings), to).otherwise(mapped)
    notes = [("superseded_by", successor), ("status", status), ("snapshot", snapshot), ("retrieved", retrieved), ("currency_check", currency), ("source_type", mapped)]
    same = lambda c, new: F.lower(v(c)).eqNullSafe(new) if c in ("status", "snapshot") else v(c).eqNullSafe(new)
    note = [F.when(~same(c, new), F.concat(F.lit(f"{c}: "), F.coalesce(v(c), F.lit("(absent)")), F.lit(" -> "), new)) for c, new in notes]
    note.append(F.when(~blank(F.col("block")).rlike("(?m)^authors:[ \\t]*$") & (F.size("authors") > 0), F.lit("authors: to block list")))
    rows = rows.select("rel_path", "folder", "slug", "slug_folder", "authors", *[new.alias(c) for c, new in notes], *[blank(m.filled(v(c))).alias(f"f_{c}") for c in ("title", "tldr", "category", "date")], v("discovered_via").alias("via"), F.array_compact(F.array(*note)).alias("notes"))
    f = F.col
    errors: list[Column] = [F.when(f(f"f_{c}") == "", f"{c} is empty") for c in ("title", "tldr", "category", "date")]
    errors += [
        F.when(~f("source_type").isin(*KINDS), F.concat(F.lit("unknown source_type: "), f("source_type"))),
        F.when(~f("status").isin(*m.STATUSES), F.concat(F.lit("unknown status: "), f("status"))),
        F.when((f("status") == "superseded") & (f("superseded_by") == ""), F.lit("superseded without successor")),
        F.when(~f("via").rlike(VIA), F.lit("bad discovered_via")),  # also where the key is there and holds nothing
        F.when((f("f_date") != "") & ~m.is_partial_date(f("f_date")), F.lit("bad date")),
        F.when((f("f_category") != "") & (f("f_category") != f("folder")), F.lit("category is not the folder")),
        F.when(f("slug") != f("slug_folder"), F.lit("slug is not the folder")),
        F.when(F.size("authors") <= 0, F.lit("no authors")),
        F.when(F.exists("authors", names.is_placeholder), F.lit("et al. among authors")),
        F.when(F.exists("authors", names.looks_like_person), F.lit("author not as Last, First")),
    ]
    if external is not None:
        rows = rows.join(external, "rel_path", "left")
        known = f("external_authors").isNotNull() & ~F.exists("authors", names.is_placeholder) & (F.size("authors") > 0)
        first = F.lower(F.trim(F.substring_index(F.element_at("authors", 1), ",", 1)))
        errors.append(F.when(known & ~F.lower(F.element_at("external_authors", 1)).contains(first), F.lit("first author differs")))
        errors.append(F.when(known & (F.size("external_authors") != F.size("authors")), F.lit("number of authors differs")))
    rows = rows.withColumn("errors", F.array_compact(F.array(*errors)))
    return rows.select("rel_path", *[c for c, _ in notes], "notes", "errors", (F.size("errors") == 0).alias("valid"))


def backfilled_hashes(library: DataFrame, force: bool = False) -> DataFrame:
    """rel_path and source_hash to write: of records with an original and, unless forced, without a hash."""
    rows = library.filter("original_kind IS NOT NULL AND block IS NOT NULL")
    if not force:
        rows = rows.filter(m.filled(F.col("source_hash")).isNull())
    return rows.select("rel_path", F.col("original_hash").alias("source_hash"))


def backfilled_authors(library: DataFrame) -> DataFrame:
    """rel_path and authors of records without authors whose publication is an institution."""
    rows = library.filter((F.size("authors") <= 0) & names.is_institution(F.col("publication")))
    return rows.select("rel_path", F.array(F.trim("publication")).alias("authors"))


#: What stands between the values of a changelog entry.
FILED = ("Filed *", "* (", ", ", ") into `", "/`. Key finding: ", ".")
REMOVED = ("Removed ", " from ", ". Deleted via the dashboard.")


def filed_entries(library: DataFrame) -> DataFrame:
    """rel_path and text of the changelog entry that the filing of each readable record gives."""
    title = F.coalesce(F.nullif(F.col("title"), F.lit("")), F.col("slug"))
    who = names.changelog_byline(F.coalesce("authors", F.array().cast("array<string>")))
    finding = F.regexp_replace(F.trim(blank(F.col("tldr"))), "\\.+$", "")
    values = [title, who, F.left(blank(F.col("date")), F.lit(4)), F.concat_ws("/", "folder", "slug"), finding]
    pieces = [x for text, value in zip(FILED, values, strict=False) for x in (F.lit(text), value)]
    return library.filter("NOT corrupt").select("rel_path", F.concat(*pieces, F.lit(FILED[-1])).alias("text"))


def after_deletion(library: DataFrame, requested: DataFrame, at: str) -> tuple[DataFrame, DataFrame]:
    """The library without the requested records that may go, and the changelog entries (at, seq, text) of those that went.

    The index is made anew from what is left; requests that are not safe, or name nothing, change nothing.
    """
    gone = deletable(library, requested).distinct()
    left = library.join(gone, "rel_path", "left_anti")
    own = library.join(gone, "rel_path", "left_semi")
    seq = F.row_number().over(Window.orderBy("rel_path")).cast("long")  # what one request names
    place = F.concat(F.lit("`"), F.concat_ws("/", "folder", "slug"), F.lit("/`"))
    named = F.when(F.trim(blank(F.col("title"))) != "", F.concat(F.lit("*"), F.trim("title"), F.lit("*"))).otherwise(F.concat(F.lit("`"), F.concat_ws("/", "folder", "slug"), F.lit("`")))
    text = F.concat(F.lit(REMOVED[0]), named, F.lit(REMOVED[1]), place, F.lit(REMOVED[2]))
    return left, own.select(F.lit(at).cast("timestamp").alias("at"), seq.alias("seq"), text.alias("text"))


def deletable(library: DataFrame, requested: DataFrame) -> DataFrame:
    """The requested rel_paths that may be deleted: safe, exactly two folders deep, in a visible category, and there."""
    p = F.col("rel_path")
    safe = p.rlike("^[^/]+/[^/]+/[^/]+\\.summary\\.md$") & ~p.rlike("(^|/)\\.\\.?(/|$)") & ~p.rlike("^[._]")
    return requested.filter(safe).join(library.select("rel_path"), "rel_path", "left_semi")
