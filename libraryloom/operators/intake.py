"""What happens to an incoming file: duplicate, backfill of a missing original, promotion of a preprint, or new."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from libraryloom.functions import identifiers, similarity
from libraryloom.functions.text import blank, normalize_title
from libraryloom.functions.urls import canonical_url, host, is_web_url
from libraryloom.operators.matching import best_with_margin, containing, neighbours, only_match, similar_texts, spread, whole
from libraryloom.operators.order import ranked
from libraryloom.sources.scratch import cut

BACKFILLS = ("pdf", "md", "html", "htm")
FUZZY, MARGIN, YEAR = 0.70, 0.15, 0.10
TITLE, LEAST = 0.90, 12
VETO = 0.70
#: What marks a volume of proceedings, and how long it must be.
VOLUME_MARKERS = ("lecture notes in computer science", "lecture notes in artificial intelligence", "communications in computer and information science", "conference proceedings", "proceedings, part", "proceedings of the")
VOLUME_PAGES = 60


def decide(inputs: DataFrame, library: DataFrame) -> DataFrame:
    """name, rel_path and reason of each input: hash, url, backfill:hash, backfill:fuzzy, or null for a new one.

    ``inputs``: name, hash, url, stem, meta_title, first_page. Hash comes before address, then the least rel_path. The
    costly comparison runs only for what neither hash nor address finds, against records without an original.
    """
    ext = F.lower(F.regexp_extract("name", "\\.([A-Za-z0-9]+)$", 1))
    inputs = inputs.withColumn("can_backfill", ext.isin(*BACKFILLS))
    lib = library.select("rel_path", "slug", "title", "url", "preprint_url", "source_hash", F.col("original_kind").isNull().alias("missing"))
    by_hash = inputs.filter(blank(F.col("hash")) != "").join(whole(lib.select("rel_path", "missing", F.col("source_hash").alias("hash"))), "hash")
    own = spread(lib.select("rel_path", "missing", "url", "preprint_url"), "rel_path")
    keys = own.select("rel_path", "missing", F.explode(F.array("url", "preprint_url")).alias("key")).filter(blank(F.col("key")) != "").withColumn("key", canonical_url(F.col("key")))
    by_url = inputs.filter(ext.isin("txt", "url") & (blank(F.col("url")) != "")).withColumn("key", canonical_url(F.col("url"))).join(whole(keys), "key")
    hit = lambda rows, rank, how: rows.select("name", F.struct(F.lit(rank).alias("rank"), "rel_path", F.when(F.col("missing") & F.col("can_backfill"), f"backfill:{how}").otherwise(how).alias("reason")).alias("h"))
    sure = cut(hit(by_hash, 1, "hash").union(hit(by_url, 2, "url")).groupBy("name").agg(F.min("h").alias("h")).select("name", "h.rel_path", "h.reason"), "sure")

    rest = spread(inputs.filter("can_backfill").join(whole(sure), "name", "left_anti"), "name")
    rest = cut(rest.select("name", "stem", normalize_title(F.col("stem")).alias("n"), normalize_title(F.col("meta_title")).alias("meta"), normalize_title(F.col("first_page")).alias("page")), "files")
    missing = spread(lib.filter("missing").select("rel_path", "slug", "title", "url", "preprint_url"), "rel_path")
    open_ = cut(missing.select("rel_path", normalize_title(F.col("slug")).alias("s"), normalize_title(F.col("title")).alias("t"), F.array(identifiers.arxiv_id(F.col("url")), identifiers.arxiv_id(F.col("preprint_url"))).alias("ids")), "records")
    found = sure.union(_fuzzy(rest, open_).select("name", "rel_path", F.lit("backfill:fuzzy")))
    return inputs.select("name").join(whole(found), "name", "left").select("name", "rel_path", "reason")


def _fuzzy(rest: DataFrame, open_: DataFrame) -> DataFrame:
    """(name, rel_path) of the record that each file is likely the original of, by its score and its lead.

    Scores come from containment, which finds its pairs by words and pieces, or from a ratio. A record is chosen only with a
    lead, so what containment and a few records that begin or end alike give already says how much another winner must
    reach, more than the best of them: files that nothing else can win are left out, and for the others ``similar_texts``
    finds the records that may win, then, for files that have such a record, those that may take its lead.
    """
    c = F.col
    side = lambda rows, kind, key, text, name: rows.select(F.lit(kind).alias("kind"), c(key).alias(f"{name}_id"), c(text).alias(name))
    each = open_.select("rel_path", F.explode(F.array_distinct(F.array("s", "t"))).alias("x"))
    ids = open_.select("rel_path", F.explode("ids").alias("x"))
    heads = rest.select("name", F.explode(F.array("meta", "page")).alias("x"))
    # kinds: slug or title in a name, title in other titles or pages, identifier in a name; then names and titles in a record's
    own = side(each, "x", "rel_path", "x", "part").union(side(open_, "t", "rel_path", "t", "part")).union(side(ids, "i", "rel_path", "x", "part"))
    files = side(rest, "x", "name", "n", "whole").union(side(heads, "t", "name", "x", "whole")).union(side(rest, "i", "name", "stem", "whole"))
    held = containing(own, files, kind="kind").select(c("whole_id").alias("name"), c("part_id").alias("rel_path"))
    told = side(rest, "n", "name", "n", "part").union(side(rest, "m", "name", "meta", "part"))
    records = side(each, "n", "rel_path", "x", "whole").union(side(open_, "m", "rel_path", "t", "whole"))
    held = held.union(containing(told, records, kind="kind").select(c("part_id").alias("name"), c("whole_id").alias("rel_path")))

    bonus = F.when(c("n").rlike("(19|20)[0-9]{2}"), YEAR).otherwise(0.0)  # a year in the name may add to a ratio

    def reached(files: DataFrame, floor: float) -> DataFrame:
        """Pairs of ``files`` (name, n, meta, goal) whose letters allow a score of ``goal``."""
        own = files.select("name", F.explode(F.array_distinct(F.array("n", "meta"))).alias("text"), (c("goal") - bonus).alias("least"))
        near = similar_texts(own.select("text", "least"), each.select(c("x").alias("text")), floor)
        return own.join(whole(near), "text").select("name", "other").join(whole(each), c("other") == c("x")).select("name", "rel_path")

    def scored(pairs: DataFrame) -> DataFrame:
        rows = pairs.distinct().join(whole(rest), "name").join(whole(open_), "rel_path")
        return spread(rows, "name", "rel_path").select("name", "rel_path", similarity.fuzzy_score(c("n"), c("s"), c("t"), c("ids"), c("stem"), c("meta"), c("page")).alias("score"))

    def ahead(scores: DataFrame) -> DataFrame:
        return best_with_margin(scores, ["name"], "rel_path", "score", FUZZY, MARGIN)

    texts = rest.select("name", F.explode(F.array_distinct(F.array("n", "meta"))).alias("text"))
    ends = each.groupBy("x").agg(F.min("rel_path").alias("a"), F.max("rel_path").alias("b"))
    beside = neighbours(texts, each.select(c("x").alias("text"))).join(whole(ends), c("other") == c("x")).join(whole(texts), "text")
    known = cut(scored(held.union(beside.select("name", F.explode(F.array("a", "b")).alias("rel_path")))), "known")
    least = rest.join(whole(ahead(known).select("name", "score")), "name", "left")
    # a winner that is not known yet leads the best known one; no score is above 1
    least = least.withColumn("goal", F.greatest(F.lit(FUZZY), F.coalesce("score", F.lit(0.0)) + MARGIN - 1e-9))
    least = cut(least.filter("goal <= 1").select("name", "n", "meta", "goal"), "undecided")
    likely = cut(known.union(scored(reached(least, FUZZY - YEAR).join(whole(known.select("name", "rel_path")), ["name", "rel_path"], "left_anti"))), "likely")
    first = ahead(likely).filter("accepted")
    winning = cut(first.select("name", (c("score") - MARGIN).alias("goal")).join(whole(rest), "name").select("name", "n", "meta", "goal"), "ahead")
    others = scored(reached(winning, FUZZY - MARGIN - YEAR).join(whole(likely.select("name", "rel_path")), ["name", "rel_path"], "left_anti"))
    return ahead(likely.join(whole(winning.select("name")), "name", "left_semi").union(others)).filter("accepted")


def published(checks: DataFrame, library: DataFrame) -> DataFrame:
    """Cache entries that are published and whose record still exists."""
    return checks.filter("status = 'published'").join(library.select("rel_path"), "rel_path", "left_semi")


def promotions(pdfs: DataFrame, entries: DataFrame) -> DataFrame:
    """name, rel_path and verdict (promote, volume-contains) for incoming files against published entries.

    ``pdfs``: name, doi, title, pages, front (text of the first pages), outline (array). One identifier that fits exactly
    one entry decides; else the title with its margin; either is vetoed by a title unlike the preprint's. What is not
    promoted may be a volume that contains entries.
    """
    c = F.col
    dois = entries.select("rel_path", "title", F.explode(F.array_distinct(F.array(*[identifiers.normalize_doi(c(k)) for k in ("doi", "published_doi")], identifiers.doi_in(c("published_url"))))).alias("doi")).filter("doi <> ''")
    own = pdfs.select("name", F.col("title").alias("pdf_title"), identifiers.normalize_doi(c("doi")).alias("doi")).filter("doi <> ''")
    pairs = cut(own.join(whole(dois), "doi"), "identified")
    one = only_match(pairs, ["name"], "rel_path").join(whole(pairs.groupBy("name").agg(F.min("pdf_title").alias("pdf_title"))), "name").select("name", "rel_path", "pdf_title")
    # the published title; the preprint's own only where a published place is known
    titles = entries.select("rel_path", normalize_title(F.coalesce(F.nullif(c("published_title"), F.lit("")), F.when(blank(c("published_url")) != "", c("title")))).alias("t")).filter(F.length("t") >= LEAST)
    rest = pdfs.join(whole(one), "name", "left_anti").select("name", F.col("title").alias("pdf_title"), normalize_title(c("title")).alias("n")).filter(F.length("n") >= LEAST)
    rest, titles = cut(rest, "files"), cut(titles, "titles")
    named = titles.distinct()

    def compared(files: DataFrame, floor: float) -> DataFrame:
        """Scores of ``files`` (name, n, goal) with the titles whose letters allow ``goal``."""
        near = similar_texts(files.select(c("n").alias("text"), c("goal").alias("least")), titles.select(c("t").alias("text")), floor)
        near = spread(near, "text", "other").withColumn("score", similarity.similarity(c("text"), c("other")))
        return files.join(whole(near), c("n") == c("text")).select("name", "n", "other", "score").join(whole(titles), c("other") == c("t")).select("name", "rel_path", "score")

    likely = cut(compared(rest.select("name", "n", F.lit(TITLE).alias("goal")), TITLE), "likely")
    first = best_with_margin(likely, ["name"], "rel_path", "score", TITLE, MARGIN).filter("accepted")
    ahead = cut(first.select("name", (c("score") - MARGIN).alias("goal")).join(whole(rest), "name").select("name", "n", "goal"), "ahead")
    best = best_with_margin(compared(ahead, TITLE - MARGIN), ["name"], "rel_path", "score", TITLE, MARGIN).filter("accepted").join(whole(rest.select("name", "pdf_title")), "name")
    found = one.select("name", "rel_path", "pdf_title").union(best.select("name", "rel_path", "pdf_title")).join(whole(entries.select("rel_path", "title")), "rel_path")
    unlike = (F.length(normalize_title(c("pdf_title"))) >= LEAST) & (blank(c("title")) != "") & (similarity.title_similarity(c("pdf_title"), c("title")) < VETO)
    promote = cut(spread(found, "name").filter(~unlike).select("name", "rel_path", F.lit("promote").alias("verdict")), "promoted")

    front = F.regexp_replace(F.lower(blank(c("front"))), "(?U)[\\s\\x1c-\\x1f]+", " ")  # a text's lines break anywhere
    marked = F.lit(False)
    for marker in VOLUME_MARKERS:
        marked = marked | front.contains(marker)
    volumes = pdfs.filter((c("pages") >= VOLUME_PAGES) & marked).join(whole(promote), "name", "left_anti").select("name", normalize_title(c("front")).alias("toc"), F.transform(F.coalesce("outline", F.array().cast("array<string>")), normalize_title).alias("outline"))
    parts = named.select(F.struct("rel_path", "t").alias("part_id"), c("t").alias("part"))
    listed = containing(parts, volumes.select(c("name").alias("whole_id"), c("toc").alias("whole"))).select(c("whole_id").alias("name"), c("part_id.rel_path").alias("rel_path"))
    lines = cut(volumes.select("name", F.explode(F.array_distinct("outline")).alias("o")).filter("o <> ''"), "lines")
    alike = similar_texts(named.select(c("t").alias("text"), F.lit(TITLE).alias("least")), lines.select(c("o").alias("text")), TITLE)
    alike = alike.filter((c("text") == c("other")) | (similarity.similarity(c("text"), c("other")) >= TITLE))
    close = lines.join(whole(alike), c("o") == c("other")).select("name", "text").join(whole(named), c("text") == c("t")).select("name", "rel_path")
    return promote.union(listed.union(close).distinct().select("name", "rel_path", F.lit("volume-contains")))


#: Turns that look for their number together.
TURNS = 1024


def outcome_names(moved: DataFrame, taken: DataFrame, extensions: bool = True) -> DataFrame:
    """``moved`` (name, ...) with target: the name, or stem.n.ext with the least number from 1 that nothing else has.

    ``taken``: name of the files already there. A name without a point gets its number at the end; of ``a.1`` the
    extension is ``.1``, so it becomes ``a.1.1``. Numbers are given out name by name, past those that a file has or that
    another moved file brings as its own name, in whatever way that name can be read, so no two targets and no taken name
    are equal. Of files of one name the first, in the order of the other columns, gets the name itself where it is free;
    the others follow in that order. No task holds all files of a name or all numbers in use. Without ``extensions``, as for
    folders, the number always comes last.
    """
    c = F.col
    whole = "^(.*?)(\\.[^.]*)?$" if extensions else "(?s)^(.*)()$"
    kept = taken.select("name").distinct()
    others = [c(x) for x in moved.columns if x != "name"]
    rows = ranked(moved, others, "_k", ["name"]).join(kept.withColumn("_t", F.lit(1)), "name", "left")
    rows = rows.withColumn("_turn", c("_k") - F.when(c("_t").isNull(), 1).otherwise(0))  # 0: keeps its name
    used = kept.union(moved.select("name")).distinct()
    read = lambda pattern, ext: F.struct(F.concat(F.regexp_extract("name", pattern, 1), F.regexp_extract("name", pattern, 3) if ext else F.lit("")).alias("name"), F.regexp_extract("name", pattern, 2).try_cast("long").alias("n"))
    patterns = {"^(.*)\\.([1-9][0-9]{0,17})(\\.[^.]*)$": True, "^([^.]*)\\.([1-9][0-9]{0,17})$": False} if extensions else {"(?s)^(.*)\\.([1-9][0-9]{0,17})$": False}
    readings = F.array(*[read(pattern, ext) for pattern, ext in patterns.items()])
    blocked = used.select(F.explode(readings).alias("r")).select("r.*").filter("n IS NOT NULL").distinct().join(rows.select("name").distinct(), "name", "left_semi")
    # the i-th number in use, n, moves on by one all turns from n - i + 1: a turn's number is itself and the last such i
    moves = ranked(blocked, ["n"], "i", ["name"]).select("name", (c("n") - c("i")).alias("at"), c("i"), F.lit(0).alias("turn"))
    turns = rows.filter("_turn > 0").select("name", (c("_turn") - 1).alias("at"), F.lit(0).cast("long").alias("i"), c("_turn").alias("turn"))
    line = moves.unionByName(turns).withColumn("block", F.floor(c("at") / TURNS))
    carried = line.groupBy("name", "block").agg(F.max("i").alias("top")).withColumn("carry", F.max("top").over(Window.partitionBy("name").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)))
    so_far = F.max("i").over(Window.partitionBy("name", "block").orderBy("at", c("turn") > 0, "i", "turn").rowsBetween(Window.unboundedPreceding, 0))
    numbers = line.withColumn("i", so_far).filter("turn > 0").join(carried.select("name", "block", "carry"), ["name", "block"])
    numbers = numbers.select("name", c("turn").alias("_turn"), (c("turn") + F.greatest(c("i"), F.coalesce("carry", F.lit(0)))).alias("_n"))
    numbered = F.concat(F.regexp_extract("name", whole, 1), F.lit("."), c("_n").cast("string"), F.regexp_extract("name", whole, 2))
    out = rows.join(numbers, ["name", "_turn"], "left").withColumn("target", F.when(c("_turn") == 0, c("name")).otherwise(numbered))
    return out.select(*moved.columns, "target")


def with_provenance(files: DataFrame, recorded: DataFrame) -> DataFrame:
    """``files`` (name, ...) with discovered_via: what was recorded for the name, else manual.

    ``recorded`` may hold several notes for a name; the least is taken. Records of names that did not come in stay for
    a later batch, see ``unconsumed``.
    """
    own = recorded.groupBy("name").agg(F.min("discovered_via").alias("discovered_via"))
    return files.join(own, "name", "left").withColumn("discovered_via", F.coalesce("discovered_via", F.lit("manual")))


def unconsumed(recorded: DataFrame, succeeded: DataFrame) -> DataFrame:
    """Provenance that stays: of names whose intake has not succeeded yet."""
    return recorded.join(succeeded.select("name").distinct(), "name", "left_anti")


#: Hosts of preprint servers, their subdomains included.
PREPRINT_HOSTS = ("arxiv.org", "ssrn.com", "biorxiv.org", "medrxiv.org", "osf.io")


def promoted_url(entry_url, archived_url):
    """The published address where it is a web address off the preprint servers, else the archived one."""
    h = host(entry_url)
    on_server = F.lit(False)
    for server in PREPRINT_HOSTS:
        on_server = on_server | (h == server) | h.endswith(f".{server}")
    return F.when(is_web_url(entry_url) & ~on_server, entry_url).otherwise(archived_url)


def produced_since(library: DataFrame, started: str) -> DataFrame:
    """Records written after a run began; only these may be quarantined when it fails."""
    return library.filter(F.col("modified") > F.lit(started).cast("timestamp"))


def applied_promotions(library: DataFrame, checks: DataFrame, entries: DataFrame, filed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(library, checks) after promotions, all of each or nothing of it.

    ``entries``: name and rel_path of the preprint that each incoming file replaces; ``filed``: name, rel_path of the new
    record and ok of each intake. Where the intake succeeded the preprint's record and cache entry go and the new record
    gets its published and preprint addresses; where it failed, or is not known, both stay as they were. Two promotions of
    one preprint count once, by the least name. Both results are whole tables, to be published as new versions.
    """
    c = F.col
    done = entries.join(filed.filter("ok").select("name", c("rel_path").alias("new_path")), "name")
    done = done.groupBy("rel_path").agg(F.min(F.struct("name", "new_path")).alias("x")).select("rel_path", "x.new_path")
    old = library.select("rel_path", c("url").alias("archived_url"))
    urls = done.join(old, "rel_path", "left").join(checks.select("rel_path", "published_url"), "rel_path", "left")
    urls = urls.groupBy(c("new_path").alias("rel_path")).agg(F.min(F.struct("published_url", "archived_url")).alias("u"))
    on_web = F.when(is_web_url(c("u.archived_url")), c("u.archived_url"))
    rows = library.join(done.select("rel_path"), "rel_path", "left_anti").join(urls, "rel_path", "left")
    url = F.coalesce(promoted_url(c("u.published_url"), F.lit(None).cast("string")), c("url"))
    other = F.when(F.regexp_replace(blank(on_web), "/+$", "") != F.regexp_replace(blank(url), "/+$", ""), on_web)
    rows = rows.withColumn("preprint_url", F.coalesce(F.nullif(c("preprint_url"), F.lit("")), other)).withColumn("url", url).drop("u")
    return rows.select(*library.columns), checks.join(done.select("rel_path"), "rel_path", "left_anti")
