"""Reading a library of Markdown records with front matter, and the files around it."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from libraryloom.functions.text import section_ids, snippet, tail

SUMMARY = ".summary.md"
HIDDEN = "^[._]"
TEXT_FIELDS = ("title", "source_type", "publication", "date", "url", "preprint_url", "retrieved", "currency_check", "snapshot", "category", "tldr", "source_hash", "status", "superseded_by", "discovered_via")
LIST_FIELDS = ("authors", "tags")


def files(spark: SparkSession, root: str, pattern: str, depth: str = "/*/*") -> DataFrame:
    """path, modified, size, body and the last three parts of the path of the files that match."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(root.rstrip("/") + depth)
    parts = F.split("path", "/")
    at = lambda k: F.element_at(parts, -k)
    return rows.select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("size"), at(3).alias("category"), at(2).alias("slug"), at(1).alias("file"), F.col("content").alias("bytes"))


def front_matter(body: Column) -> Column:
    """What stands between a first line of three hyphens and the next such line; null where there is no such block."""
    end = F.locate("\n---\n", body, 4)
    return F.when(body.startswith("---\n") & (end > 0), F.substring(body, F.lit(5), end - F.lit(4)))


def front_matter_head(body: Column, window: int = 65_536) -> Column:
    """As ``front_matter``, from the first characters; the whole text is searched only where the block is longer."""
    return F.coalesce(front_matter(F.left(body, F.lit(window))), front_matter(body))


def body_after(body: Column) -> Column:
    end = F.locate("\n---\n", body, 4)
    return F.when(body.startswith("---\n") & (end > 0), F.substring(body, end + F.lit(5), F.length(body)))


def line_scalar(block: Column, key: str) -> Column:
    """The value after ``key:`` on its own line, as the line dialect reads it; null where the key is absent."""
    value = F.regexp_extract(block, f"(?m)^{key}:[ \\t]*(.*)$", 1)
    return F.when(block.rlike(f"(?m)^{key}:"), F.trim(value))


def _as_text(value) -> str | None:
    if value is None:
        return None
    if isinstance(value, bool):
        return "true" if value else "false"
    return str(value)


def yaml_loader() -> type:
    """The safe loader, in C where the library has it: reading a block is what a record costs."""
    import yaml

    return getattr(yaml, "CSafeLoader", yaml.SafeLoader)


def parse_yaml(rows: DataFrame, block: str = "block") -> DataFrame:
    """The fields of a YAML block: scalars as text, lists as arrays of text, corrupt where the block can't be read.

    A scalar where a list is expected becomes a list of one; nested values become their text.
    """
    fields = [f"{c} string" for c in TEXT_FIELDS] + [f"{c} array<string>" for c in LIST_FIELDS] + ["corrupt boolean"]
    names = [f.split()[0] for f in fields]

    def load(text: str | None) -> dict:
        import yaml

        out = dict.fromkeys(names)
        out["corrupt"] = text is None
        try:
            found = yaml.load(text, Loader=yaml_loader()) if text else {}
        except (yaml.YAMLError, ValueError):
            found, out["corrupt"] = {}, True
        if not isinstance(found, dict):
            found, out["corrupt"] = {}, found is not None
        for c in TEXT_FIELDS:
            out[c] = _as_text(found.get(c))
        for c in LIST_FIELDS:
            v = found.get(c)
            v = v if isinstance(v, list) else [] if v is None else [v]
            out[c] = [_as_text(x) for x in v if x is not None]
        return out

    @F.pandas_udf(", ".join(fields))
    def parsed(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for series in texts:
            yield pd.DataFrame([load(t) for t in series], columns=names)

    return rows.withColumn("fields", parsed(F.col(block)))


def scan_library(spark: SparkSession, root: str, hidden: bool = False) -> DataFrame:
    """One row per record: rel_path, folder names, block, body, every field of the front matter and what files lie beside it.

    Hidden categories are left out unless asked for. Unreadable records stay, marked corrupt, for the audit.
    """
    rows = files(spark, root, f"*{SUMMARY}")
    if not hidden:
        rows = rows.filter(~F.col("category").rlike(HIDDEN))
    whole = F.col("bytes").cast("string")
    rows = rows.select(
        F.concat_ws("/", "category", "slug", "file").alias("rel_path"), F.col("category").alias("folder"), F.col("slug").alias("slug_folder"),
        F.regexp_replace("file", "\\.summary\\.md$", "").alias("slug"), "modified", front_matter(whole).alias("block"), body_after(whole).alias("body"),
    )
    rows = parse_yaml(rows).select("*", "fields.*").drop("fields")
    return rows.join(originals(spark, root), "rel_path", "left")


def originals(spark: SparkSession, root: str) -> DataFrame:
    """rel_path, original_kind, original_hash and has_snapshot: pdf before snapshot. A snapshot that only announces a candidate is none."""
    own = F.concat(F.concat_ws("/", "category", "slug", "slug"), F.lit(SUMMARY))
    pdf = files(spark, root, "*.pdf").filter(F.col("file") == F.concat("slug", F.lit(".pdf"))).select(own.alias("rel_path"), F.lit(1).alias("rank"), F.sha2("bytes", 256).alias("original_hash"))
    note = line_scalar(front_matter(F.col("bytes").cast("string")), "status") == "candidate-for-intake"
    shot = files(spark, root, "*.snapshot.md").filter(F.col("file") == F.concat("slug", F.lit(".snapshot.md")))
    shot = shot.select(own.alias("rel_path"), F.when(F.coalesce(note, F.lit(False)), 3).otherwise(2).alias("rank"), F.sha2("bytes", 256).alias("original_hash"))
    return best_original(pdf.union(shot))


def best_original(found: DataFrame) -> DataFrame:
    """rel_path, original_kind, original_hash and has_snapshot from rows of rel_path, rank and original_hash.

    Rank 1 is a pdf, 2 a snapshot, and 3 a snapshot that is no original.
    """
    best = found.groupBy("rel_path").agg(F.min(F.struct("rank", "original_hash")).alias("b"), (F.max("rank") > 1).alias("has_snapshot"))
    kind = F.when(F.col("b.rank") == 1, "pdf").when(F.col("b.rank") == 2, "snapshot")
    return best.select("rel_path", kind.alias("original_kind"), F.when(kind.isNotNull(), F.col("b.original_hash")).alias("original_hash"), "has_snapshot")


RUN = "ts string, input_name string, outcome string, output_paths array<string>, error_excerpt string, cost_usd double, duration_ms bigint"


#: Characters of an error that a run keeps, and bytes of a log before it is put aside.
ERROR_TAIL, LOG_BYTES = 2000, 5_242_880


def read_runs(spark: SparkSession, path: str, last: int | None = 20, library: str | None = None) -> DataFrame:
    """Runs of a JSON-lines log with their place from 1, newest first; broken lines are left out. ``last``: how many, None for all.

    A log is appended to, so of runs of one time the later line is the newer; paths are relative to the library where
    ``library`` names its folder.
    """
    rows = spark.read.schema(RUN).option("mode", "DROPMALFORMED").json(path)
    where = [F.col("_metadata.file_modification_time"), F.col("_metadata.file_path"), F.col("_metadata.file_block_start")]
    rows = rows.select("*", *[c.alias(f"_{k}") for k, c in enumerate(where)]).withColumn("_at", F.monotonically_increasing_id())
    rows = rows.orderBy(F.desc_nulls_last("ts"), F.desc("_0"), F.desc("_1"), F.desc("_2"), F.desc("_at"))
    rows = rows if last is None else rows.limit(last)
    order = Window.orderBy(F.desc_nulls_last("ts"), F.desc("_0"), F.desc("_1"), F.desc("_2"), F.desc("_at"))  # what is shown, a page
    rows = rows.withColumn("place", F.row_number().over(order)) if last is not None else rows
    if library is not None:
        root = library.rstrip("/") + "/"
        rows = rows.withColumn("output_paths", F.transform("output_paths", lambda p: F.when(p.startswith(root), F.substring(p, len(root) + 1, 10**6)).otherwise(p)))
    return rows.drop("_0", "_1", "_2", "_at")


def append_runs(runs: DataFrame, path: str) -> None:
    """Add runs to a log of JSON lines, a folder of compressed files; an error excerpt keeps its last 2000 characters."""
    known = [f.split()[0] for f in RUN.split(", ")]
    runs.withColumn("error_excerpt", tail(F.coalesce("error_excerpt", F.lit("")), ERROR_TAIL)).select(*known).write.mode("append").option("ignoreNullFields", "false").option("compression", "gzip").json(path)


def rotated(log: DataFrame, most: int = LOG_BYTES) -> DataFrame:
    """``log`` (name, size, modified: the files of a run log) with archive: whether they go into the one old generation.

    All of them do once their sizes sum to more than ``most``; the generation before is dropped then.
    """
    total = log.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("_total"))  # one row
    return log.crossJoin(F.broadcast(total)).withColumn("archive", F.col("_total") > most).drop("_total")


def read_status(spark: SparkSession, path: str) -> DataFrame:
    """The one row of a status file: outcome, last_run, last_success, failed_steps, detail, consecutive_failures and error.

    A file that can't be read gives a row whose outcome is unreadable and whose error says so.
    """
    shape = "outcome string, last_run string, last_success string, failed_steps string, detail string, consecutive_failures long"
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", shape).alias("s"), F.try_parse_json("value").isNull().alias("bad"))
    return whole.select(F.when(F.col("bad"), "unreadable").otherwise(F.col("s.outcome")).alias("outcome"), *[f"s.{f.split()[0]}" for f in shape.split(", ")[1:]], F.when(F.col("bad"), "unreadable status file").alias("error"))


#: The lists of a health report and what names an entry of each.
HEALTH_LISTS = ("synthesis_drift", "cites_inactive_source", "triage_proposed", "triage_stale", "triage_approved", "unaudited_sources", "currency_check_due", "currency_check_invalid", "sections_overdue")


def read_signals(spark: SparkSession, path: str) -> DataFrame:
    """signal and entry of a health report, JSON with lists of texts or of objects with a file; an unreadable one is an error."""
    whole = spark.read.text(path, wholetext=True).withColumn("_bad", F.try_parse_json("value").isNull())
    lists = F.explode(F.array(*[F.struct(F.lit(k).alias("signal"), F.from_json(F.get_json_object("value", f"$.{k}"), "array<string>").alias("e")) for k in HEALTH_LISTS]))
    rows = whole.filter("NOT _bad").select(lists.alias("x")).select("x.signal", F.explode("x.e").alias("entry"))
    named = F.coalesce(*[F.get_json_object("entry", f"$.{k}") for k in ("file", "path", "source", "id")], F.col("entry"))
    error = whole.filter("_bad").select(F.lit("error").alias("signal"), F.lit("unreadable health report").alias("entry"))
    return rows.select("signal", named.alias("entry")).union(error)


def last_line(lines: DataFrame, by: str = "line", value: str = "value") -> DataFrame:
    """One row: the last line that is not blank, empty if there is none."""
    text = F.trim(F.coalesce(value, F.lit("")))
    return lines.agg(F.coalesce(F.max_by(F.when(text != "", F.col(value)), F.when(text != "", F.col(by))), F.lit("")).alias("last"))


CHECK = "struct<title:string,preprint_venue:string,preprint_id:string,preprint_url:string,checked_at:string,status:string,confidence:string,match_score:double,publication:string,venue_type:string,version:string,published_url:string,doi:string,published_doi:string,published_title:string,note:string,error:string>"


def read_checks(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a cache of preprint checks, a JSON map by rel_path; a file that can't be read gives none."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", f"map<string,{CHECK}>").alias("m"))
    return whole.select(F.explode("m").alias("rel_path", "c")).select("rel_path", "c.*")


def checks_text(checks: DataFrame) -> DataFrame:
    """One row, value: a cache of preprint checks as the JSON map that ``read_checks`` reads, in the order of the paths.

    The cache is one file, so its text is one row; tables of other sizes are published by ``versions.publish``.
    """
    fields = [c for c in checks.columns if c != "rel_path"]
    entry = F.struct("rel_path", F.struct(*fields).alias("c"))
    return checks.agg(F.sort_array(F.collect_list(entry)).alias("e")).select(F.to_json(F.map_from_entries("e")).alias("value"))


def read_references(spark: SparkSession, path: str) -> DataFrame:
    """place, key, short_cite and cited_in from a Markdown file of blocks that start with a third-level heading.

    Blocks without a path into the library are left out. Of blocks with one path the last one says what is cited, at the
    place of the first.
    """
    blocks = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "(?m)^### ")).alias("place", "block")).filter("place > 0")
    key = F.regexp_extract("block", "\\*\\*Library path:\\*\\*\\s*`library/([^/`]+/[^/`]+)/?`", 1)
    cited = section_ids(F.regexp_extract("block", "\\*\\*Cited in:\\*\\*\\s*(.+)", 1))
    rows = blocks.select("place", key.alias("key"), F.trim(F.substring_index("block", "\n", 1)).alias("short_cite"), cited.alias("cited_in")).filter("key <> ''")
    rows = rows.groupBy("key").agg(F.min("place").alias("place"), F.max(F.struct("place", "short_cite", "cited_in")).alias("x"))
    return rows.select("place", "key", "x.short_cite", "x.cited_in")


def read_sections(spark: SparkSession, root: str) -> DataFrame:
    """file and key: the paths into the library that each section document names in its front matter; drafts are left out."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").option("recursiveFileLookup", "true").load(root)
    rows = rows.filter(~F.col("path").endswith(".draft.md"))
    keys = F.regexp_extract_all(front_matter(F.col("content").cast("string")), F.lit("library_path:\\s*[\"']?library/([^\"'\\n]+)"), 1)
    return rows.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.explode(keys).alias("key")).select("file", F.regexp_replace(F.trim("key"), "/+$", "").alias("key")).distinct()


def index_links(text: Column) -> Column:
    """The record paths that an index links to; links with spaces or closing brackets inside are not seen."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit("\\]\\(([^) \\n]+\\.summary\\.md)\\)"), 1))


#: What the event view shows for a tool: icon, and text with the names of its arguments in braces, a default
#: after a colon, ``!`` for the first line alone.
TOOLS = {
    "Read": ("📖", "Read {file_path}"),
    "Edit": ("✏️", "Edit {file_path}"),
    "Write": ("✏️", "Write {file_path}"),
    "Bash": ("$", "{!command}"),
    "Grep": ("🔍", "Grep '{pattern}' in {path:.}"),
    "Glob": ("🔍", "Glob {pattern}"),
    "WebFetch": ("🌐", "WebFetch {url}"),
    "Skill": ("🧰", "Skill: {skill:?}"),
}
OTHER_TOOL, TODOS, SAID, ODD_LINE, BEGUN, ENDED, DONE, BROKEN = "🔧", "📋", "💬", "?", "▶", "■", "✅", "❌"


def _template(text: str, given: Column) -> Column:
    """A text of TOOLS with the arguments of a call put in."""
    out = []
    for piece in re.split("(\\{[^}]*\\})", text):
        if not piece.startswith("{"):
            out.append(F.lit(piece))
            continue
        name, _, default = piece.strip("{}").partition(":")
        value = F.coalesce(given[name.lstrip("!")], F.lit(default))
        out.append(F.left(F.substring_index(value, "\n", 1), F.lit(200)) if name.startswith("!") else value)
    return F.concat(*out)


def events(lines: DataFrame, value: str = "value") -> DataFrame:
    """line, icon and text of the events of a run log, one row per shown block; unknown lines keep their start.

    ``lines``: line (its number) and the raw text. Tool results and unknown systems are not shown; a null line is blank.
    """
    raw = F.trim(F.coalesce(value, F.lit("")))
    field = lambda path: F.get_json_object(raw, path)
    row = lambda icon, text: F.struct((F.lit(icon) if isinstance(icon, str) else icon).alias("icon"), text.alias("text"))
    none = F.array().cast("array<struct<icon:string,text:string>>")
    call = "array<struct<type:string,text:string,name:string,input:map<string,string>>>"

    def used(b: Column) -> Column:
        given, name = F.coalesce(b["input"], F.create_map().cast("map<string,string>")), F.coalesce(b["name"], F.lit("?"))
        todos = F.coalesce(F.json_array_length(given["todos"]), F.lit(0)).cast("string")
        special = {"TodoWrite": row(TODOS, F.concat(F.lit("todos updated ("), todos, F.lit(" items)")))}
        known = {tool: row(icon, _template(text, given)) for tool, (icon, text) in TOOLS.items()} | special
        out = row(OTHER_TOOL, F.concat(name, F.lit("("), F.array_join(F.slice(F.map_keys(given), 1, 2), ", "), F.lit(")")))
        for tool, shown in known.items():
            out = F.when(name == tool, shown).otherwise(out)
        return out

    def block(b: Column) -> Column:
        said = F.trim(F.coalesce(b["text"], F.lit("")))
        return F.when(b["type"] == "tool_use", used(b)).when((b["type"] == "text") & (said != ""), row(SAID, snippet(said)))

    cost = F.coalesce(F.nullif(field("$.total_cost_usd").cast("double"), F.lit(0.0)), field("$.cost_usd").cast("double"), F.lit(0.0))
    seconds = F.coalesce(field("$.duration_ms").cast("double"), F.lit(0.0)) / 1000
    ended = F.concat(F.coalesce(field("$.subtype"), F.lit("")), F.format_string(" (%.1fs, $%.3f)", seconds, cost))
    told = lambda before, path, other, after="": F.concat(F.lit(before), F.coalesce(field(path), F.lit(other)), F.lit(after))
    kinds = {
        "meta/start": F.array(row(BEGUN, told("started: ", "$.input", ""))),
        "meta/end": F.array(row(ENDED, told("run ended (exit ", "$.exit", "?", ")"))),
        "system/init": F.array(row(BEGUN, told("session ready (model: ", "$.model", "?", ")"))),
        "assistant/": F.array_compact(F.transform(F.from_json(field("$.message.content"), call), block)),
        "result/": F.array(row(F.when(field("$.subtype") == "success", DONE).otherwise(BROKEN), ended)),
    }
    kind = field("$.type")
    detail = F.when(kind == "meta", field("$.kind")).when(kind == "system", field("$.subtype"))
    key = F.concat(F.coalesce(kind, F.lit("")), F.lit("/"), F.coalesce(detail, F.lit("")))
    shown = none
    for name, rows in kinds.items():
        shown = F.when(key == name, rows).otherwise(shown)
    shown = F.when(raw == "", none).when(F.try_parse_json(raw).isNull(), F.array(row(ODD_LINE, F.left(raw, F.lit(300))))).otherwise(shown)
    return lines.select("line", F.explode(shown).alias("e")).select("line", "e.*")


def note_url(body: Column) -> Column:
    """The address to fetch of a plain candidate note, its document's before its page's; NONE for a candidate without one.

    Null for what is no candidate note.
    """
    block = front_matter(body)
    bare = lambda k: F.regexp_replace(F.coalesce(line_scalar(block, k), F.lit("")), "^[\"']|[\"']$", "")
    url = F.coalesce(F.nullif(bare("pdf_url"), F.lit("")), bare("url"))
    return F.when(bare("status") == "candidate-for-intake", F.when(url.rlike("^https?://"), url).otherwise("NONE"))


def candidate_targets(notes: DataFrame) -> DataFrame:
    """name, place, slug and url of the fetchable entries of candidate notes (name, body), in document order.

    A note counts if its status is candidate-for-intake and its sources are a list with entries; a plain note with one
    address gives that address. Entries without an http address are left out, but count for fallback names.
    """
    from libraryloom.functions.text import kebab
    from libraryloom.functions.urls import is_web_url, slug_from_url

    @F.pandas_udf("array<struct<slug:string,url:string>>")
    def entries(texts: pd.Series) -> pd.Series:
        import yaml

        out = []
        for t in texts:
            try:
                fm = yaml.load(t, Loader=yaml_loader()) if t else None
            except yaml.YAMLError:
                fm = None
            rows = []
            if isinstance(fm, dict) and str(fm.get("status") or "").strip() == "candidate-for-intake":
                found = fm.get("sources")
                found = found if isinstance(found, list) and found else [{"url": fm.get("pdf_url") or fm.get("url")}]
                for e in found:
                    e = e if isinstance(e, dict) else {"url": e if isinstance(e, str) else None}
                    rows.append({"slug": str(e.get("slug") or "").strip(), "url": str(e.get("pdf_url") or e.get("url") or "").strip()})
            out.append(rows)
        return pd.Series(out)

    rows = notes.select("name", F.posexplode(entries(front_matter(F.col("body")))).alias("k", "e")).filter(is_web_url(F.col("e.url")))
    place = F.col("k") + 1
    own = kebab(F.col("e.slug"))
    slug = F.when(F.col("e.slug") == "", slug_from_url(F.col("e.url"), place)).when(own != "", own).otherwise(F.concat(F.lit("candidate-"), place.cast("string")))
    return rows.select("name", place.alias("place"), slug.alias("slug"), F.col("e.url").alias("url"))
