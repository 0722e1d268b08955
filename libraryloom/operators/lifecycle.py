"""What follows from a source's retirement, and the console that says what needs attention."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from libraryloom.functions import measures
from libraryloom.operators.matching import places

STALE_HOURS = 36
#: Sequence numbers of a day's changelog that are ordered together.
BUNCH = 10_000
ENTRIES = 8
READY = (5, 20)
#: The console's list cards in order: key, title and the signal that they list.
LIST_CARDS = (
    ("triage", "Triage reports awaiting a decision", "triage_proposed"),
    ("triage-approved", "Approved triage ready to apply", "triage_approved"),
    ("retired-cites", "Book sections citing retired sources", "cites_inactive_source"),
    ("drift-guides", "Guides behind the synthesis", "synthesis_drift:derived/"),
    ("drift-sections", "Book sections behind the synthesis", "synthesis_drift:"),
    ("unaudited", "Library sources not yet audited", "unaudited_sources"),
    ("currency", "Library currency checks", "currency_check_due"),
    ("overdue", "Sections past their refresh cadence", "sections_overdue"),
)
#: The titles of the other cards, and how a late entry is marked.
OTHER_TITLES = {"backup-digest": "Digest database backup", "backup-library": "Library committed and on the NAS", "digest-flags": "Digest library candidates", "recalibrate": "Digest judge recalibration", "health": "Pipeline health report", "gate-c": "Human review (Gate C)"}
LATE = " · over 14 days"


def retirement_reports(library: DataFrame, references: DataFrame, sections: DataFrame, existing: DataFrame) -> DataFrame:
    """New triage reports: key, rel_path, status, verdict, short_cite, cited_in, files, successor and successor_cite.

    One for each retired source without a report; review-citations where it is cited or used, else no-effect.
    ``references``: place, key, short_cite, cited_in; ``sections``: file, key; ``existing``: key.
    """
    c = F.col
    retired = library.filter(measures.is_retired(c("status"), c("superseded_by")))
    rows = retired.select("rel_path", measures.status(c("status"), c("superseded_by")).alias("status"), F.concat_ws("--", "folder", "slug").alias("key"), F.concat_ws("/", "folder", "slug").alias("source"), F.coalesce(measures.filled(c("superseded_by")), F.lit("")).alias("successor"))
    rows = rows.join(existing.select("key"), "key", "left_anti")
    first = references.groupBy(c("key").alias("source")).agg(F.min(F.struct("place", "short_cite", "cited_in")).alias("r"))
    used = sections.groupBy(c("key").alias("source")).agg(F.sort_array(F.collect_set("file")).alias("files"))
    by_slug = references.groupBy(F.element_at(F.split("key", "/"), -1).alias("successor")).agg(F.min(F.struct("place", "short_cite")).alias("s"))
    rows = rows.join(first, "source", "left").join(used, "source", "left").join(by_slug, "successor", "left")
    none = F.array().cast("array<string>")
    cited, files = F.coalesce(c("r.cited_in"), none), F.coalesce("files", none)
    verdict = F.when((F.size(cited) > 0) | (F.size(files) > 0), "review-citations").otherwise("no-effect")
    return rows.select("key", "rel_path", "status", verdict.alias("verdict"), c("r.short_cite").alias("short_cite"), cited.alias("cited_in"), files.alias("files"), "successor", c("s.short_cite").alias("successor_cite"))


def rhythm(tasks: DataFrame, now: str) -> DataFrame:
    """``tasks`` (task, cadence, last: date as text) with age_days and due; tasks without a last date are never due."""
    age = measures.days_between(F.try_to_timestamp("last"), F.lit(now).cast("timestamp"))
    return tasks.withColumn("age_days", age).withColumn("due", measures.is_due(F.col("age_days"), F.col("cadence")))


def _card(place: int, key: str, rows: DataFrame, severity: Column, count: Column, failed: str = "warn") -> DataFrame:
    """One card; where its source gave an error, that alone, with the severity ``failed``."""
    broken = F.col("error").isNotNull()
    fields = [F.lit(place).alias("place"), F.lit(key).alias("key"), F.lit(OTHER_TITLES[key]).alias("title")]
    return rows.select(*fields, F.when(broken, failed).otherwise(severity).alias("severity"), F.when(broken, "—").otherwise(count).alias("count"), F.array().cast("array<string>").alias("entries"), "error")


def cards(signals: DataFrame, digest: DataFrame, backups: DataFrame, gate: DataFrame, now: str) -> DataFrame:
    """place, key, title, severity, count (as text), entries and error of the console's cards, the worst first, else as listed.

    ``signals``: signal and entry, or signal "error" whose entry says why nothing could be gathered. ``digest``: one row
    of flagged, landed, added, dismissed and error. ``backups``: one row of outcome, age_hours, uncommitted, unpushed,
    sync_outcome (null: never synced, which is no fault), sync_age_hours and error. ``gate``: file, done (signed off) and,
    where others than those not done wait, waiting. A source that fails is one card with its error, and the others are
    shown all the same; without a digest there is nothing to recalibrate.
    """
    c = F.col
    hours = lambda x: F.round(x, 1)
    stale = c("age_hours").isNull() | (hours(c("age_hours")) > STALE_HOURS) | ~c("outcome").eqNullSafe("ok")
    aged = F.when(c("age_hours").isNull(), "never").otherwise(F.concat(F.format_string("%.1f", hours(c("age_hours"))), F.lit("h")))
    out = [_card(0, "backup-digest", backups, F.when(stale, "bad").otherwise("ok"), aged, "bad")]
    unsynced = c("sync_outcome").isNotNull() & ((c("sync_outcome") != "ok") | c("sync_age_hours").isNull() | (hours(c("sync_age_hours")) > STALE_HOURS))
    paths = F.coalesce("uncommitted", F.lit(0)) + F.coalesce("unpushed", F.lit(0))
    loose = (paths > 0) | unsynced
    library = backups.withColumn("error", F.lit(None).cast("string"))  # judged by its own signals
    out.append(_card(1, "backup-library", library, F.when(loose, "bad").otherwise("ok"), F.when(paths > 0, paths.cast("string")).when(unsynced, "sync failed").otherwise("0")))
    out.append(_card(2, "digest-flags", digest, F.when((c("flagged") > 0) | (c("landed") > 0), "warn").otherwise("ok"), (c("flagged") + c("landed")).cast("string")))
    ready = (c("added") >= READY[0]) & (c("dismissed") >= READY[1])
    out.append(_card(3, "recalibrate", digest.filter("error IS NULL"), F.when(ready, "warn").otherwise("ok"), F.concat(c("added").cast("string"), F.lit("/"), c("dismissed").cast("string"))))
    broken = signals.filter("signal = 'error'").select(c("entry").alias("error")).limit(1)
    out.append(_card(4, "health", broken, F.lit("warn"), F.lit("—")))
    drift = c("signal") == "synthesis_drift"
    family = F.when(drift & c("entry").startswith("derived/"), "synthesis_drift:derived/").when(drift, "synthesis_drift:").when(c("signal") == "triage_stale", "none").otherwise(c("signal"))
    found = signals.filter("signal <> 'error'").select(family.alias("signal"), "entry")
    late = signals.filter("signal = 'triage_stale'").select(F.lit("triage_proposed").alias("signal"), "entry", F.lit(LATE).alias("mark")).distinct()
    found = found.join(late, ["signal", "entry"], "left").select("signal", F.concat("entry", F.coalesce("mark", F.lit(""))).alias("entry"))
    lists = signals.sparkSession.createDataFrame([(5 + k, key, title, signal) for k, (key, title, signal) in enumerate(LIST_CARDS)], "place int, key string, title string, signal string")
    lists = lists.join(broken, F.lit(True), "left_anti")  # an error in place of all lists
    listed = lists.join(found, "signal", "left").groupBy("place", "key", "title").agg(F.count("entry").alias("n"), F.sort_array(F.collect_list("entry")).alias("entries"))
    none = F.lit(None).cast("string").alias("error")
    out.append(listed.select("place", "key", "title", F.when(c("n") > 0, "warn").otherwise("ok").alias("severity"), c("n").cast("string").alias("count"), "entries", none))
    out.append(_review(gate, found).select(F.lit(20).alias("place"), F.lit("gate-c").alias("key"), F.lit(OTHER_TITLES["gate-c"]).alias("title"), F.when(c("n") > 0, "warn").otherwise("ok").alias("severity"), "count", "entries", none))
    every = reduce(DataFrame.unionByName, out)
    return every.orderBy(measures.severity_rank(c("severity")), "place")


def _review(gate: DataFrame, found: DataFrame) -> DataFrame:
    """One row of the review queue: n waiting, count done of all, and entries: the first files and how many more there are.

    Files with a signal come first, then those of sections 10 to 29, then the rest, each by name.
    """
    c = F.col
    waiting = gate.filter(c("waiting") if "waiting" in gate.columns else ~c("done")).select("file")
    flagged = found.filter(c("signal").isin("synthesis_drift:derived/", "synthesis_drift:", "cites_inactive_source")).select(c("entry").alias("file"), F.lit(1).alias("flag")).distinct()
    number = F.regexp_extract("file", "^docs/([0-9]+)-", 1).try_cast("int")
    queue = waiting.join(flagged, "file", "left").select("file", F.when(c("flag") == 1, 0).when(number.between(10, 29), 1).otherwise(2).alias("rank"))
    first = queue.orderBy("rank", "file").limit(ENTRIES).agg(F.sort_array(F.collect_list(F.struct("rank", "file"))).alias("first"))
    total = gate.agg(F.concat(F.count_if("done").cast("string"), F.lit("/"), F.count(F.lit(1)).cast("string")).alias("count"))
    n = queue.agg(F.count(F.lit(1)).alias("n"))
    rows = n.crossJoin(F.broadcast(first)).crossJoin(F.broadcast(total))  # one row each
    more = F.concat(F.lit("…and "), (c("n") - ENTRIES).cast("string"), F.lit(" more"))
    return rows.select("n", "count", F.when(c("n") > ENTRIES, F.concat("first.file", F.array(more))).otherwise(c("first.file")).alias("entries"))


def attention(found: DataFrame) -> DataFrame:
    """One row: how many cards need something and how many are urgent."""
    return found.agg(F.count_if(F.col("severity") != "ok").alias("need"), F.count_if(F.col("severity") == "bad").alias("urgent"))


def run_summary(events: DataFrame) -> DataFrame:
    """input_name, cost_usd and duration_ms from result events; a run without a cost or time seen has null."""
    cost = F.coalesce(F.nullif(F.col("total_cost_usd"), F.lit(0.0)), F.col("cost_usd"))
    return events.filter("type = 'result'").groupBy("input_name").agg(F.sum(cost).alias("cost_usd"), F.sum("duration_ms").alias("duration_ms"))


def changelog(entries: DataFrame) -> DataFrame:
    """place and line: a heading for each day, the newest first and marked, and under it its entries, the newest first.

    ``entries``: at (timestamp), seq and text.
    """
    rows = entries.withColumn("day", F.date_format("at", "yyyy-MM-dd"))
    days = rows.groupBy("day").agg(F.count(F.lit(1)).alias("n"))
    newest = Window.orderBy(F.desc("day"))  # a row for each day
    days = days.withColumn("base", F.coalesce(F.sum(F.col("n") + 1).over(newest.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("_k", F.row_number().over(newest))
    head = days.select((F.col("base") + 1).cast("long").alias("place"), F.concat(F.lit("## "), "day", F.when(F.col("_k") == 1, " (latest)").otherwise("")).alias("line"))
    body = places(rows, ["day"], [F.floor(F.col("seq") / BUNCH)], [F.desc("seq")], "c")
    body = body.join(days.select("day", "base"), "day")
    return head.union(body.select((F.col("base") + 1 + F.col("c")).cast("long").alias("place"), F.concat(F.lit("- "), "text").alias("line")))


def expired(archives: DataFrame, keep: int = 50) -> DataFrame:
    """Names beyond the newest ``keep``, by name; a name that is repeated counts once and a null one is no archive.

    Only the newest ``keep`` are put in order (each task sends its own); the others are those below the last of them.
    """
    names = archives.select("name").filter("name IS NOT NULL").distinct()
    newest = names.orderBy(F.desc("name")).limit(keep).collect()  # at most ``keep`` names
    if len(newest) < keep:
        return names.limit(0)
    return names.filter(F.col("name") < F.lit(newest[-1].name)) if keep > 0 else names


def landed(items: DataFrame, library: DataFrame) -> DataFrame:
    """Downloaded items (kind, id, library_status, ...) that a record names as where it was found."""
    have = library.select(F.col("discovered_via").alias("_via")).distinct()
    key = F.concat(F.lit("digest:"), "kind", F.lit("/"), F.col("id").cast("string"))
    return items.filter("library_status = 'downloaded'").join(have, key == F.col("_via"), "left_semi")


def digest_signals(items: DataFrame, library: DataFrame, now: str, recalibrated: str | None = None) -> DataFrame:
    """One row of flagged, downloaded, landed, flagged_this_week, added, dismissed, ready and error.

    ``items``: kind, id, ts, open, library_status and library_reviewed_at, times as text. A time that can't be read is no
    time. Labels count after ``recalibrated``; dismissals of one moment are one decision.
    """
    c = F.col
    seen = F.try_to_timestamp("ts") >= F.lit(now).cast("timestamp") - F.expr("INTERVAL 7 DAYS")
    reviewed = F.try_to_timestamp("library_reviewed_at")
    counted = reviewed.isNotNull() if recalibrated is None else reviewed > F.lit(recalibrated).cast("timestamp")
    label = lambda s: (c("library_status") == s) & F.coalesce(counted, F.lit(False))
    out = items.agg(
        F.count_if(c("open") & (c("library_status") == "flagged")).alias("flagged"), F.count_if(c("open") & (c("library_status") == "downloaded")).alias("downloaded"),
        F.count_if(seen).alias("flagged_this_week"), F.count_if(label("added")).alias("added"), F.countDistinct(F.when(label("dismissed"), reviewed)).alias("dismissed"),
    )
    held = landed(items.filter("open"), library).agg(F.count(F.lit(1)).alias("landed"))
    ready = (c("added") >= READY[0]) & (c("dismissed") >= READY[1])
    return out.crossJoin(F.broadcast(held)).withColumn("ready", ready).withColumn("error", F.lit(None).cast("string"))  # one row each


def oldest_open(items: DataFrame, most: int = 5) -> DataFrame:
    """The flagged open items that wait longest, those without a time first."""
    return items.filter("open AND library_status = 'flagged'").orderBy(F.coalesce("ts", F.lit("")), "kind", "id").limit(most)


def backup_age(status: DataFrame, now: str) -> DataFrame:
    """``status`` (outcome, last_success, ...) with age_hours, to a tenth, and stale: not ok, never, or too long ago."""
    then = F.try_to_timestamp("last_success")
    age = F.round((F.unix_seconds(F.lit(now).cast("timestamp")) - F.unix_seconds(then)) / 3600, 1)
    stale = age.isNull() | (age > STALE_HOURS) | ~F.col("outcome").eqNullSafe("ok")
    return status.withColumn("age_hours", age).withColumn("stale", stale)


def last_done(commits: DataFrame, tasks: DataFrame) -> DataFrame:
    """``tasks`` (task, path, ...) with last: the day of the last commit (at, path) that touched its path or what lies in it."""
    root = F.regexp_replace("path", "/+$", "")
    folders = F.transform(F.sequence(F.lit(1), F.size(F.split("path", "/"))), lambda k: F.array_join(F.slice(F.split("path", "/"), 1, k), "/"))
    touched = commits.select("at", F.explode(folders).alias("_root")).groupBy("_root").agg(F.date_format(F.max("at"), "yyyy-MM-dd").alias("last"))
    return tasks.withColumn("_root", root).join(touched, "_root", "left").drop("_root")


def summary_text(found: DataFrame, routines: DataFrame, generated: str, url: str) -> DataFrame:
    """place and line of the console as text: what needs attention, the worst first, and what is overdue.

    ``found``: cards; ``routines``: what ``rhythm`` gives, with place for their order.
    """
    c = F.col
    need = found.filter("severity <> 'ok'")
    line = lambda a, b, text: F.struct(F.lit(a).alias("a"), b.cast("long").alias("b"), text.alias("line"))
    head = found.sparkSession.createDataFrame([(0, 0, f"Currency console — {generated}"), (0, 1, url), (0, 2, "")], "a int, b long, line string")
    rank = measures.severity_rank(c("severity")) * 1000 + c("place")
    body = need.select(line(1, rank, F.concat(F.lit("["), F.upper("severity"), F.lit("] "), "title", F.lit(": "), "count")).alias("x")).select("x.*")
    calm = need.agg(F.count(F.lit(1)).alias("n")).filter("n = 0").select(line(1, F.lit(0), F.lit("Nothing needs you this week.")).alias("x")).select("x.*")
    late = routines.filter("due").agg(F.sort_array(F.collect_list(F.struct("place", "task"))).alias("t")).filter(F.size("t") > 0)
    late = late.select(F.explode(F.array(line(2, F.lit(0), F.lit("")), line(2, F.lit(1), F.concat(F.lit("Overdue routines: "), F.array_join("t.task", ", "))))).alias("x")).select("x.*")
    out = head.union(body).union(calm).union(late)
    return out.select(F.row_number().over(Window.orderBy("a", "b")).cast("long").alias("place"), "line")  # one short text


def notification(found: DataFrame, url: str) -> DataFrame:
    """One row, message: how many cards need something, and how many at once."""
    n = attention(found)
    urgent = F.when(F.col("urgent") > 0, F.concat(F.lit(", "), F.col("urgent").cast("string"), F.lit(" urgent"))).otherwise("")
    text = F.concat(F.col("need").cast("string"), F.lit(" item(s) need you"), urgent, F.lit(f" — open {url}"))
    return n.select(F.when(F.col("need") == 0, "Nothing needs you this week.").otherwise(text).alias("message"))
