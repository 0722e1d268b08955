"""After a run that was cut short or failed: staged inputs go back to the inbox, what the run left half done is set aside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from libraryloom.operators.intake import outcome_names
from libraryloom.sources.scratch import cut

#: Fixed value: what staging puts before a file's name.
STAGED = "^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}-"
SUMMARY = ".summary.md"


def recovered(staged: DataFrame, inbox: DataFrame) -> DataFrame:
    """staged, action and target of the files (name) that a run left in its staging folder.

    A file with the prefix of staging is the only copy of an input: ``return`` to the inbox under its own name, or the
    next free one (``outcome_names``; of files of one name the least staged name comes first). Anything else is a stray,
    ``remove``, without target. A name that is nothing but the prefix counts as taken. ``inbox``: name of the files there.
    """
    c = F.col
    mine = c("name").rlike(STAGED)
    back = staged.filter(mine).select(c("name").alias("staged"), F.regexp_replace("name", STAGED, "").alias("name"))
    taken = inbox.select("name").union(staged.sparkSession.range(1).select(F.lit("")))
    named = outcome_names(back, taken).select("staged", F.lit("return").alias("action"), "target")
    return named.union(staged.filter(~mine).select("name", F.lit("remove"), F.lit(None).cast("string")))


def _above(path: Column) -> Column:
    """The folders that a path lies in, the outermost first; none for a path without a slash."""
    parts = F.split(path, "/", -1)
    inner = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    return F.when(F.size(parts) > 1, inner).otherwise(F.array().cast("array<string>"))


def quarantine(before: DataFrame, after: DataFrame, started: str, taken: DataFrame, place: str = "_partial") -> DataFrame:
    """What happens to the folders in which a failed run wrote records: folder, action, target, files, emptied.

    ``before`` and ``after``: rel_path and modified of the library's files when the run began and when it had failed. A
    record counts as written when it is newer than ``started`` and was not there, with that time, before. Its folder is
    set aside (``move``) only where the run made it, that is where no file was in or below it before; else the folder is
    the user's and is left alone (``keep``). A folder inside another one that moves goes with it and has no row of its own.
    ``target`` is the folder's name under ``place``, with the least free number after it where ``taken`` (name) or another
    folder has the name; ``files`` counts all that moves along; ``emptied`` is the folder around it where nothing is left
    in that. Records at the top of the library have no folder and no row.
    """
    c = F.col
    ours = F.regexp_extract("rel_path", "^(.*)/[^/]*$", 1)
    written = after.filter(c("rel_path").endswith(SUMMARY) & (c("modified") > F.lit(started).cast("timestamp")))
    written = written.join(before.select("rel_path", "modified"), ["rel_path", "modified"], "left_anti")
    found = cut(written.select(ours.alias("folder")).filter("folder <> ''").distinct(), "written")
    known = before.select(F.explode(_above(c("rel_path"))).alias("folder")).distinct()
    new = cut(found.join(known, "folder", "left_anti"), "new")
    inner = new.select("folder", F.explode(_above(c("folder"))).alias("around")).join(new.select(c("folder").alias("around")), "around", "left_semi")
    moved = new.join(inner.select("folder").distinct(), "folder", "left_anti").select("folder", F.regexp_extract("folder", "([^/]*)$", 1).alias("name"))
    moved = cut(outcome_names(moved, taken, False).select("folder", F.concat(F.lit(f"{place}/"), "target").alias("target")), "moved")

    held = after.select("rel_path", F.explode(_above(c("rel_path"))).alias("folder"))
    gone = cut(held.join(moved.select("folder"), "folder"), "gone")
    sizes = gone.groupBy("folder").agg(F.count(F.lit(1)).alias("files"))
    full = held.join(gone.select("rel_path"), "rel_path", "left_anti").select(c("folder").alias("around")).distinct()
    out = moved.join(sizes, "folder").withColumn("around", F.regexp_extract("folder", "^(.*)/[^/]*$", 1))
    out = out.join(full.withColumn("left", F.lit(True)), "around", "left")
    empty = F.when(c("left").isNull() & (c("around") != ""), c("around"))
    kept = found.join(new, "folder", "left_anti")
    rows = out.select("folder", F.lit("move").alias("action"), "target", "files", empty.alias("emptied"))
    return rows.union(kept.select("folder", F.lit("keep"), F.lit(None).cast("string"), F.lit(0).cast("long"), F.lit(None).cast("string")))
