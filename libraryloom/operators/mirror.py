"""Differences of two snapshots, and guards on what may be removed or pushed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def mirror_plan(library: DataFrame, mirror: DataFrame, most_deleted: int = 25) -> DataFrame:
    """path, change (new, changed, deleted, same) and remove: what bringing ``mirror`` up to ``library`` would do.

    Both have path and hash. If more than ``most_deleted`` paths would go, none is removed.
    """
    both = library.select("path", F.col("hash").alias("here")).distinct().join(mirror.select("path", F.col("hash").alias("there")).distinct(), "path", "full_outer")
    change = F.when(F.col("here").isNull(), "deleted").when(F.col("there").isNull(), "new").when(F.col("here") != F.col("there"), "changed").otherwise("same")
    both = both.select("path", change.alias("change"))
    gone = both.agg(F.count_if(F.col("change") == "deleted").alias("_gone"))
    return both.crossJoin(F.broadcast(gone)).select("path", "change", ((F.col("change") == "deleted") & (F.col("_gone") <= most_deleted)).alias("remove"), "_gone").withColumnRenamed("_gone", "pending")


def sync_history(runs: DataFrame) -> DataFrame:
    """``runs`` (run_at, ok and, for several, mirror) with last_success and consecutive_failures as of each run, in order of run_at."""
    by = [c for c in ("mirror",) if c in runs.columns]
    w = Window.partitionBy(*by).orderBy("run_at").rowsBetween(Window.unboundedPreceding, 0)
    rows = runs.withColumn("last_success", F.last(F.when(F.col("ok"), F.col("run_at")), ignorenulls=True).over(w)).withColumn("_island", F.sum(F.col("ok").cast("int")).over(w))
    own = Window.partitionBy(*by, "_island").orderBy("run_at").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("consecutive_failures", F.count_if(~F.col("ok")).over(own)).drop("_island")


def report_commits(paths: DataFrame) -> DataFrame:
    """Per commit whether every path is a triage report (README excluded), from rows (commit, path)."""
    report = F.col("path").rlike("^triage/[^/]+\\.md$") & ~F.col("path").rlike("(^|/)README\\.md$")
    return paths.groupBy("commit").agg(F.bool_and(report).alias("only_reports"), F.count(F.lit(1)).alias("paths"))


def may_push(paths: DataFrame) -> DataFrame:
    """One row: whether all unpushed commits touch only reports. Nothing unpushed may be pushed."""
    return report_commits(paths).agg(F.coalesce(F.bool_and("only_reports"), F.lit(True)).alias("may_push"), F.count(F.lit(1)).alias("ahead"))


def kept_history(plan: DataFrame, folder: str) -> DataFrame:
    """path, change and kept: where a run keeps each file that its mirror loses, by ``mirror_plan``'s rows.

    Replaced files are always kept, removed ones where they are removed.
    """
    lost = plan.filter((F.col("change") == "changed") | F.col("remove"))
    return lost.select("path", "change", F.concat(F.lit(f"{folder.rstrip('/')}/"), "path").alias("kept"))


def sync_record(plan: DataFrame, folder: str, at: str, most_deleted: int = 25) -> DataFrame:
    """One row on a run of the mirror: run_at, ok, mirror_deleted, replaced, history_dir (empty if nothing was kept) and detail.

    A run that would have removed too many files removes none and has failed.
    """
    c = F.col
    n = plan.agg(F.count_if("remove").alias("mirror_deleted"), F.count_if(c("change") == "changed").alias("replaced"), F.count_if(c("change") == "deleted").alias("gone"))
    ok = c("gone") <= most_deleted
    detail = F.concat(c("gone").cast("string"), F.lit(f" files would be deleted from the mirror (limit {most_deleted}); deleted none"))
    return n.select(F.lit(at).alias("run_at"), ok.alias("ok"), "mirror_deleted", "replaced", F.when(c("mirror_deleted") + c("replaced") > 0, folder).otherwise("").alias("history_dir"), F.when(~ok, detail).otherwise("").alias("detail"))


def report_changes(paths: DataFrame, tracked: DataFrame) -> DataFrame:
    """path and kind (new, changed) of the triage reports among touched paths; other paths are left out."""
    report = F.col("path").rlike("^triage/[^/]+\\.md$") & ~F.col("path").rlike("(^|/)README\\.md$")
    known = tracked.select("path").distinct().withColumn("_known", F.lit(1))
    return paths.select("path").distinct().filter(report).join(known, "path", "left").select("path", F.when(F.col("_known") == 1, "changed").otherwise("new").alias("kind"))
