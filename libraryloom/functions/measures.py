"""Column functions over states, dates, ages and sizes. The present time is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from libraryloom.functions.text import blank

RETIRED = ("superseded", "retracted", "withdrawn")
STATUSES = ("active", *RETIRED)
EMPTY_WORDS = ("", "null", "~", "none")
CADENCE_DAYS = {"weekly": 7, "monthly": 31, "quarterly": 92}
SEVERITY = ("bad", "warn", "ok")


def filled(c: Column) -> Column:
    """A scalar of the line dialect, null where it is one of the spellings of nothing."""
    v = F.trim(blank(c))
    return F.when(~F.lower(v).isin(*EMPTY_WORDS), v)


def status(given: Column, successor: Column) -> Column:
    """The given status, else superseded where there is a successor, else active."""
    return F.coalesce(F.when(F.trim(blank(given)) != "", F.lower(F.trim(given))), F.when(filled(successor).isNotNull(), F.lit("superseded")), F.lit("active"))


def is_retired(given: Column, successor: Column) -> Column:
    own = F.lower(F.trim(blank(given)))
    return own.isin(*RETIRED) | (own == "") & filled(successor).isNotNull()


def is_full_date(c: Column) -> Column:
    return blank(c).rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$")


def is_partial_date(c: Column) -> Column:
    return blank(c).rlike("^[0-9]{4}(-[0-9]{2})?(-[0-9]{2})?$")


def is_fresh(checked: Column, now: Column, days: int, failed: Column | None = None) -> Column:
    """Whether less than ``days`` have passed; a failed or unreadable check is never fresh."""
    young = F.coalesce(F.unix_seconds(now) - F.unix_seconds(checked) < 86400 * days, F.lit(False))
    return young if failed is None else young & ~F.coalesce(failed, F.lit(False))


def days_between(then: Column, now: Column) -> Column:
    """Whole days passed, rounded down also for the future; null for null."""
    return F.floor((F.unix_seconds(now) - F.unix_seconds(then)) / 86400).cast("long")


def age_text(then: Column, now: Column) -> Column:
    d = F.unix_seconds(now) - F.unix_seconds(then)
    unit = lambda size, letter: F.concat(F.floor(d / size).cast("string"), F.lit(f"{letter} ago"))
    return F.when(then.isNull(), "—").when(d < 60, "just now").when(d < 3600, unit(3600 / 60, "m")).when(d < 86400, unit(3600, "h")).otherwise(unit(86400, "d"))


def size_text(n: Column) -> Column:
    """A number of bytes with a unit and, from KB on, one decimal."""
    n = n.cast("double")
    out = F.when(n < 1024, F.format_string("%.0f B", n))
    for power, unit in enumerate(("KB", "MB", "GB"), 1):
        out = out.when(n < 1024 ** (power + 1), F.format_string(f"%.1f {unit}", F.bround(n / 1024**power, 1)))
    return out.otherwise(F.format_string("%.1f TB", F.bround(n / 1024**4, 1)))


def is_due(age_days: Column, cadence: Column) -> Column:
    """Whether more days have passed than the cadence has; other cadences and unknown ages are never due."""
    days = F.create_map(*[F.lit(x) for pair in CADENCE_DAYS.items() for x in pair])[cadence]
    return F.coalesce(age_days > days, F.lit(False))


def severity_rank(c: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in SEVERITY]), c) - 1
