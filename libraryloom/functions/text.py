"""Column functions over titles and free text."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Marks of a title that a PDF writer made up, and the starts of banner lines.
JUNK_MARKERS = ("untitled", "microsoft word", "untitled document", ".dvi", ".tex", "preprint.pdf")
JUNK_STARTS = ("proceedings of", "findings of the", "in proceedings")
JUNK_PHRASES = ("annual meeting of the association", "conference on empirical methods")
LEAST_TITLE = 12


def blank(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def normalize_title(c: Column) -> Column:
    """Lower-case ASCII letters and digits, single spaces; all else, letters with accents too, is a separator."""
    return F.trim(F.regexp_replace(F.lower(blank(c)), "[^a-z0-9]+", " "))


def search_text(c: Column) -> Column:
    """A title without the characters that the search service reads as operators."""
    return F.trim(F.regexp_replace(F.regexp_replace(blank(c), "[?*|]+", " "), "[ \\t\\n\\r]+", " "))


def kebab(c: Column) -> Column:
    """Lower-case words joined by hyphens; dots stay inside, so identifiers survive."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9.]+", "-"), "^[-.]+|[-.]+$", "")


def is_junk_title(c: Column) -> Column:
    low = F.lower(c)
    found = [low.contains(x) for x in (*JUNK_MARKERS, *JUNK_PHRASES, "(c)")] + [low.startswith(x) for x in JUNK_STARTS]
    any_of = c.isNull() | (c == "") | c.contains("©") | low.rlike("^pages?[ \\t]+[0-9]") | low.rlike("^vol(\\.|ume)[ \\t]")
    for x in found:
        any_of = any_of | x
    return any_of


def first_title_line(c: Column) -> Column:
    """The first line of at least 12 characters that may be a title, else empty."""
    lines = F.transform(F.split(blank(c), "\n"), lambda x: F.trim(x))
    good = F.filter(lines, lambda x: (F.length(x) >= LEAST_TITLE) & ~is_junk_title(x))
    return F.when(F.size(good) > 0, F.element_at(good, 1)).otherwise("")


def escape_cell(c: Column) -> Column:
    """Text that may stand in a cell of a Markdown table."""
    return F.replace(F.replace(blank(c), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


def tail(c: Column, n: int) -> Column:
    return F.right(c, F.lit(n))


def snippet(c: Column, n: int = 300) -> Column:
    return F.when(F.length(c) > n, F.concat(F.left(c, F.lit(n)), F.lit("…"))).otherwise(c)


def matches_search(query: str, *columns: Column) -> Column:
    """Whether the query, trimmed and without case, occurs in the columns' joined text."""
    return F.lower(F.concat_ws(" ", *columns)).contains(query.strip().lower())


def safe_log_name(c: Column) -> Column:
    return F.regexp_replace(c, "[^A-Za-z0-9._-]", "_")


#: Fixed value: what a section's number looks like.
SECTION = "\\b([0-9]+(?:\\.[0-9]+)?|[A-K](?:\\.[0-9]+)?)\\b"


def section_ids(c: Column) -> Column:
    """Section numbers such as 31, 31.1, B or A.2, in order, after a leading "Section" or "Sections"."""
    return F.regexp_extract_all(F.regexp_replace(blank(c), "^Sections?\\s*", ""), F.lit(SECTION), 1)


def without_upload_prefix(c: Column) -> Column:
    """A staged file's name without the unique prefix that staging gave it."""
    return F.regexp_replace(c, "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}[-_]", "")


def ascii_fold(c: Column) -> Column:
    """A name in ASCII: accents dropped, every other foreign character an underscore."""
    def fold(names: pd.Series) -> pd.Series:
        def one(s: str | None) -> str | None:
            if s is None:
                return None
            plain = (x for x in unicodedata.normalize("NFKD", s) if not unicodedata.combining(x))
            return "".join(x if x < "\x80" else "_" for x in plain)

        return names.map(one)

    return F.pandas_udf(fold, "string")(c)


def json_string(c: Column) -> Column:
    """A JSON string literal of a text without its control characters; null as empty."""
    plain = F.regexp_replace(blank(c), "[\\x00-\\x1f]", "")
    return _quoted(plain)


def script_string(c: Column) -> Column:
    """A string literal in which only backslash and double quote are escaped."""
    return _quoted(blank(c))


def _quoted(c: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def yaml_string(c: Column) -> Column:
    """A double-quoted scalar of a value that keeps neither backslashes nor double quotes."""
    return F.concat(F.lit('"'), F.replace(F.replace(blank(c), F.lit("\\"), F.lit("")), F.lit('"'), F.lit("")), F.lit('"'))


def file_kind(name: Column, content: Column) -> Column:
    """pdf by the first bytes of the content; else by the extension: note, page, link, or other."""
    ext = F.lower(F.regexp_extract(blank(name), "\\.([A-Za-z0-9]+)$", 1))
    kind = F.when(ext == "md", "note").when(ext.isin("html", "htm"), "page").when(ext.isin("txt", "url"), "link").otherwise("other")
    return F.when(F.coalesce(F.hex(F.substring(content, 1, 4)) == "25504446", F.lit(False)), "pdf").otherwise(kind)
