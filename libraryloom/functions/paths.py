"""Column functions that guard paths which a request names: nothing outside the library is shown or served."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from libraryloom.functions.text import blank

#: Extensions of the files that are served as they are.
SERVED = ("pdf", "md", "html", "htm", "txt", "png", "jpg", "jpeg", "gif", "svg", "webp")


def safe_name(c: Column) -> Column:
    """Whether a text names one file: not empty, no point or two alone, no slash, line break or zero byte. Null is no name."""
    return (blank(c) != "") & ~blank(c).isin(".", "..") & ~blank(c).rlike("[/\\x00\\n\\r]")


def resolved(c: Column) -> Column:
    """A relative path without ``.``, ``..`` and empty parts, by a fold over its parts as a stack; null where it leaves its root."""
    none = F.array().cast("array<string>")

    def step(held: Column, part: Column) -> Column:
        up = F.when(F.size(held) > 0, F.slice(held, F.lit(1), F.greatest(F.size(held) - 1, F.lit(0))))  # null: above the root
        return F.when(part.isin("", "."), held).when(part == "..", up).otherwise(F.concat(held, F.array(part)))

    parts = F.aggregate(F.split(c, "/", -1), none, step)
    return F.when(c.startswith("/"), None).otherwise(F.array_join(parts, "/"))


def inside(c: Column) -> Column:
    """Whether a path may be looked up: relative, not empty, without any ``..`` or zero byte, and a place below the root."""
    plain = (blank(c) != "") & ~blank(c).startswith("/") & ~blank(c).rlike("(^|/)\\.\\.(/|$)|\\x00")
    return plain & (blank(resolved(c)) != "")


def extension(c: Column) -> Column:
    """What follows the last point of a path's last part, as it is written; empty for ``.name`` and ``name.``."""
    return F.regexp_extract(blank(resolved(c)), "[^/]\\.([^./]+)$", 1)


def viewable(c: Column) -> Column:
    """Whether a record's page may be shown: inside, and Markdown in small letters."""
    return inside(c) & (extension(c) == "md")


def servable(c: Column, extensions: tuple[str, ...] = SERVED) -> Column:
    """Whether a file may be served: inside, with one of the extensions in any case."""
    return inside(c) & F.lower(extension(c)).isin(*extensions)
