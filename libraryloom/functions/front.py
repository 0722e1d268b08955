"""Column functions that write fields of a record's front matter. A text without a front matter block is handed back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from libraryloom.functions.text import blank, yaml_string


def _with(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def has(body: Column, key: str) -> Column:
    """Whether the block has a line of this key; the text after the block does not count."""
    return body.rlike(f"(?sm)\\A---\\n(?:(?!^---$).)*?^{key}:")


def set_line(body: Column, key: str, line: Column, after: str | None = None) -> Column:
    """``body`` with its first line of ``key`` replaced by ``line``, or with ``line`` after that of ``after``, else at the end of the block.

    The block is cut into lines and joined again, so ``line`` may hold any character: ``$`` and backslashes stay as they are.
    """

    def put(b: Column) -> Column:
        end = F.locate("\n---\n", b, 4)
        lines = F.when(end > 4, F.split(F.substring(b, F.lit(5), end - 5), "\n", -1)).otherwise(F.array().cast("array<string>"))

        def placed(rows: Column) -> Column:
            at = lambda k: F.array_position(F.transform(rows, lambda x: x.startswith(f"{k}:")), True).cast("int")
            own, size = at(key), F.size(rows)
            before = F.when(own > 0, own - 1).otherwise(F.when(at(after) > 0, at(after)).otherwise(size) if after is not None else size)
            rest = F.when(own > 0, own).otherwise(before)
            return F.array_join(F.concat(F.slice(rows, F.lit(1), before), F.array(line), F.slice(rows, rest + 1, size)), "\n")

        new = F.concat(F.lit("---\n"), _with(lines, placed), F.substring(b, end, F.length(b)))
        return F.when(b.startswith("---\n") & (end > 0), new).otherwise(b)

    return _with(body, put)


def with_hash(body: Column, digest: Column, force: bool = False) -> Column:
    """The record with its source_hash, after the summary line; one that is there stays unless forced."""
    new = lambda b: set_line(b, "source_hash", F.concat(F.lit("source_hash: "), yaml_string(digest)), "tldr")
    return _with(body, new if force else lambda b: F.when(has(b, "source_hash"), b).otherwise(new(b)))


def with_origin(body: Column, via: Column) -> Column:
    """The record with where it was found, after the successor line, unless it says so already."""
    line = F.concat(F.lit("discovered_via: "), yaml_string(via))
    return _with(body, lambda b: F.when(has(b, "discovered_via"), b).otherwise(set_line(b, "discovered_via", line, "superseded_by")))


def with_urls(body: Column, published: Column, preprint: Column) -> Column:
    """The record of a promoted preprint: its published address, and the preprint's where that differs and is not there yet."""
    address, other = F.trim(blank(published)), F.trim(blank(preprint))
    first = _with(body, lambda b: F.when(address != "", set_line(b, "url", F.concat(F.lit("url: "), yaml_string(address)))).otherwise(b))

    def second(b: Column) -> Column:
        own = F.regexp_replace(F.regexp_replace(F.trim(F.regexp_extract(b, "(?m)^url:[ \\t]*(.*)$", 1)), "^[\"']+|[\"']+$", ""), "/+$", "")
        new = set_line(b, "preprint_url", F.concat(F.lit("preprint_url: "), yaml_string(other)), "url")
        return F.when((other != "") & ~has(b, "preprint_url") & (F.regexp_replace(other, "/+$", "") != own), new).otherwise(b)

    return _with(first, second)


def with_author(body: Column, organisation: Column) -> Column:
    """The record whose empty author line becomes a list of one; an author line that a list follows is left alone."""
    empty = "(?sm)\\A---\\n(?:(?!^---$).)*?^authors:[ \\t]*(?:\\[[ \\t]*\\])?[ \\t]*$(?!\\n(?:  -|\\t-))"
    line = F.concat(F.lit("authors:\n  - "), yaml_string(organisation))
    return _with(body, lambda b: F.when(b.rlike(empty), set_line(b, "authors", line)).otherwise(b))
