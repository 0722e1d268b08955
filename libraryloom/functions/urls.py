"""Column functions over web addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from libraryloom.functions.text import blank, kebab

#: Query parameters that only track.
TRACKING = ("utm_", "fbclid=", "gclid=", "mc_cid=", "mc_eid=")
PARTS = "^(?i)(https?)://([^/?#]*)([^?#]*)(?:\\?([^#]*))?(?:#.*)?$"


def is_web_url(c: Column) -> Column:
    """Whether an address is one of http or https, in any case."""
    return blank(c).rlike("(?i)^https?://")


def stripped(c: Column) -> Column:
    """Text without white space of any kind (tabs, line feeds, those beyond ASCII) at its ends; null stays null."""
    return F.regexp_replace(c, "(?U)^[\\s\\x1c-\\x1f]+|[\\s\\x1c-\\x1f]+$", "")


def canonical_url(c: Column) -> Column:
    """One spelling of an address: scheme and host lower-case, no closing slash, fragment or tracking parameters (in any case).

    Null stays null. White space of any kind at the ends goes. Order of parameters is kept; what is not http or https is only
    trimmed.
    """
    url = stripped(c)
    part = lambda k: F.regexp_extract(url, PARTS, k)
    kept = F.filter(F.split(part(4), "&"), lambda p: (p != "") & ~_any_start(p))
    query = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    path = F.regexp_replace(part(3), "/+$", "")
    whole = F.concat(F.lower(part(1)), F.lit("://"), F.lower(part(2)), path, query)
    return F.when(url.rlike("^(?i)https?://"), whole).otherwise(url)


def _any_start(p: Column) -> Column:
    out = F.lit(False)
    for x in TRACKING:
        out = out | F.lower(p).startswith(x)
    return out


def host(c: Column) -> Column:
    return F.lower(F.regexp_extract(blank(c), PARTS, 2))


def is_local_request(named: Column, allowed: tuple[str, ...] = ("localhost", "127.0.0.1")) -> Column:
    """Whether a request's host, without its port, is one of ``allowed``."""
    return F.regexp_replace(F.lower(blank(named)), ":[0-9]+$", "").isin(*allowed)


def is_cross_origin(origin: Column, named: Column) -> Column:
    """Whether a request comes from a page of another host; without an origin it does not."""
    return (blank(origin) != "") & (host(origin) != F.lower(blank(named)))


def first_url(c: Column) -> Column:
    """The first address in a text, without closing punctuation; empty if none."""
    return F.regexp_replace(F.regexp_extract(blank(c), "https?://[^ \\t\\r\\n]+", 0), "[.,;:!?)\\]>\"']+$", "")


def slug_from_url(c: Column, index: Column) -> Column:
    """A short name for an address: its archive id, else the last part of its path, else candidate-<index>."""
    archive = F.regexp_extract(blank(c), "arxiv\\.org/(?:abs|pdf)/([0-9]{4}\\.[0-9]+)", 1)
    path = F.regexp_replace(F.regexp_extract(blank(c), PARTS, 3), "/+$", "")
    last = kebab(F.regexp_replace(F.regexp_extract(path, "([^/]*)$", 1), "(?i)\\.(pdf|html?|md|txt)$", ""))
    return F.when(archive != "", F.concat(F.lit("arxiv-"), archive)).when(last != "", last).otherwise(F.concat(F.lit("candidate-"), index.cast("string")))
