"""Column functions over document identifiers and preprint venues."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from libraryloom.functions.text import blank

#: The shapes of the identifiers.
DOI = r"(?i)\b(10\.\d{4,9}/[^\s\"'<>)\],]+)"
ARXIV = r"(?i)arxiv\.org/(?:abs|pdf|html)/([a-z\-\.]+/\d{7}|\d{4}\.\d{4,5})(v\d+)?"
SSRN = r"(?i)ssrn\.com/(?:abstract|sol3/papers\.cfm\?abstract_id|delivery\.cfm/SSRN_ID)[=/]?(\d+)"


def normalize_doi(c: Column) -> Column:
    """A bare lower-case identifier: no resolver prefix, query, fragment or closing punctuation."""
    bare = F.regexp_replace(F.lower(F.trim(blank(c))), "^(https?://doi\\.org/|doi:)", "")
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(bare, "[?#].*$", ""), "/+$", ""), "[.,;)\\]>\"']+$", ""))


def doi_in(c: Column) -> Column:
    return normalize_doi(F.regexp_extract(blank(c), DOI, 1))


def arxiv_id(c: Column) -> Column:
    return F.regexp_extract(blank(c), ARXIV, 1)


def ssrn_id(c: Column) -> Column:
    return F.regexp_extract(blank(c), SSRN, 1)


def preprint_venue(url: Column, source_type: Column, publication: Column) -> Column:
    """struct(venue, id) of a preprint, null for anything else; the first rule that fits decides."""
    pub = F.lower(F.trim(blank(publication)))
    pair = lambda venue, ident: F.struct(F.lit(venue).alias("venue"), ident.alias("id"))
    none = F.lit("")
    looks = (F.lower(F.trim(blank(source_type))) == "preprint") | pub.startswith("preprint")
    return (
        F.when(arxiv_id(url) != "", pair("arXiv", arxiv_id(url)))
        .when(ssrn_id(url) != "", pair("SSRN", ssrn_id(url)))
        .when(pub.startswith("arxiv"), pair("arXiv", none))
        .when(pub.startswith("ssrn"), pair("SSRN", none))
        .when(looks, pair("preprint", none))
    )


def is_preprint_location(kind: Column, landing: Column) -> Column:
    low = F.lower(blank(landing))
    out = F.lower(blank(kind)) == "repository"
    for x in ("arxiv.org", "10.48550/arxiv", "ssrn.com", "biorxiv.org", "medrxiv.org"):
        out = out | low.contains(x)
    return out


def location_score(version: Column, kind: Column, is_published: Column) -> Column:
    """How much a location looks like peer review: version, kind of venue, and its flag."""
    v, k = F.lower(blank(version)), F.lower(blank(kind))
    by_version = F.when(v == "publishedversion", 3).when(v == "acceptedversion", 2).otherwise(0)
    by_kind = F.when(k.isin("journal", "conference", "book series"), 3).when(k == "ebook platform", 1).otherwise(0)
    return by_version + by_kind + F.when(F.coalesce(is_published, F.lit(False)), 1).otherwise(0)


def confidence(same_id: Column, score: Column) -> Column:
    return F.when(same_id | (score >= 0.97), "high").when(score >= 0.90, "medium").otherwise("low")
