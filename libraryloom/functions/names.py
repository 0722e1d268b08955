"""Column functions over author names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from libraryloom.functions.text import blank

# The words and names by which organisations, venues and persons are told apart.
ORG_WORDS = (
    "Office Agency Bureau Committee Commission Council Board Authority Department Ministry Administration Parliament Senate Assembly Directorate "
    "Association Foundation Society Federation Alliance Coalition Union Trust Institute Institution Center Centre Forum Initiative Programme "
    "University College Corporation Company Lab Laboratory Court Tribunal LLC PLC GmbH"
).split()
ORG_TERMS = ("Law School", "State Bar", "Inc\\.?", "Ltd\\.?", "School of", "Bar Association")
KNOWN_ORGS = (
    "GAO", "OECD", "IMF", "WHO", "UN", "EU", "NIST", "NASA", "NIH", "FDA", "EPA", "FBI", "DOJ", "CDC", "FCC", "SEC", "ABA", "NYCBA", "ACLU", "USPTO",
    "OPM", "BLS", "Anthropic", "OpenAI", "Google DeepMind", "DeepMind", "Microsoft Research", "Thomson Reuters",
)
VENUE_WORDS = (
    "arXiv preprint SSRN Journal Review Transactions Letters Proceedings Conference Workshop Nature Cell Science JAMA Lancet "
    "ICML ICLR NeurIPS EMNLP ACL TACL PMLR COLM"
).split()
MARKERS = (
    "Association Council Committee Commission Bureau Office Institute Institution University Center Centre Project Group Foundation Laborator Society "
    "Agency Department Ministry Parliament Senate Assembly Board Authority Union Tribunal Court Directorate Corporation LLC Ltd GmbH OWASP Anthropic "
    "OpenAI LexisNexis NIST GAO"
).split()
MARKER_TERMS = ("Bar of", "State Bar", "Inc\\.", "Thomson Reuters", "\\bABA\\b", "\\(.*\\)")
PARTICLES = ("van", "von", "der", "de", "da", "del", "di", "la", "le")

_org = f"\\b({'|'.join((*ORG_WORDS, *ORG_TERMS))})\\b"
_venue = f"\\b({'|'.join(VENUE_WORDS)})\\b"
_marker = f"(?i)({'|'.join((*MARKERS, *MARKER_TERMS))})"


def words_of(c: Column) -> Column:
    return F.filter(F.split(F.trim(blank(c)), "[ \\t\\n\\r]+"), lambda w: w != "")


def is_institution(c: Column) -> Column:
    """Whether an author is an organisation: known, or by a word of its name, or by length; a venue never is."""
    n = F.trim(blank(c))
    return (
        F.when(n == "", False).when(n.isin(*KNOWN_ORGS), True).when(n.rlike(_venue), False).when(n.rlike(_org), True)
        .otherwise(~n.contains(",") & (F.size(words_of(n)) >= 4))
    )


def looks_like_person(c: Column) -> Column:
    """Two to four capitalised words or particles without a comma or a mark of an organisation."""
    w = words_of(c)
    capital = lambda x: (F.upper(F.left(x, F.lit(1))) == F.left(x, F.lit(1))) & (F.lower(F.left(x, F.lit(1))) != F.left(x, F.lit(1)))
    return ~blank(c).contains(",") & ~blank(c).rlike(_marker) & F.size(w).between(2, 4) & F.forall(w, lambda x: capital(x) | F.lower(x).isin(*PARTICLES))


def last_name(c: Column) -> Column:
    """What stands before the comma, else the last word; empty for an empty name."""
    n = F.trim(blank(c))
    return F.when(n == "", "").when(n.contains(","), F.trim(F.substring_index(n, ",", 1))).otherwise(F.element_at(F.concat(F.array(F.lit("")), words_of(n)), -1))


def surnames(authors: Column) -> Column:
    return F.filter(F.transform(authors, lambda a: F.lower(last_name(a))), lambda s: s != "")


def display_name(c: Column) -> Column:
    return F.when(is_institution(c), c).otherwise(last_name(c))


def byline(authors: Column, most: int = 4) -> Column:
    """Display names joined by commas; beyond ``most`` the rest is "et al."."""
    shown = F.array_join(F.transform(F.slice(authors, 1, most), display_name), ", ")
    return F.when(F.size(authors) > most, F.concat(shown, F.lit(" et al."))).otherwise(shown)


def changelog_byline(authors: Column) -> Column:
    """What stands before the comma of up to three authors; more collapse to the first, and no authors are "unattributed"."""
    shown = F.transform(F.filter(authors, lambda a: blank(a) != ""), lambda a: F.trim(F.substring_index(a, ",", 1)))
    many = F.concat(F.element_at(F.concat(shown, F.array(F.lit(""))), 1), F.lit(" et al."))
    return F.when(F.size(shown) > 3, many).otherwise(F.coalesce(F.nullif(F.array_join(shown, ", "), F.lit("")), F.lit("unattributed")))


def is_placeholder(c: Column) -> Column:
    return blank(c).rlike("(?i)\\bet\\s+al\\.?\\s*$")
