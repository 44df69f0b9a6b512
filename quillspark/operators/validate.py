"""Validation of records (VAL1 to VAL3): codes of what is missing or odd, a better type, and required fields."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Hosts and containers that speak for an ordinary web page.
PLAIN_HOSTS = r"\b(google\.com|drive\.google|docs\.google|youtube\.com|facebook\.com|twitter\.com|instagram\.com|linkedin\.com|reddit\.com|github\.com|stackoverflow\.com|medium\.com|wikipedia\.org|amazon\.com|ebay\.com)\b"
PLAIN_CONTAINERS = r"(?i)^(Google|Google Drive|Facebook|Twitter|YouTube|LinkedIn|Reddit|Medium|Wikipedia|GitHub)$"
# Required and recommended fields by type.
_NEED = {
    "article-journal": (("title", "author", "container_title", "issued"), ("volume", "issue", "page", "DOI")),
    "article-magazine": (("title", "author", "container_title", "issued"), ("volume", "issue", "page")),
    "article-newspaper": (("title", "author", "container_title", "issued"), ("DOI", "page")),
    "book": (("title", "author", "publisher", "issued"), ("DOI",)),
    "chapter": (("title", "author", "container_title", "publisher", "issued"), ("page",)),
    "paper-conference": (("title", "author", "container_title", "issued"), ("publisher", "page")),
    "thesis": (("title", "author", "publisher", "issued"), ()),
    "report": (("title", "author", "publisher", "issued"), ("DOI",)),
    "webpage": (("title", "DOI"), ("author", "issued")),
    "post-weblog": (("title", "author", "DOI"), ("issued", "container_title")),
    "legislation": (("title", "issued"), ("container_title", "volume", "page")),
    "legal-case": (("title", "issued"), ("container_title", "volume", "page")),
    "patent": (("title", "author", "issued"), ("DOI",)),
    "dataset": (("title", "author", "issued"), ("DOI", "publisher")),
    "software": (("title", "author"), ("issued", "DOI", "publisher")),
    "motion-picture": (("title", "issued"), ("author", "publisher")),
    "broadcast": (("title", "issued"), ("container_title", "author")),
}


def _has(c: str) -> Column:
    return F.coalesce(F.trim(c) != "", F.lit(False))


def _rules() -> list[tuple[str, Column]]:
    t, host, vol, iss, page, doi, pub = F.col("type"), _has("container_title"), _has("volume"), _has("issue"), _has("page"), _has("DOI"), _has("publisher")
    news = t.isin("article-newspaper", "article-magazine")
    plain = F.coalesce(F.lower(F.coalesce("DOI", "URL")).rlike(PLAIN_HOSTS), F.lit(False)) | F.coalesce(F.trim("container_title").rlike(PLAIN_CONTAINERS), F.lit(False))
    web = (t == "webpage") & ~plain & doi & host
    return [
        ("journal-no-container", (t == "article-journal") & ~host), ("journal-no-volume-issue", (t == "article-journal") & ~vol & ~iss), ("journal-no-doi-pages", (t == "article-journal") & ~doi & ~page),
        ("book-no-publisher", (t == "book") & ~pub), ("book-has-container", (t == "book") & host), ("book-volume-issue", (t == "book") & vol & iss), ("chapter-no-container", (t == "chapter") & ~host),
        ("chapter-no-publisher", (t == "chapter") & ~pub), ("news-no-container", news & ~host), ("news-looks-journal", news & vol & iss & doi), ("thesis-no-publisher", (t == "thesis") & ~pub), ("thesis-has-container", (t == "thesis") & host),
        ("webpage-looks-journal", web & (vol | iss)), ("webpage-may-be-journal", web & ~(vol | iss) & F.col("DOI").rlike(r"^10\.\d{4,}")), ("conference-no-container", (t == "paper-conference") & ~host), ("report-no-publisher", (t == "report") & ~pub),
    ]


def warnings() -> Column:
    """VAL1: codes of the rules that fire, in order."""
    return F.array_compact(F.array(*(F.when(test, F.lit(code)) for code, test in _rules())))


def suggestion() -> Column:
    """VAL1: a better type, or null."""
    rules = dict(_rules())
    journal = reduce(lambda a, b: a | b, (rules[k] for k in ("book-volume-issue", "news-looks-journal", "webpage-looks-journal", "webpage-may-be-journal")))
    bare = rules["journal-no-container"] & rules["journal-no-volume-issue"] & rules["journal-no-doi-pages"]
    return F.when(bare, "webpage").when(journal, "article-journal")


def confidence(detected: Column) -> Column:
    """VAL2: whether the type is what the record's fields, or the detector, say."""
    t = F.col("type")
    journal = (t == "article-journal") & _has("DOI") & _has("container_title") & _has("volume") & (F.coalesce(F.size("author"), F.lit(0)) > 0)
    web = (t == "webpage") & ~_has("DOI") & ~_has("container_title")
    return F.when(journal | web | F.coalesce(detected == t, F.lit(False)), "auto-detected").otherwise("manual")


def missing(which: int = 0) -> Column:
    """VAL3: required (0) or recommended (1) fields of the type that the record lacks."""
    filled = {"author": F.coalesce(F.size("author") > 0, F.lit(False)), "issued": F.col("issued").isNotNull()}
    out = F.array().cast("array<string>")
    for kind, need in _NEED.items():
        fields = need[which]
        if fields:
            lack = F.array_compact(F.array(*(F.when(~filled.get(f, _has(f) if f not in filled else None), F.lit(f)) for f in fields)))
            out = F.when(F.col("type") == kind, lack).otherwise(out)
    return out
