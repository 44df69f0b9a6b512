"""Identifiers as Column expressions: cleaning, recognition and routing (STR3 to STR10, STR28, MUT12, EXT15 to EXT18)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions.text import blank_to_null, once

# Patterns of identifiers.
DOI = r"\b(10\.\d{4,}/[^\s<>\"{}|\\^~\[\]`]+)"
DOI_LABELLED = r"(?i)(?:doi[:\s]*|https?://(?:dx\.)?doi\.org/)(10\.\d{4,}/[^\s<>\"{}|\\^~\[\]`]+)"
ISBN_13 = r"(?i)(?:ISBN[\s:-]*(?:13)?[\s:-]*)?(97[89][\s-]?\d[\s-]?\d{4}[\s-]?\d{4}[\s-]?\d)"
ISBN_10 = r"(?i)ISBN[\s:-]*(?:10)?[\s:-]*(\d[\s-]?\d{4}[\s-]?\d{4}[\s-]?[\dXx])"
ISBN_ANY = r"(?i)\bISBN(?:-1[03])?[\s:-]*([\d\s-]{10,17}[\dXx]?)\b"
PMID = r"(?i)\bPMID[\s:-]*(\d{6,9})\b"
PMID_URL = r"pubmed\.ncbi\.nlm\.nih\.gov/(\d+)"
PMC = r"(?i)\bPMC(\d{6,8})\b"
PMC_URL = r"/pmc/articles/(PMC\d+)"
ARXIV = r"(?i)\barXiv[\s:-]*(\d{4}\.\d{4,5}(?:v\d+)?)\b"
ARXIV_URL = r"arxiv\.org/(?:abs|pdf)/(\d{4}\.\d{4,5})"
ARXIV_DOI = r"(?i)10\.48550/arXiv\.(\d{4}\.\d{4,5})"
ISSN = r"(?i)\bISSN[\s:-]*(\d{4}-\d{3}[\dXx])\b"
ORCID = r"\b(\d{4}-\d{4}-\d{4}-\d{3}[\dXx])\b"
#: URL patterns that hold a DOI, in order, with what precedes the DOI and whether it is percent-encoded.
URL_DOI = (
    (r"/(10\.\d{4,}/[^\s&?#]+)", "", False),
    (r"nature\.com/articles/([^/.?#]+)(?:\.pdf)?", "10.1038/", False),
    (r"springer\.com/content/pdf/(10\.\d{4,}/[^.?#]+)", "", False),
    (r"wiley\.com/doi/(?:pdfdirect|epdf|pdf|full)/(10\.\d{4,}/[^?#]+)", "", True),
    (r"tandfonline\.com/doi/(?:pdf|epdf|full)/(10\.\d{4,}/[^?#]+)", "", True),
    (r"/doi/(?:pdf|epdf|pdfdirect|full|abs)/(10\.\d{4,}/[^?#]+)", "", True),
    (r"sciencedirect\.com.*[?&]doi=(10\.\d{4,}/[^&#]+)", "", True),
    (ARXIV_URL, "10.48550/arXiv.", False),
)


def first_match(c: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match, or null."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def trim_doi(c: Column) -> Column:
    return F.regexp_replace(c, r"[.,;:)\]}>]+$", "")


def clean_doi(c: Column) -> Column:
    """STR3: no query, fragment, closing punctuation or slashes at the end."""
    return F.trim(F.regexp_replace(trim_doi(F.regexp_replace(c, r"[?#].*$", "")), r"/+$", ""))


def normalise_doi(c: Column) -> Column:
    """STR4: without resolver prefix; null unless it is a DOI."""
    bare = F.trim(F.regexp_replace(c, r"(?i)^(?:https?://(?:dx\.)?doi\.org/|doi:\s*)", ""))
    return F.when(bare.rlike(r"^10\.\d{4,}"), bare)


def doi_key(c: Column) -> Column:
    return F.lower(blank_to_null(c))


def isbn_key(c: Column) -> Column:
    return blank_to_null(F.regexp_replace(c, r"[-\s]", ""))


def is_isbn(c: Column) -> Column:
    """STR5: shape of 10 or 13 digits, no checksum."""
    return isbn_key(c).rlike(r"^(?:97[89]\d{10}|\d{9}[\dXx])$")


def _found(kind: str, id_: Column, doi: Column | None = None) -> Column:
    return F.struct(F.lit(kind).alias("type"), id_.alias("id"), (F.lit(None).cast("string") if doi is None else doi).alias("doi"))


def identify(c: Column) -> Column:
    """STR7: (type, id, doi) of the first identifier in the order DOI, arXiv, PMID, PMC, ISBN; null if none."""

    def numbers(s: Column) -> Column:
        doi = trim_doi(F.coalesce(first_match(s, DOI_LABELLED), first_match(s, DOI)))
        arxiv, pmid, pmc = (F.coalesce(first_match(s, a), first_match(s, b)) for a, b in ((ARXIV, ARXIV_URL), (PMID, PMID_URL), (PMC, PMC_URL)))
        plain = F.regexp_replace(s, r"[\s-]", "")
        isbn = F.coalesce(first_match(plain, r"^(97[89]\d{10})$"), first_match(plain, r"^(\d{9}[\dXx])$"), isbn_key(first_match(s, ISBN_ANY)))
        return F.struct(doi.alias("doi"), arxiv.alias("arxiv"), pmid.alias("pmid"), pmc.alias("pmc"), isbn.alias("isbn"))

    def first(x: Column) -> Column:
        return (
            F.when(x["doi"].isNotNull() & x["doi"].rlike(ARXIV_DOI), _found("arXiv", F.regexp_extract(x["doi"], ARXIV_DOI, 1), x["doi"]))
            .when(x["doi"].isNotNull(), _found("DOI", x["doi"]))
            .when(x["arxiv"].isNotNull(), _found("arXiv", x["arxiv"], F.concat(F.lit("10.48550/arXiv."), x["arxiv"])))
            .when(x["pmid"].isNotNull(), _found("PMID", x["pmid"]))
            .when(x["pmc"].isNotNull(), _found("PMC", x["pmc"]))
            .when(x["isbn"].isNotNull(), _found("ISBN", x["isbn"]))
        )

    return once(F.trim(c), lambda s: once(numbers(s), first))


def doi_in_url(url: Column) -> Column:
    """STR8, EXT17: (type, id) of the DOI, or PMC number, that a publisher's URL holds."""

    def numbers(u: Column) -> Column:
        each = [F.try_url_decode(first_match(u, p)) if encoded else first_match(u, p) for p, _, encoded in URL_DOI]
        dois = [trim_doi(F.concat(F.lit(before), got)) for (_, before, _), got in zip(URL_DOI, each, strict=True)]
        return F.struct(F.coalesce(*dois).alias("doi"), first_match(u, PMC_URL).alias("pmc"))

    kind = lambda t, v: F.struct(F.lit(t).alias("type"), v.alias("id"))
    return once(url, lambda u: once(numbers(u), lambda x: F.when(x["doi"].isNotNull(), kind("DOI", x["doi"])).when(x["pmc"].isNotNull(), kind("PMC", x["pmc"]))))


def identifiers_in(c: Column, header_only: bool = False) -> Column:
    """STR9: the first DOI, ISBN, PMID, arXiv number and ISSN of a text (or its first 3000 characters)."""
    s = F.substring(c, 1, 3000) if header_only else c
    doi = trim_doi(F.coalesce(first_match(s, DOI_LABELLED), first_match(s, DOI)))
    isbn = F.coalesce(isbn_key(first_match(s, ISBN_13)), isbn_key(first_match(s, ISBN_10)))
    return F.struct(doi.alias("DOI"), isbn.alias("ISBN"), first_match(s, PMID).alias("PMID"), first_match(s, ARXIV).alias("arXiv"), first_match(s, ISSN).alias("ISSN"))


def route(c: Column) -> Column:
    """STR10: which resolver an input goes to: doi, isbn, pmid, arxiv, url or title."""
    s, plain = F.trim(c), F.regexp_replace(F.trim(c), r"[\s-]", "")
    return (
        F.when(s.rlike(r"(?i)^(?:https?://(?:dx\.)?doi\.org/|doi:\s*)?10\.\d{4,}/"), "doi")
        .when(plain.rlike(r"(?i)^(?:ISBN:?)?(?:97[89]\d{10}|\d{9}[\dX])$"), "isbn")
        .when(s.rlike(r"(?i)^(?:PMID[\s:-]*)?\d{6,9}$"), "pmid")
        .when(s.rlike(r"(?i)^(?:arXiv[\s:-]*)?\d{4}\.\d{4,5}(?:v\d+)?$") | s.rlike(ARXIV_URL), "arxiv")
        .when(s.rlike(r"(?i)^https?://"), "url")
        .otherwise("title")
    )


def rejoin_wrapped(c: Column) -> Column:
    """A DOI that a line break divides, in one piece."""
    return F.regexp_replace(c, r"(10\.\d{4,}/[^\s]*[-/._])\s*\n\s*", "$1")


def all_dois(c: Column) -> Column:
    """SRC10, EXT15: the distinct DOIs of a text in order."""
    return F.array_distinct(F.transform(F.regexp_extract_all(rejoin_wrapped(c), F.lit(DOI), F.lit(1)), trim_doi))


def all_isbns(c: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(ISBN_13), F.lit(1)), lambda x: F.regexp_replace(x, r"[\s-]", "")))


def from_file_name(name: Column) -> Column:
    """STR28: DOI or arXiv number in a file name, in which underscores stand for slashes."""
    doi = first_match(F.regexp_replace(name, r"(10\.\d{4,})[_](.+?)(?:\.pdf)?$", "$1/$2"), r"(10\.\d{4,}/.+)$")
    arxiv = first_match(name, r"(\d{4}\.\d{4,5})(?:v\d+)?(?:\.pdf)?$")
    return F.struct(doi.alias("doi"), arxiv.alias("arxiv"))


def link_target(url: Column) -> Column:
    """MUT12: what a link resolves to: its DOI, else the first digits in it that have the shape of an ISBN, else null."""
    return F.coalesce(trim_doi(first_match(url, r"(10\.\d{4,}/[^\s&?#]+)")), first_match(url, r"(97[89]\d{10}|\d{9}[\dXx])"))


def selection_target(text: Column) -> Column:
    """MUT12: what a selected text resolves to: a DOI anywhere in it, else an ISBN of 13 digits, else a PMID, else the text."""
    doi = trim_doi(first_match(text, r"(10\.\d{4,}/[^\s\"'<>)\]},;]{3,})"))
    pmid = first_match(text, r"(?i)(?:pmid:?\s*)(\d{5,})")
    return F.coalesce(doi, first_match(text, r"((?:978|979)[\d-]{10,})"), F.concat(F.lit("PMID:"), pmid), F.nullif(F.trim(text), F.lit("")))
