"""Fields of a source type from the text of a paper or a page (EXT6, EXT9, EXT10, EXT12 to EXT14, SRT4).

A field is the value behind one of its labels, else what one of its patterns finds. Labels are sought in lines, patterns in
the text without line breaks; both read whole texts. A null or empty text has no fields.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import dates, identifiers, names
from quillspark.functions.identifiers import first_match
from quillspark.functions.text import any_label, blank_to_null, label_patterns, labelled, once, value_at
from quillspark.operators import extract

# Patterns of single fields; the group is the value.
PATTERNS = {
    "date": (r"\b(\d{4}-\d{2}-\d{2})\b", r"(?i)\b((?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Sept|Oct|Nov|Dec)[a-z]*\.?\s+\d{1,2},\s+\d{4}|\d{1,2}\s+(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Sept|Oct|Nov|Dec)[a-z]*\.?\s+\d{4})\b"),
    "year": (r"\b((?:19|20)\d{2})\b",),
    "doi": (r"(?i)\b(10\.\d{4,9}/[-._;()/:A-Z0-9]+)\b",),
    "url": (r"(?i)\b(https?://[^\s<>()]+|www\.[^\s<>()]+\b)",),
    "volume": (r"(?i)\bvol\.?\s*(\d+)\b",),
    "issue": (r"(?i)\b(?:issue|no\.?|number)\s*(\d+)\b",),
    "pages": (r"(?i)\bpp?\.?\s*(\d+\s*[-–—]\s*\d+)\b",),
    "issn": (r"(?i)\b(ISSN(?:-1[03])?:?\s*\d{4}-\d{3}[\dX])\b",),
    "isbn": (r"(?i)\b(ISBN(?:-1[03])?:?\s*(?:97[89][- ]?)?\d{1,5}[- ]?\d+[- ]?\d+[- ]?[\dX])\b",),
    "edition": (r"(?i)\b(\d+(?:st|nd|rd|th)\s+ed(?:ition)?|revised edition)\b",),
    "journal": (r"(?i)\b(Journal of|Review|Quarterly|Transactions|Annals|Letters|Nature Reviews)\b",),
    "newspaper": (r"(?i)\b(Times|Herald|Post|Daily|Guardian|Telegraph|Tribune|Chronicle)\b",),
    "magazine": (r"(?i)\b(magazine)\b",),
    "publisher": (r"(?i)\b(Press|Publishing|Publications|Springer|Elsevier|Wiley|Routledge|Cambridge University Press|Oxford University Press|MIT Press|Sage)\b",),
    "book": (r"(?i)\bIn:\s*([^.]+?)(?:\.\s|,\s(?:Ed\.|Eds\.|edited by))",),
    "conference": (r"(?i)(?:^|\.)[^.\w]*+(?:Proceedings of\s+the\s+)?+([^.]*?(?:conference|symposium|workshop|congress|meeting)[^.]*)",),
    "proceedings": (r"(?i)\b(Proceedings of)\b",),
    "degree": (r"(?i)\b(PhD|MSc|BSc|Master'?s|Doctor of Philosophy)\b", r"(?i)\b(thesis|dissertation)\b"),
    "report_number": (r"(?i)\b(?:report no\.?|report number|document number|series number)\s*:?\s*([A-Z0-9/.\-]+)",),
    "jurisdiction": (r"(?i)\b(Commonwealth|State of|Province of|Republic of|United States|Australia|United Kingdom|Victoria|New South Wales|Queensland|Canada)\b",),
    "law": (r"(?i)\b(Act|Regulations|Statute|Code|Bill|Ordinance)\b",),
    "court": (r"(?i)\b(Court|Judge|Justice|Appeal|Circuit|Supreme Court|High Court|Federal Court)\b",),
    "neutral": (r"(\[\d{4}\]\s+[A-Z][A-Za-z]+\s+\d+)",),
    "patent_number": (r"(?i)\b(?:patent number|publication number|grant number)\s*:?\s*([A-Z0-9/.\-]+)",),
    "application_number": (r"(?i)\b(?:application number|application no\.?)\s*:?\s*([A-Z0-9/.\-]+)",),
    "repository": (r"(?i)\b(GEO|SRA|ENA|Zenodo|Figshare|Dryad|OSF|GenBank)\b",),
    "accession": (r"(?i)\b(GSE\d+|SRR\d+|PRJNA\d+|ENSG\d+)\b",),
    "version": (r"(?i)\bversion\s*v?(\d+(?:\.\d+){0,3})\b",),
    "runtime": (r"(?i)\b(?:runtime|running time|duration)\s*:?\s*(\d{1,3})\s*(?:min|minutes)\b",),
}
_COMPACT = r"\b{}\({}\)\s*:\s*{}\b"  # 12(3): 45-67
_VOLUME, _ISSUE, _SPAN = _COMPACT.format(r"(\d+)", r"\d+", r"\d+\s*-\s*\d+"), _COMPACT.format(r"\d+", r"(\d+)", r"\d+\s*-\s*\d+"), _COMPACT.format(r"\d+", r"\d+", r"(\d+\s*-\s*\d+)")

# Fields of a source type: the labels of each, and the patterns that answer where no label does.
LABELS: dict[str, dict[str, tuple[tuple[str, ...], str | None]]] = {
    "webpage": {
        "websiteTitle": (("website", "site name", "publication", "source"), None),
        "updatedDate": (("updated", "last updated", "modified", "revised"), None),
        "accessedDate": (("accessed", "access date", "retrieved", "viewed on"), None),
        "organization": (("organization", "publisher", "institution", "site owner"), None),
    },
    "article-journal": {
        "journalTitle": (("journal", "journal title", "publication", "periodical"), "journal"),
        "volume": ((), "volume"),
        "issue": ((), "issue"),
        "pages": ((), "pages"),
        "issn": ((), "issn"),
    },
    "article-newspaper": {
        "publicationTitle": (("newspaper", "publication", "magazine", "source"), "newspaper"),
        "section": (("section", "category", "desk"), None),
        "page": (("page", "p.", "pp."), None),
    },
    "article-magazine": {
        "publicationTitle": (("newspaper", "publication", "magazine", "source"), "magazine"),
        "section": (("section", "category", "desk"), None),
        "page": (("page", "p.", "pp."), None),
        "volume": ((), "volume"),
        "issue": ((), "issue"),
        "pages": ((), "pages"),
    },
    "book": {
        "publisher": (("publisher", "published by", "imprint", "press"), "publisher"),
        "edition": (("edition", "ed."), "edition"),
        "place": (("place", "location", "city", "place of publication"), None),
        "isbn": ((), "isbn"),
        "volume": ((), "volume"),
        "series": (("series", "series title"), None),
    },
    "chapter": {
        "bookTitle": (("book title", "container title", "source book"), "book"),
        "editor": (("editor", "editors", "edited by", "ed.", "eds."), None),
        "publisher": (("publisher", "published by", "press"), None),
        "pages": ((), "pages"),
        "edition": (("edition", "ed."), "edition"),
        "volume": ((), "volume"),
    },
    "paper-conference": {
        "conferenceTitle": (("conference", "conference title", "event", "meeting", "symposium", "workshop"), "conference"),
        "proceedingsTitle": (("proceedings", "proceedings title", "published in"), "proceedings"),
        "pages": ((), "pages"),
        "publisher": (("publisher", "organization", "press"), None),
        "place": (("location", "place", "venue", "city"), None),
    },
    "thesis": {
        "institution": (("university", "institution", "school", "college"), None),
        "degree": (("degree", "thesis type", "phd", "msc", "dissertation"), "degree"),
        "advisor": (("advisor", "supervisor", "mentor"), None),
        "department": (("department", "faculty", "school"), None),
        "repository": (("repository", "archive", "database"), None),
    },
    "report": {
        "reportNumber": (("report no", "report number", "document number", "series number"), "report_number"),
        "institution": (("institution", "organization", "agency", "department", "ministry"), None),
        "publisher": (("publisher", "published by"), None),
        "place": (("location", "city", "place of publication"), None),
    },
    "post-weblog": {
        "websiteTitle": (("website", "site name", "blog", "publication"), None),
        "tags": (("tags", "keywords", "labels"), None),
        "category": (("category", "section", "topic"), None),
        "updatedDate": (("updated", "modified", "last updated"), None),
    },
    "legislation": {
        "jurisdiction": (("jurisdiction", "state", "country", "commonwealth", "province"), "jurisdiction"),
        "actNumber": (("act no", "number", "no.", "chapter", "c."), None),
        "section": (("section", "s.", "ss.", "part", "division"), None),
        "chapter": (("chapter", "ch."), None),
        "code": (("code", "statute", "regulation", "ordinance", "bill"), "law"),
        "dateEnacted": (("date enacted", "enacted", "assented", "date"), "date"),
    },
    "legal-case": {
        "court": (("court", "tribunal", "bench", "supreme court", "appeal court"), "court"),
        "docketNumber": (("docket", "case no", "no.", "file number"), None),
        "reporter": (("reporter", "citation", "neutral citation"), "neutral"),
        "volume": ((), "volume"),
        "pages": ((), "pages"),
        "decisionDate": (("judgment date", "decided", "date"), "date"),
        "jurisdiction": (("jurisdiction", "state", "federal"), "jurisdiction"),
    },
    "patent": {
        "patentNumber": (("patent number", "patent no", "publication number", "grant number"), "patent_number"),
        "applicationNumber": (("application number", "application no"), "application_number"),
        "filingDate": (("filing date", "filed", "application date"), None),
        "jurisdiction": (("country", "office", "us", "ep", "wo", "jp"), None),
        "patentOffice": (("patent office", "uspto", "epo", "wipo"), None),
    },
    "dataset": {
        "repository": (("repository", "archive", "database", "source"), "repository"),
        "identifier": (("identifier", "id", "record id", "dataset id", "accession"), "accession"),
        "version": (("version", "release", "edition"), "version"),
        "releaseDate": (("release date", "published", "date", "deposited"), "date"),
        "accession": ((), "accession"),
        "license": (("license", "usage rights"), None),
    },
    "software": {
        "version": (("version", "release", "build", "tag"), "version"),
        "releaseDate": (("released", "release date", "published", "updated"), "date"),
        "repositoryUrl": (("github", "gitlab", "source", "repository", "homepage"), "url"),
        "license": (("license",), None),
        "platform": (("platform", "operating system", "environment"), None),
    },
    "motion-picture": {
        "directorOrProducer": (("director", "directed by", "producer", "produced by"), None),
        "distributor": (("distributor", "distributed by"), None),
        "runningTime": (("duration", "running time", "runtime"), "runtime"),
        "format": (("format", "film", "video", "motion picture"), None),
        "studio": (("studio", "production company"), None),
    },
    "broadcast": {
        "broadcaster": (("broadcaster", "network", "station", "channel"), None),
        "episode": (("episode", "episode number", "season", "series"), None),
        "network": (("network",), None),
        "host": (("host", "presenter", "anchor"), None),
        "station": (("station", "radio station", "television channel"), None),
    },
}
# Labels and patterns of the fields that all types share.
SHARED: dict[str, tuple[tuple[str, ...], str | None]] = {
    "author": (("author", "authors", "written by", "by", "creator"), None),
    "publicationDate": (("publication date", "published", "date", "issued"), "date"),
    "year": ((), "year"),
    "doi": ((), "doi"),
    "url": ((), "url"),
}
# Fields that take the author where it is found, else a value of these labels.
PEOPLE = {
    "book": ("authorOrEditor", ("editor", "editors", "edited by", "ed.", "eds.")),
    "report": ("authorOrOrganization", ("organization", "institution", "agency", "department", "ministry")),
    "post-weblog": ("authorOrBlogName", ("blog", "weblog", "site", "publication")),
    "software": ("authorOrOrganization", ("developer", "organization", "maintainer", "publisher")),
    "patent": ("inventorOrAssignee", ("inventor", "inventors", "assignee", "applicant", "owner")),
}


def lines_of(c: Column) -> Column:
    """A text as lines without blank ones: plain spaces and hyphens, divided words rejoined."""
    c = F.regexp_replace(F.regexp_replace(c, " ", " "), r"-\n(?=\w)", "")
    c = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "[–—]", "-"), r"\r", ""), r"[ \t]+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(c, r" ?\n[ \n]*", "\n"), r"^\n|\n$", ""))


def flat(lines: Column) -> Column:
    return F.trim(F.regexp_replace(lines, r"\s+", " "))


def guess_title(lines: Column) -> Column:
    """SRT4, EXT13: of the first 15 lines the one that looks most like a title; of equal ones the first."""
    first = F.transform(F.slice(F.split(lines, "\n"), 1, 15), lambda x, i: F.struct(i.alias("at"), F.trim(x).alias("line")))
    whole = r"(?i)^(?:abstract|references|contents|table of contents|introduction|chapter \d+)$|^\d+$"
    begins = r"(?i)^(?:doi|issn|isbn|keywords|author|authors|by)\b"
    fit = F.filter(first, lambda x: F.length(x["line"]).between(8, 220) & ~x["line"].rlike(whole) & ~x["line"].rlike(begins))
    mark = lambda ok, n: F.when(ok, n).otherwise(0)
    score = lambda s: mark(F.length(s).between(20, 160), 4) + mark(~s.rlike("[.?!]$"), 2) + mark(s.rlike("[A-Za-z]"), 2) + mark(~s.rlike(r"(?i)^(?:vol|volume|issue|report|doi|issn|isbn)\b"), 2)
    ranked = F.array_sort(F.transform(fit, lambda x: F.struct((-score(x["line"])).alias("minus"), x["at"], x["line"])))
    return F.get(ranked, F.lit(0))["line"]


def author_lines(lines: Column) -> Column:
    """EXT13: of the first 20 lines those that begin with a word for authors, and those that hold names alone."""
    lead = r"(?i)^(?:by|authors?|author information|written by)\b"
    word = r"[A-Za-z][A-Za-z.'\-]+"
    place = r"(?i)(?:university|department|journal|press|report|conference|school|institute)"

    def value(x: Column) -> Column:
        people = F.split(x, r",\s*")
        first = F.get(people, F.lit(0)).rlike(rf"^{word}(?:\s+{word}){{1,5}}$")
        rest = F.forall(F.slice(people, 2, F.greatest(F.size(people) - 1, F.lit(0))), lambda p: p.rlike(rf"^{word}(?:\s+{word}){{0,3}}$"))
        told = blank_to_null(F.trim(F.regexp_replace(x, rf"{lead}\s*[:\-]?\s*", "")))
        return F.when(x.rlike(lead), told).when(first & rest & ~x.rlike(place), F.trim(x))

    return F.array_distinct(F.array_compact(F.transform(F.slice(F.split(lines, "\n"), 1, 20), value)))


def abstract(lines: Column) -> Column:
    """EXT13: up to twelve lines from one that begins with `abstract`, else the text between that word and the next part."""
    block = first_match(lines, r"(?im)^abstract\b[ \t]*[:\-]?[ \t]*(.*(?:\n(?!(?:keywords|introduction|background|methods|references|1\.|i\.)\b).*){0,11})")
    between = first_match(flat(lines), r"(?i)\babstract\s*[:\-]?\s*(.{40,1200}?)(?:\bkeywords\b|\bintroduction\b|\breferences\b)")
    return F.when(lines.rlike(r"(?im)^abstract\b"), blank_to_null(flat(block))).otherwise(F.trim(between))


def case_name(lines: Column) -> Column:
    """EXT13: the first line with `A v. B`, else such a name within the text, of at most 200 characters before the `v.`."""
    line = first_match(lines, r"(?im)^(.*\b\w+[ \t]+(?:v\.|vs\.|versus)[ \t]+\w.*)$")
    inside = first_match(flat(lines), r"\b([A-Z][A-Za-z0-9&.' \-]{1,200}?\s(?:v\.|vs\.|versus)\s+[A-Z][A-Za-z0-9&.' \-]+)\b")
    return F.coalesce(F.trim(line), F.trim(inside))


def _rule(field: str, labels: tuple[str, ...], name: str | None, more: tuple[str, ...] = ()) -> dict:
    line = any_label(labels) if labels else None
    return {"field": field, "line": line, "forms": [p for x in labels for p in label_patterns(x)], "patterns": [*PATTERNS.get(name, ()), *more]}


def _rules() -> Column:
    """The fixed tables as one literal: type to the rules of its fields."""
    compact = {("article-journal", "volume"): (_VOLUME,), ("article-journal", "issue"): (_ISSUE,), ("article-journal", "pages"): (_SPAN,)}
    table = {}
    for kind, own in {**LABELS, "unknown": {}}.items():
        table[kind] = [_rule(f, labels, name, compact.get((kind, f), ())) for f, (labels, name) in {**SHARED, **own}.items()]
        if kind in PEOPLE:
            table[kind].append(_rule(*PEOPLE[kind], None))
    return F.from_json(F.lit(json.dumps(table)), "map<string,array<struct<field:string,line:string,forms:array<string>,patterns:array<string>>>>")


def _value(rule: Column, lines: Column, text: Column) -> Column:
    told = value_at(lines, rule["line"], rule["forms"])
    found = F.transform(rule["patterns"], lambda p: blank_to_null(F.call_function("regexp_extract", text, p, F.lit(1))))
    return F.coalesce(told, F.get(F.array_compact(found), F.lit(0)))


def source_fields(df: DataFrame, text: str = "text", kind: str = "source_type", given: Column | None = None) -> DataFrame:
    """EXT12, EXT9: a map `fields` of the fields of a row's type that its text tells. given: a map of values known before (file,
    tags), which win. A type without rules has the shared fields."""
    d = df.withColumn("_lines", lines_of(F.coalesce(F.col(text), F.lit(""))))
    d = d.withColumn("_flat", flat(F.col("_lines")))
    rules = F.coalesce(F.try_element_at(_rules(), F.col(kind)), F.try_element_at(_rules(), F.lit("unknown")))
    told = F.map_from_entries(F.transform(rules, lambda r: F.struct(r["field"], _value(r, F.col("_lines"), F.col("_flat")))))
    known = F.create_map().cast("map<string,string>") if given is None else F.coalesce(given, F.create_map().cast("map<string,string>"))
    d = d.withColumn("_told", told).withColumn("_given", F.map_filter(known, lambda _, v: F.coalesce(F.trim(v), F.lit("")) != ""))
    have = lambda f: F.coalesce(F.try_element_at("_given", F.lit(f)), F.try_element_at("_told", F.lit(f)))
    title, author = F.col("_title"), F.col("_author")
    d = d.withColumns({"_title": F.coalesce(have("title"), guess_title(F.col("_lines"))), "_author": F.coalesce(have("author"), blank_to_null(F.array_join(author_lines(F.col("_lines")), "; ")))})
    about = F.coalesce(have("abstract"), abstract(F.col("_lines")))
    both = {"title": title, "author": author, "abstract": about, "caseName": F.when(F.col(kind) == "legal-case", F.coalesce(case_name(F.col("_lines")), title))}
    for types, field in (({k for k, v in PEOPLE.items() if v[0] == f}, f) for f in dict.fromkeys(v[0] for v in PEOPLE.values())):
        # A patent's own labels come before its author; in other types the author does.
        pair = (have(field), author) if field == "inventorOrAssignee" else (author, have(field))
        both[field] = F.when(F.col(kind).isin(*sorted(types)), F.coalesce(*pair))
    guesses = F.create_map(*(x for k, v in both.items() for x in (F.lit(k), v)))
    # Later maps win: labels, then what was given, then the composed fields.
    merged = F.map_zip_with(F.map_zip_with("_told", "_given", lambda _, a, b: F.coalesce(b, a)), guesses, lambda _, a, b: F.coalesce(b, a))
    return d.withColumn("fields", F.map_filter(merged, lambda _, v: F.coalesce(v, F.lit("")) != "")).drop("_lines", "_flat", "_told", "_given", "_title", "_author")


def page_text(html: Column) -> Column:
    """Text of a page in which block elements end lines."""
    c = F.regexp_replace(html, r"(?is)<(script|style|noscript)\b[^>]*>.*?</\1\s*>|<!--.*?-->", " ")
    c = F.regexp_replace(c, r"(?i)<(?:br|/?(?:p|div|li|tr|h[1-6]|article|section|header|footer|title|dd|table))\b[^>]*>", "\n")
    return lines_of(F.replace(extract.unescape_html(F.regexp_replace(c, r"<[^>]+>", " ")), F.lit("\t"), F.lit(" ")))


def page_value(html: Column, *labels: str) -> Column:
    """EXT6: the element that follows one with a label alone, else `label: value` within the text of the page."""
    names_ = "|".join(rf"\Q{x}\E" for x in labels)
    beside = first_match(html, rf"(?is)<(?:th|td|dt|b|strong|span|div|label|h[1-6])\b[^>]*>\s*(?:{names_})\s*:?\s*</(?:th|td|dt|b|strong|span|div|label|h[1-6])\s*>\s*<(?:td|dd|span|div|p|a)\b[^>]*>(.*?)</(?:td|dd|span|div|p|a)\s*>")
    own = blank_to_null(flat(extract.unescape_html(F.regexp_replace(beside, r"<[^>]+>", " "))))
    return F.coalesce(own, labelled(page_text(html), *labels))


def page_fields(df: DataFrame, html: str = "html", url: str = "url", kind: str = "source_type", heading: Callable[[Column], Column] = extract.unescape_html) -> DataFrame:
    """EXT14: the fields of a page: meta tags first, then its text. heading: what is shown of the mark-up within the
    heading or the title element that names the page."""
    tags = {"title": "title", "author": "author", "publicationDate": "issued", "journalTitle": "container_title", "volume": "volume", "issue": "issue", "doi": "DOI", "issn": "ISSN", "isbn": "ISBN", "publisher": "publisher", "abstract": "abstract"}
    d = df.withColumn("_metas", extract.metas(F.col(html))).withColumn("_page", page_text(F.col(html)))
    values = {k: F.array_join(extract.meta_values(F.col("_metas"), f), "; ") if f == "author" else F.get(extract.meta_values(F.col("_metas"), f), F.lit(0)) for k, f in tags.items()}
    values["title"] = F.coalesce(values["title"], extract.element(F.col(html), "h1", heading), extract.element(F.col(html), "title", heading))
    given = F.create_map(*(x for k, v in {**values, "url": F.col(url)}.items() for x in (F.lit(k), v)))
    return source_fields(d, "_page", kind, given).drop("_metas", "_page")


def linked_article(html: Column) -> Column:
    """EXT10: title, authors, journal, volume, issue, pages, date, publisher and ISSN that the meta tags of an article tell."""

    def made(m: Column) -> Column:
        one = lambda f: F.get(extract.meta_values(m, f), F.lit(0))
        pages = F.when(one("page_first").isNotNull(), F.concat_ws("-", one("page_first"), one("page_last")))
        plain = (("title", "title"), ("container_title", "journal"), ("volume", "volume"), ("issue", "issue"), ("issued", "date"), ("publisher", "publisher"), ("ISSN", "issn"))
        return F.struct(extract.meta_values(m, "author").alias("authors"), pages.alias("pages"), *(one(f).alias(k) for f, k in plain))

    return once(extract.metas(html), made)


def pdf_record(df: DataFrame, info: Column, text: str = "text", url: str = "url", file: str = "file") -> DataFrame:
    """EXT9: a record of a PDF from what its readers tell: info (extract.pdf_info), its text, its address and its file name."""
    found, header = identifiers.identifiers_in(F.col(text)), extract.text_header(F.col(text))
    doi = F.coalesce(identifiers.doi_in_url(F.col(url))["id"], identifiers.from_file_name(F.col(file))["doi"], info["DOI"], header["doi"], found["DOI"])
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.col(file), r"(?i)\.pdf$", ""), "[_-]+", " "))
    people = F.when(info["author"].isNotNull(), names.form_names(info["author"], r";|\sand\s")).otherwise(names.form_names(F.array_join(author_lines(lines_of(F.col(text))), "; ")))
    issued = F.coalesce(dates.front_date(F.substring(text, 1, 3000)), info["issued"])
    values = {"title": F.coalesce(blank_to_null(info["title"]), header["title"], blank_to_null(plain)), "author": people, "issued": issued, "DOI": doi, "ISBN": F.coalesce(info["ISBN"], found["ISBN"]), "URL": F.col(url)}
    return df.select("*", *(v.alias(k) for k, v in values.items() if k not in df.columns), F.when(doi.isNotNull(), "article-journal").otherwise("document").alias("record_type"))
