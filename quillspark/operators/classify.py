"""Source type of a text by weighted evidence (EXT11, AGG6, AGG7, SRT3): each rule is a pattern, a type and a weight."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Type, weight, pattern. Ties go to the type that comes first.
RULES: tuple[tuple[str, int, str], ...] = (
    ("article-journal", 8, r"\b10\.\d{4,9}/[-._;()/:A-Za-z0-9]+"),
    ("article-journal", 6, r"(?i)\b(?:Journal of|Review|Quarterly|Transactions|Annals|Letters|Nature Reviews)\b"),
    ("article-journal", 4, r"(?i)\bvol\.?\s*(\d+)\b"),
    ("article-journal", 4, r"(?i)\b(?:issue|no\.?|number)\s*(\d+)\b"),
    ("article-journal", 3, r"(?i)\bpp?\.?\s*(\d+)\s*[-–—]\s*(\d+)\b|\b(\d+)\((\d+)\)\s*:\s*(\d+)\s*[-–—]\s*(\d+)\b"),
    ("article-journal", 5, r"(?i)\bISSN(?:-1[03])?:?\s*\d{4}-\d{3}[\dX]\b"),
    ("article-newspaper", 6, r"(?i)\b(?:Times|Herald|Post|Daily|Guardian|Telegraph|Tribune|Chronicle)\b"),
    ("article-newspaper", 2, r"(?i)\b(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Sept|Oct|Nov|Dec)[a-z]*\.?\s+\d{1,2},\s+\d{4}\b|\b\d{1,2}\s+(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Sept|Oct|Nov|Dec)[a-z]*\.?\s+\d{4}\b"),
    ("article-magazine", 6, r"(?i)\bmagazine\b"),
    ("post-weblog", 7, r"(?i)\b(?:blog|weblog|posted on|posted by|comments)\b"),
    ("book", 10, r"(?i)\bISBN(?:-1[03])?:?\s*(97[89][- ]?)?\d{1,5}[- ]?\d+[- ]?\d+[- ]?[\dX]\b"),
    ("book", 4, r"(?i)\b(?:Press|Publishing|Publications|Springer|Elsevier|Wiley|Routledge|Cambridge University Press|Oxford University Press|MIT Press|Sage)\b"),
    ("book", 4, r"(?i)\b(\d+(?:st|nd|rd|th)\s+ed(?:ition)?|revised edition)\b"),
    ("chapter", 8, r"(?i)\bIn:"),
    ("chapter", 5, r"(?i)\b(?:Eds?\.|edited by\b|editors?\b)"),
    ("paper-conference", 9, r"(?i)\bProceedings of\b"),
    ("paper-conference", 6, r"(?i)\b(?:conference|symposium|workshop|congress|meeting)\b"),
    ("thesis", 10, r"(?i)\b(?:thesis|dissertation)\b"),
    ("thesis", 5, r"(?i)\b(?:PhD|MSc|BSc|Master'?s|Doctor of Philosophy)\b"),
    ("report", 8, r"(?i)\b(?:technical report|report(?:\s+no\.?|\s+number)?|white paper|system card)\b"),
    ("report", 5, r"(?i)\b(?:report no\.?|report number|document number|series number)\s*:?\s*([A-Z0-9\-/\.]+)"),
    ("legislation", 8, r"(?i)\b(?:Act|Regulations|Statute|Code|Bill|Ordinance)\b"),
    ("legislation", 3, r"(?i)\b(?:Commonwealth|State of|Province of|Republic of|United States|Australia|United Kingdom|Victoria|New South Wales|Queensland|Canada)\b"),
    ("legal-case", 8, r"(?i)\b(?:v\.\s|vs\.\s|versus\b)"),
    ("legal-case", 5, r"(?i)\b(?:Court|Judge|Justice|Appeal|Circuit|Supreme Court|High Court|Federal Court)\b"),
    ("legal-case", 6, r"\[(\d{4})\]\s+[A-Z][A-Za-z]+\s+\d+"),
    ("patent", 10, r"(?i)\b(?:patent|patent application|publication number|grant number|application number|WO\d{4,}|US\d{4,}|EP\d{4,}|JP\d{4,})\b"),
    ("patent", 6, r"(?i)\b(?:patent number|publication number|grant number)\s*:?\s*([A-Z0-9\-/\.]+)"),
    ("dataset", 10, r"(?i)\b(?:GSE\d+|SRR\d+|PRJNA\d+|ENSG\d+)\b"),
    ("dataset", 6, r"(?i)\b(?:GEO|SRA|ENA|Zenodo|Figshare|Dryad|OSF|GenBank)\b"),
    ("software", 7, r"(?i)\b(?:software|version|release|GitHub|GitLab|npm|PyPI|package|library|tool|toolkit)\b"),
    ("software", 4, r"(?i)\bversion\s*v?(\d+(?:\.\d+){0,3})\b"),
    ("motion-picture", 8, r"(?i)\b(?:film|movie|video|documentary|motion picture|directed by|producer)\b"),
    ("motion-picture", 3, r"(?i)\b(?:runtime|running time|duration)\s*:?\s*(\d{1,3})\s*(?:min|minutes)\b"),
    ("broadcast", 8, r"(?i)\b(?:broadcast|radio|podcast|episode|TV|television|aired on|broadcaster|network|station)\b"),
    ("webpage", 3, r"(?i)\bhttps?://[^\s<>()]+|www\.[^\s<>()]+"),
    ("webpage", 2, r"(?i)\b(?:accessed|retrieved|available at|viewed on)\b"),
)
# What a text in lower case must hold for a rule to match, rule by rule: any of these alternatives, each of them one or more
# things that the pattern cannot do without: words (whole runs of letters), # for a digit, other pieces of text.
NEEDS: tuple[tuple[tuple[str, ...] | str, ...], ...] = (
    (("#", "10."),), (("journal", "of"), "review", "quarterly", "transactions", "annals", "letters", ("nature", "reviews")), (("#", "vol"),), (("#", "issue"), ("#", "no"), ("#", "number")), (("#", "-"), ("#", "–"), ("#", "—")), (("#", "issn"),),
    ("times", "herald", "post", "daily", "guardian", "telegraph", "tribune", "chronicle"), tuple(("#", f"*{m}") for m in ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")),
    ("magazine",), ("blog", "weblog", ("posted", "on"), ("posted", "by"), "comments"), (("#", "isbn"),), ("press", "publishing", "publications", "springer", "elsevier", "wiley", "routledge", "sage"), (("#", "ed"), ("#", "edition"), ("revised", "edition")),
    ("in:",), ("ed", "eds", ("edited", "by"), "editor", "editors"), (("proceedings", "of"),), ("conference", "symposium", "workshop", "congress", "meeting"), ("thesis", "dissertation"), ("phd", "msc", "bsc", ("master", "s"), "masters", ("doctor", "of", "philosophy")),
    ("report", ("white", "paper"), ("system", "card")), ("report", "document", "series"), ("act", "regulations", "statute", "code", "bill", "ordinance"),
    ("commonwealth", ("state", "of"), ("province", "of"), ("republic", "of"), ("united", "states"), "australia", ("united", "kingdom"), "victoria", ("new", "south", "wales"), "queensland", "canada"), ("v", "vs", "versus"),
    ("court", "judge", "justice", "appeal", "circuit"), (("#", "["),), ("patent", ("publication", "number"), ("grant", "number"), ("application", "number"), ("#", "wo"), ("#", "us"), ("#", "ep"), ("#", "jp")), ("patent", "publication", "grant"),
    (("#", "gse"), ("#", "srr"), ("#", "prjna"), ("#", "ensg")), ("geo", "sra", "ena", "zenodo", "figshare", "dryad", "osf", "genbank"), ("software", "version", "release", "github", "gitlab", "npm", "pypi", "package", "library", "tool", "toolkit"),
    (("#", "version"), ("#", "versionv")), ("film", "movie", "video", "documentary", ("motion", "picture"), ("directed", "by"), "producer"), (("#", "runtime"), ("#", "running", "time"), ("#", "duration")),
    ("broadcast", "radio", "podcast", "episode", "tv", "television", ("aired", "on"), "broadcaster", "network", "station"), ("http", "https", "www."), ("accessed", "retrieved", ("available", "at"), ("viewed", "on")),
)
# Fields that make a record of a type complete (A8).
REQUIRED = {
    "webpage": ("title", "url"),
    "article-journal": ("title", "author", "journalTitle", "year"),
    "article-newspaper": ("title", "publicationTitle", "publicationDate"),
    "article-magazine": ("title", "publicationTitle", "publicationDate"),
    "book": ("title", "authorOrEditor", "publisher", "year"),
    "chapter": ("title", "author", "bookTitle", "year"),
    "paper-conference": ("title", "author", "conferenceTitle", "year"),
    "thesis": ("title", "author", "institution", "year"),
    "report": ("title", "authorOrOrganization", "year"),
    "post-weblog": ("title", "authorOrBlogName", "publicationDate", "url"),
    "legislation": ("title", "jurisdiction", "year"),
    "legal-case": ("caseName", "court", "year"),
    "patent": ("title", "inventorOrAssignee", "patentNumber"),
    "dataset": ("title", "repository", "identifier"),
    "software": ("title", "version", "authorOrOrganization"),
    "motion-picture": ("title", "directorOrProducer", "year"),
    "broadcast": ("title", "broadcaster", "publicationDate"),
}


def kinds() -> list[str]:
    return list(dict.fromkeys(t for t, *_ in RULES))


#: A border of a word of ASCII letters, digits and _, whatever Java takes \\b for.
BORDER = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"


#: All words of `NEEDS`, and one pattern for them, by first letter, as whole runs of letters.
WORDS = sorted({x for needs in NEEDS for alternative in needs for x in ((alternative,) if isinstance(alternative, str) else alternative) if x.isalpha()})
VOCABULARY = "(?<![a-z])(?:" + "|".join(f"{a}(?:{'|'.join(x[1:] for x in WORDS if x[0] == a)})" for a in sorted({x[0] for x in WORDS})) + ")(?![a-z])"
#: Letters up to which a text is split into words, which is faster; the words of a longer one are sought by the pattern, which needs no list of them.
SPLIT = 1 << 20


def words_of(low: Column, split: int = SPLIT) -> Column:
    """Those words of `NEEDS` that a text in lower case holds, found in one pass."""
    listed = F.array_intersect(F.split(low, "[^a-z]+"), F.array(*map(F.lit, WORDS)))
    return F.when(F.octet_length(low) <= split, listed).otherwise(F.array_distinct(F.regexp_extract_all(low, F.lit(VOCABULARY), F.lit(0))))


def may_match(needs: tuple, low: Column, digit: Column, words: Column | None = None) -> Column:
    """Whether a text can match a rule: low is the text in lower case, digit tells whether it holds one, words are `words_of(low)`."""
    words = words_of(low) if words is None else words
    part = lambda x: digit if x == "#" else F.array_contains(words, x) if x.isalpha() else F.contains(low, F.lit(x.removeprefix("*")))
    every = [reduce(lambda a, b: a & b, map(part, (x,) if isinstance(x, str) else x)) for x in needs if not (isinstance(x, str) and x.isalpha())]
    alone = [x for x in needs if isinstance(x, str) and x.isalpha()]
    return reduce(lambda a, b: a | b, [*([F.arrays_overlap(words, F.array(*map(F.lit, alone)))] if alone else []), *every])


def lowered(text: Column) -> Column:
    """A text in lower case, without the two signs beyond ASCII whose lower case holds an ASCII letter: they border a word."""
    return F.lower(F.replace(F.replace(text, F.lit("\u0130"), F.lit(" ")), F.lit("\u212a"), F.lit(" ")))


def scores(text: Column, low: Column, digit: Column, words: Column) -> Column:
    """Score of each type with any evidence, best first; ties in order of the rules. A pattern is tried only on a text
    that holds what it cannot do without, which its words and a search for plain text tell."""
    totals, places = [], F.array(*map(F.lit, kinds()))
    for kind in kinds():
        hits = (F.when(may_match(needs, low, digit, words) & text.rlike(pattern.replace(r"\b", BORDER)), weight).otherwise(0) for (t, weight, pattern), needs in zip(RULES, NEEDS, strict=True) if t == kind)
        totals.append(reduce(lambda a, b: a + b, hits))
    each = F.transform(F.array(*totals), lambda x, i: F.struct((-x).alias("minus"), i.alias("place"), F.get(places, i).alias("type"), x.alias("score")))
    return F.array_sort(F.filter(each, lambda x: x["score"] > 0))


def classify(df: DataFrame, text: str = "text") -> DataFrame:
    """EXT11, AGG6: source_type, confidence (its share of all scores) and the five best types, for each row."""
    told = F.coalesce(F.col(text), F.lit(""))
    s = df.withColumns({"_low": lowered(told), "_digit": told.rlike("[0-9]")}).withColumn("_words", words_of(F.col("_low")))
    s = s.withColumn("_scores", scores(told, F.col("_low"), F.col("_digit"), F.col("_words"))).drop("_low", "_digit", "_words")
    total = F.aggregate("_scores", F.lit(0), lambda a, x: a + x["score"])
    best = F.get("_scores", F.lit(0))
    ranked = F.array_join(F.transform(F.slice("_scores", 1, 5), lambda x: F.concat_ws(":", x["type"], x["score"])), ",")
    return s.withColumns({"source_type": F.coalesce(best["type"], F.lit("unknown")), "confidence": F.round(F.coalesce(F.try_divide(best["score"], total), F.lit(0.0)), 6), "ranked": ranked}).drop("_scores")


def completeness(kind: Column, fields: Column) -> Column:
    """AGG7: share of the required fields of a type that a map of fields fills."""
    table = F.create_map(*(x for k, v in REQUIRED.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    need = F.try_element_at(table, kind)
    return F.size(F.filter(need, lambda f: F.coalesce(F.try_element_at(fields, f), F.lit("")) != "")) / F.size(need)
