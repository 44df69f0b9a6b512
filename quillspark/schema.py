"""The citation record: 89 columns, of which id and type are mandatory."""

from __future__ import annotations

from pyspark.sql import types as T

NAME = T.StructType([T.StructField(f, T.StringType()) for f in ("family", "given", "dropping_particle", "non_dropping_particle", "suffix", "literal")] + [T.StructField(f, T.BooleanType()) for f in ("comma_suffix", "static_ordering", "parse_names")])
DATE = T.StructType([T.StructField("date_parts", T.ArrayType(T.ArrayType(T.IntegerType()))), T.StructField("season", T.StringType()), T.StructField("circa", T.BooleanType()), T.StructField("literal", T.StringType()), T.StructField("raw", T.StringType())])
QUOTE = T.StructType([T.StructField(f, T.StringType()) for f in ("text", "page", "timestamp")])

# Names of the record's columns.
TITLES = (
    "title", "title_short", "container_title", "container_title_short", "collection_title", "volume_title",
)
ROLES = (
    "author", "editor", "translator", "reviewer", "collection_editor", "composer", "container_author", "director",
    "editorial_director", "illustrator", "interviewer", "original_author", "recipient",
)
DATES = (
    "issued", "accessed", "event_date", "original_date", "submitted",
)
NUMBERS = (
    "chapter_number", "collection_number", "edition", "issue", "number", "number_of_pages", "number_of_volumes",
    "volume",
)
STRINGS = (
    "page", "page_first", "abstract", "annote", "archive", "archive_location", "authority", "call_number",
    "citation_key", "citation_label", "dimensions", "division", "DOI", "event_title", "event_place", "genre", "ISBN",
    "ISSN", "jurisdiction", "keyword", "language", "license", "medium", "note", "original_publisher",
    "original_publisher_place", "original_title", "part_number", "PMCID", "PMID", "publisher", "publisher_place",
    "references", "reviewed_title", "scale", "section", "source", "status", "URL", "version", "year_suffix",
)
EXTENSIONS = {
    "_projectIds": T.ArrayType(T.StringType()), "_tags": T.ArrayType(T.StringType()), "_notes": T.StringType(), "_quotes": T.ArrayType(QUOTE), "_color": T.StringType(), "_starred": T.BooleanType(),
    "_dateAdded": T.StringType(), "_dateModified": T.StringType(), "_sourceUrl": T.StringType(), "_readStatus": T.StringType(), "_syncStatus": T.StringType(), "_syncHash": T.StringType(), "_importSource": T.StringType(),
    "_customFields": T.MapType(T.StringType(), T.StringType()),
}

FIELDS: dict[str, T.DataType] = {
    **{"id": T.StringType(), "type": T.StringType()},
    **{f: T.StringType() for f in TITLES},
    **{f: T.ArrayType(NAME) for f in ROLES},
    **{f: DATE for f in DATES},
    **{f: T.StringType() for f in (*NUMBERS, *STRINGS)},
    **EXTENSIONS,
}
RECORD = T.StructType([T.StructField(k, v, k not in ("id", "type")) for k, v in FIELDS.items()])

# The record types.
TYPES = (
    "article", "article-journal", "article-magazine", "article-newspaper", "bill", "book", "broadcast", "chapter",
    "classic", "collection", "dataset", "document", "entry", "entry-dictionary", "entry-encyclopedia", "event",
    "figure", "graphic", "hearing", "interview", "legal-case", "legislation", "manuscript", "map", "motion-picture",
    "musical-score", "pamphlet", "paper-conference", "patent", "performance", "periodical", "personal-communication",
    "post", "post-weblog", "regulation", "report", "review", "review-book", "software", "song", "speech", "standard",
    "thesis", "treaty", "webpage",
)

# Source types to record types; others are document.
BIBTEX_TYPES = {
    "article": "article-journal", "book": "book", "proceedings": "book", "booklet": "pamphlet", "inbook": "chapter", "incollection": "chapter", "inproceedings": "paper-conference", "conference": "paper-conference",
    "manual": "report", "report": "report", "techreport": "report", "mastersthesis": "thesis", "phdthesis": "thesis", "thesis": "thesis", "misc": "document", "unpublished": "document", "online": "webpage",
    "electronic": "webpage", "patent": "patent", "software": "software", "dataset": "dataset",
}
RIS_TYPES = {
    "JOUR": "article-journal", "JFULL": "article-journal", "MGZN": "article-journal", "BOOK": "book", "WHOLE": "book", "CHAP": "chapter", "SECT": "chapter", "CONF": "paper-conference", "CPAPER": "paper-conference",
    "THES": "thesis", "RPRT": "report", "NEWS": "article-newspaper", "ELEC": "webpage", "ICOMM": "webpage", "BLOG": "post-weblog", "PAT": "patent", "DATA": "dataset", "COMP": "software", "MAP": "map",
    "MPCT": "motion-picture", "VIDEO": "motion-picture", "SOUND": "song", "MUSIC": "song", "BILL": "bill", "CASE": "legal-case", "STAT": "legislation", "ENCYC": "entry-encyclopedia", "DICT": "entry-dictionary",
    "SLIDE": "figure", "ART": "figure", "FIGURE": "figure", "HEAR": "hearing", "UNPB": "manuscript",
}
ENDNOTE_TYPES = {
    "journal article": "article-journal", "0": "article-journal", "17": "article-journal", "electronic article": "article-journal", "43": "article-journal", "book": "book", "6": "book", "edited book": "book", "28": "book",
    "book section": "chapter", "5": "chapter", "conference paper": "paper-conference", "conference proceedings": "paper-conference", "10": "paper-conference", "47": "paper-conference", "thesis": "thesis", "32": "thesis",
    "report": "report", "27": "report", "web page": "webpage", "12": "webpage", "newspaper article": "article-newspaper", "23": "article-newspaper", "magazine article": "article-magazine", "19": "article-magazine",
    "patent": "patent", "25": "patent", "film or broadcast": "motion-picture", "21": "motion-picture", "computer program": "software", "9": "software", "map": "map", "20": "map", "bill": "bill", "3": "bill",
    "case": "legal-case", "7": "legal-case", "statute": "legislation", "31": "legislation", "hearing": "hearing", "14": "hearing",
}
CSV_TYPES = {
    "journal article": "article-journal", "article": "article-journal", "book": "book", "chapter": "chapter", "book section": "chapter", "conference": "paper-conference", "conference paper": "paper-conference",
    "thesis": "thesis", "dissertation": "thesis", "report": "report", "webpage": "webpage", "web page": "webpage",
}
CROSSREF_TYPES = {"journal-article": "article-journal", "book-chapter": "chapter", "proceedings-article": "paper-conference", "book": "book", "monograph": "book", "report": "report", "dataset": "dataset", "posted-content": "article", "dissertation": "thesis"}
OPENALEX_TYPES = {**CROSSREF_TYPES, "article": "article-journal", "review": "article-journal", "paratext": "webpage"}
CITOID_TYPES = {
    "journalArticle": "article-journal", "newspaperArticle": "article-newspaper", "magazineArticle": "article-magazine", "book": "book", "bookSection": "chapter", "conferencePaper": "paper-conference",
    "thesis": "thesis", "report": "report", "blogPost": "post-weblog", "webpage": "webpage", "patent": "patent", "film": "motion-picture", "dataset": "dataset", "computerProgram": "software",
    "statute": "legislation", "case": "legal-case", "presentation": "speech", "encyclopediaArticle": "entry-encyclopedia", "dictionaryEntry": "entry-dictionary",
}
# Record types to target types; the last is for all others.
TO_BIBTEX = {
    "article-journal": "article", "article-magazine": "article", "article-newspaper": "article", "book": "book", "collection": "book", "chapter": "incollection", "paper-conference": "inproceedings", "thesis": "phdthesis",
    "report": "techreport", "webpage": "online", "post": "online", "post-weblog": "online", "software": "software", "pamphlet": "booklet", "manuscript": "unpublished",
}
TO_RIS = {
    "article-journal": "JOUR", "article-magazine": "JOUR", "article-newspaper": "NEWS", "book": "BOOK", "collection": "BOOK", "chapter": "CHAP", "paper-conference": "CPAPER", "thesis": "THES", "report": "RPRT", "patent": "PAT",
    "webpage": "ELEC", "post": "BLOG", "post-weblog": "BLOG", "software": "COMP", "dataset": "DATA", "map": "MAP", "motion-picture": "MPCT", "song": "SOUND", "bill": "BILL", "legal-case": "CASE", "legislation": "STAT",
    "entry-encyclopedia": "ENCYC", "entry-dictionary": "DICT", "manuscript": "UNPB", "hearing": "HEAR",
}
TO_WORD = {
    "article-journal": "JournalArticle", "article-magazine": "JournalArticle", "book": "Book", "collection": "Book", "chapter": "BookSection", "paper-conference": "ConferenceProceedings", "thesis": "Report", "report": "Report",
    "webpage": "InternetSite", "post-weblog": "InternetSite", "article-newspaper": "ArticleInAPeriodical", "patent": "Patent", "motion-picture": "Film",
}


def json_name(column: str) -> str:
    """Name of a column in exchange files: words joined by hyphens, extensions as they are."""
    return column if column.startswith("_") else column.replace("_", "-")
