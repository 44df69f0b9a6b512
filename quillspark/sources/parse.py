"""Readers of exchange formats (SRC): a column of file contents in, one row per record out.

A content is cut at record boundaries by built-in functions and each record is taken apart by expressions, so that
reading stays in the JVM and in parallel. `read` cuts large files into records while it scans them.
Every parser takes a DataFrame with a column of contents and returns its other columns, `_seq` (number of the entry in
its content, from 1), the record's columns and `_errors` (array of texts).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark import schema
from quillspark.functions import dates, identifiers, names
from quillspark.functions.text import blank_to_null, clean_latex, dash_pages, lookup, strip_braces
from quillspark.tables import materialise

CUT = {"ris": r"(?m)^(?=TY  -)", "medline": r"(?m)^(?=PMID-)"}
#: Record boundaries at which a scan may cut a large file.
SEPARATORS = {"bibtex": "\n@", "ris": "\nER  -", "medline": "\n\n"}


def _none() -> Column:
    return F.array().cast("array<string>")


def _entries(df: DataFrame, content: str, pieces: Column) -> DataFrame:
    """One row per piece, with its number."""
    rest = [c for c in df.columns if c != content]
    return df.select(*rest, F.posexplode(pieces).alias("_at", "_entry")).withColumn("_seq", F.col("_at") + 1).drop("_at")


def _finish(df: DataFrame, before: list[str], columns: dict[str, Column]) -> DataFrame:
    return df.select(*before, "_seq", *(c.alias(k) for k, c in columns.items()))


# BibTeX: a braced value, a quoted one, a number or a macro's name, joined by #. Braces may lie LEVELS deep within a value;
# an entry with deeper ones is reported.
LEVELS = 40
_BRACED = "[^{}]*+"
for _ in range(LEVELS):
    _BRACED = r"(?:[^{}]++|\{" + _BRACED + r"\})*+"
_VALUE = r"(?:\{" + _BRACED + r"\}|\"(?:[^\"{}]++|\{" + _BRACED + r"\})*+\"|\d+|[A-Za-z][\w-]*)"
# An entry up to its own delimiter, so that an @ within a value opens none; one that is not closed ends before the next.
_ENTRY = r"@[A-Za-z]+\s*(?:\{" + _BRACED + r"\}|\((?:[^(){}]++|\{" + _BRACED + r"\}|\([^()]*+\))*+\)|[{(](?s:.*?)(?=\n\s*@[A-Za-z]+\s*[{(]|\z))"
_FIELD = r"([A-Za-z][\w-]*)\s*=\s*(" + _VALUE + r"(?:\s*#\s*" + _VALUE + ")*+)"


def _bibtex_value(c: Column) -> Column:
    """SRC1a: parts without their outer delimiters, end to end."""
    parts = F.regexp_extract_all(c, F.lit(_VALUE), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r'^[{"]'), F.substring(p, F.lit(2), F.length(p) - 2)).otherwise(p)), "")


def bibtex(df: DataFrame, content: str = "content") -> DataFrame:
    """SRC1. @string, @preamble, @comment and lines that begin with % are skipped; of a repeated field the last counts.
    An entry without a closing delimiter is read as far as it goes and reported."""
    before = [c for c in df.columns if c != content]
    text = F.regexp_replace(content, r"(?m)^\s*%.*$", "")
    pieces = F.filter(F.regexp_extract_all(text, F.lit(_ENTRY), F.lit(0)), lambda p: ~p.rlike(r"(?i)^@(string|preamble|comment)\b"))
    got = _entries(df, content, pieces)
    body = F.regexp_replace("_entry", r"^@[A-Za-z]+\s*[{(]\s*[^,})]*,?", "")
    pairs = F.arrays_zip(F.transform(F.regexp_extract_all(body, F.lit(_FIELD), F.lit(1)), F.lower).alias("k"), F.regexp_extract_all(body, F.lit(_FIELD), F.lit(2)).alias("v"))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["k"] == p["k"]))
    got = got.withColumn("_raw", F.map_from_entries(F.transform(last, lambda p: F.struct(p["k"], p["v"]))))
    got = got.withColumn("_f", F.transform_values("_raw", lambda _, v: clean_latex(_bibtex_value(v))))
    f = lambda *keys: F.coalesce(*(F.try_element_at("_f", F.lit(k)) for k in keys))
    key = F.trim(F.regexp_extract("_entry", r"^@[A-Za-z]+\s*[{(]\s*([^,})]*)", 1))
    url = f("url", "howpublished")
    people = lambda k: F.when(f(k).isNotNull(), names.bibtex_names(F.regexp_replace(f(k), r"^\{(.*\sand\s.*)\}$", "$1")))
    columns = {
        "id": key, "type": lookup(schema.BIBTEX_TYPES, F.lower(F.regexp_extract("_entry", r"^@([A-Za-z]+)", 1)), "document"), "citation_key": key,
        "title": strip_braces(f("title")), "author": people("author"), "editor": people("editor"),
        "issued": dates.bibtex_date(f("year"), f("month"), f("day"), f("date")), "container_title": strip_braces(f("journal", "journaltitle", "booktitle")),
        "volume": f("volume"), "issue": f("number", "issue"), "page": dash_pages(f("pages")), "publisher": strip_braces(f("publisher", "organization", "institution")), "publisher_place": f("address", "location"),
        "DOI": f("doi"), "ISBN": f("isbn"), "ISSN": f("issn"), "URL": F.when(url.rlike(r"^(http|\\url\{|\{http)"), F.regexp_replace(url, r"\\url\{|[{}]", "")), "abstract": f("abstract"), "note": f("note", "annote"),
        "keyword": f("keywords", "keyword"), "edition": f("edition"), "chapter_number": f("chapter"), "collection_title": f("series"), "language": f("language"),
        "_errors": F.when(F.col("_entry").rlike(r"^@[A-Za-z]+\s*(?:\{" + _BRACED + r"\}|\((?:[^{}]++|\{" + _BRACED + r"\})*+)\s*$"), _none())
        .when(F.col("_entry").rlike(r"[})]\s*$"), F.array(F.concat(F.lit("braces do not match or lie too deep: "), key))).otherwise(F.array(F.concat(F.lit("entry is not closed: "), key))),
    }
    return _finish(got, before, columns)


def _tagged(df: DataFrame, content: str, cut: str, tag: str, value_at: int, opens: str) -> DataFrame:
    """Entries of a tagged line format as arrays of (tag, value); lines without a tag continue the value before."""
    text = F.replace(F.col(content), F.lit("\r"), F.lit(""))
    pieces = F.filter(F.split(text, cut), lambda p: p.startswith(opens))
    got = _entries(df, content, pieces)
    unfolded = F.regexp_replace("_entry", rf"\n(?!{tag})[ \t]*(?=\S)", " ")
    lines = F.filter(F.split(unfolded, "\n"), lambda x: x.rlike(f"^{tag}"))
    return got.withColumn("_lines", F.transform(lines, lambda x: F.struct(F.upper(F.trim(F.substring(x, 1, value_at - 2))).alias("tag"), F.trim(F.substring(x, F.lit(value_at + 1), F.length(x))).alias("value"))))


def _all(*tags: str) -> Column:
    return F.transform(F.filter("_lines", lambda x: x["tag"].isin(*tags) & (x["value"] != "")), lambda x: x["value"])


def _first(*tags: str) -> Column:
    return F.get(_all(*tags), F.lit(0))


def _last(*tags: str) -> Column:
    return F.try_element_at(_all(*tags), F.lit(-1))


def _people(values: Column, one) -> Column:
    return F.when(F.size(values) > 0, F.transform(values, one))


def ris(df: DataFrame, content: str = "content") -> DataFrame:
    """SRC2. TY opens an entry; it ends with ER, the next TY or the content. DA wins over PY."""
    before = [c for c in df.columns if c != content]
    text = df.withColumn(content, F.regexp_replace(content, r"(?m)^ER  -.*$", ""))
    got = _tagged(text, content, CUT["ris"], "[A-Za-z][A-Za-z0-9]  -", 5, "TY")
    got = got.withColumn("_lines", F.transform("_lines", lambda x: F.struct(F.trim(F.regexp_replace(x["tag"], "-", "")).alias("tag"), x["value"].alias("value"))))
    sn = _last("SN")
    is_book = (F.length(sn) > 10) | sn.contains("978") | sn.contains("979")
    sp, ep = _last("SP"), _last("EP")
    columns = {
        "id": F.coalesce(_last("ID"), F.concat(F.lit("ris-"), F.col("_seq"))), "type": lookup(schema.RIS_TYPES, _first("TY"), "document"), "title": _last("TI", "T1"),
        "container_title": _first("T2", "JO", "JF", "JA", "J1", "J2", "BT"), "collection_title": _last("T3"), "author": _people(_all("AU", "A1"), names.ris_name), "editor": _people(_all("A2", "ED"), names.ris_name),
        "issued": F.coalesce(dates.slash_date(_last("DA")), dates.slash_date(_last("PY", "Y1"))), "volume": _last("VL"), "issue": _last("IS", "CP"), "page": F.when(sp.isNotNull(), F.concat_ws("–", sp, ep)),
        "ISBN": F.when(is_book, sn), "ISSN": F.when(~is_book, sn), "DOI": _last("DO"), "URL": _first("UR", "L1", "L2"), "call_number": _last("AN"), "publisher": _last("PB"), "publisher_place": _last("CY", "PP"),
        "abstract": _last("AB", "N2"), "note": _last("N1"), "keyword": blank_to_null(F.array_join(_all("KW"), ", ")), "language": _last("LA"), "edition": _last("ET"), "_errors": _none(),
    }
    return _finish(got, before, columns)


def medline(df: DataFrame, content: str = "content") -> DataFrame:
    """SRC5. PMID opens an entry; six spaces continue a value."""
    before = [c for c in df.columns if c != content]
    got = _tagged(df, content, CUT["medline"], "[A-Z][A-Z0-9 ]{3}- ", 6, "PMID")
    got = got.withColumn("_lines", F.transform("_lines", lambda x: F.struct(F.trim(F.regexp_replace(x["tag"], "-", "")).alias("tag"), x["value"].alias("value"))))
    kinds = F.transform(_all("PT"), F.lower)
    issn = F.get(F.filter(F.transform(_all("IS"), lambda v: F.split(v, " ")[0]), lambda v: F.length(v) <= 9), F.lit(0))
    columns = {
        "id": F.concat(F.lit("medline-"), F.col("_seq")), "type": F.when(F.exists(kinds, lambda k: k.contains("review")), "review").when(F.exists(kinds, lambda k: k.contains("book")), "book").otherwise("article-journal"),
        "PMID": _last("PMID"), "title": _last("TI"), "author": _people(_all("AU"), names.medline_name), "container_title": _first("TA", "JT"), "issued": dates.medline_date(_last("DP")), "volume": _last("VI"), "issue": _last("IP"),
        "page": F.replace(_last("PG"), F.lit("-"), F.lit("–")), "abstract": _last("AB"), "DOI": F.trim(F.regexp_replace(F.get(F.filter(_all("AID"), lambda v: v.contains("[doi]")), F.lit(0)), r"\[doi\]", "")), "ISSN": issn,
        "language": _last("LA"), "keyword": blank_to_null(F.array_join(_all("MH", "OT"), ", ")), "PMCID": _last("PMC"), "_errors": _none(),
    }
    return _finish(got, before, columns)


def endnote(df: DataFrame, content: str = "content") -> DataFrame:
    """SRC4. Styled text keeps its words; dashes of pages become en dashes."""
    before = [c for c in df.columns if c != content]
    pieces = F.regexp_extract_all(F.regexp_replace(content, r"</?style[^>]*>", ""), F.lit(r"(?s)<record(?:\s[^>]*)?>.*?</record>"), F.lit(0))
    got = _entries(df, content, pieces)

    def unescape(c: Column) -> Column:
        for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
            c = F.replace(c, F.lit(a), F.lit(b))
        return F.trim(c)

    every = lambda tag: F.filter(F.transform(F.regexp_extract_all("_entry", F.lit(rf"(?s)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>"), F.lit(1)), unescape), lambda x: x != "")
    one = lambda tag: F.get(every(tag), F.lit(0))
    kind = F.coalesce(identifiers.first_match(F.col("_entry"), r'<ref-type[^>]*name="([^"]*)"'), one("ref-type"))
    authors = F.filter(every("author"), lambda x: ~x.contains("<"))
    doi = one("electronic-resource-num")
    urls = F.filter(F.flatten(F.array(every("url"), every("pdf-urls"))), lambda u: u.startswith("http"))
    columns = {
        "id": F.concat(F.lit("endnote-"), F.col("_seq")), "type": lookup(schema.ENDNOTE_TYPES, F.lower(kind), "document"), "title": one("title"), "container_title": F.coalesce(one("secondary-title"), one("full-title")),
        "author": _people(authors, names.endnote_name), "issued": dates.date(dates.leading(one("year").try_cast("int"))), "volume": one("volume"), "issue": one("number"), "page": F.replace(one("pages"), F.lit("-"), F.lit("–")),
        "ISBN": F.when(F.length(one("isbn")) > 9, one("isbn")), "ISSN": F.coalesce(one("issn"), F.when(F.length(one("isbn")) <= 9, one("isbn"))), "DOI": F.when(doi.contains("10."), doi), "URL": F.get(urls, F.lit(0)),
        "publisher": one("publisher"), "publisher_place": one("pub-location"), "abstract": one("abstract"), "note": one("notes"), "language": one("language"), "keyword": blank_to_null(F.array_join(every("keyword"), ", ")), "_errors": _none(),
    }
    return _finish(got, before, columns)


def _json_schema() -> T.StructType:
    def renamed(t: T.DataType) -> T.DataType:
        if isinstance(t, T.StructType):
            return T.StructType([T.StructField(schema.json_name(f.name), renamed(f.dataType)) for f in t])
        return T.ArrayType(renamed(t.elementType)) if isinstance(t, T.ArrayType) else t

    return T.StructType([T.StructField(schema.json_name(k), renamed(v)) for k, v in schema.FIELDS.items()])


def csl_json(df: DataFrame, content: str = "content", strict: bool = False) -> DataFrame:
    """SRC3, SRC9: an array or one object; unknown keys are ignored. Records without id or type, or of an unknown type, are
    reported in `_errors`; strict: then no record of that content is returned."""
    before = [c for c in df.columns if c != content]
    kinds = _json_schema()
    text = F.trim(content)
    whole = F.when(text.startswith("["), text).otherwise(F.concat(F.lit("["), text, F.lit("]")))
    got = _entries(df.withColumn(content, F.from_json(whole, T.ArrayType(kinds))), content, F.coalesce(F.col(content), F.array().cast(T.ArrayType(kinds))))
    kind = F.replace(F.col("_entry.type"), F.lit("_"), F.lit("-"))
    bad = F.coalesce(F.col("_entry.id").isNull() | kind.isNull() | ~kind.isin(*schema.TYPES), F.lit(True))
    columns = {k: (kind if k == "type" else F.col("_entry").getField(schema.json_name(k)).cast(v)) for k, v in schema.FIELDS.items()}
    out = _finish(got, before, columns | {"_errors": F.when(bad, F.array(F.concat(F.lit("record without id or known type: "), F.coalesce(F.col("_entry.id"), F.lit("?"))))).otherwise(_none())})
    if strict and before:
        failed = out.where(F.size("_errors") > 0).select(*before).distinct()
        return out.join(failed, before, "left_anti")
    return out


# Headers that CSV files use for a column.
HEADERS = {
    "title": ("title", "Title", "TITLE", "Article Title", "Document Title", "Name"), "author": ("author", "Author", "AUTHORS", "authors", "Author(s)", "Creator"),
    "issued": ("year", "Year", "YEAR", "date", "Date", "Publication Year", "Pub Year", "Publication Date"), "container_title": ("journal", "Journal", "Source", "source", "Source Title", "Publication", "Container", "container-title"),
    "volume": ("volume", "Volume", "Vol", "vol"), "issue": ("issue", "Issue", "Number", "number", "No", "no"), "page": ("pages", "Pages", "Page", "page", "Start Page", "Page Range"),
    "DOI": ("doi", "DOI", "Doi", "Digital Object Identifier"), "URL": ("url", "URL", "Url", "Link", "link"), "publisher": ("publisher", "Publisher", "PUBLISHER"), "ISBN": ("isbn", "ISBN"), "ISSN": ("issn", "ISSN"),
    "abstract": ("abstract", "Abstract", "ABSTRACT", "Description"), "type": ("type", "Type", "Item Type", "Document Type", "Resource Type"), "keyword": ("keywords", "Keywords", "Tags", "tags", "Subjects"), "language": ("language", "Language", "Lang"),
}


def _csv_columns(value: dict[str, Column]) -> dict[str, Column]:
    """Columns of a record from the texts of the fields of a row."""
    made = {k: v for k, v in value.items() if k not in ("issued", "author", "type")}
    if "author" in value:
        made["author"] = F.when(value["author"].isNotNull(), names.csv_names(value["author"]))
    when = value.get("issued", F.lit(None).cast("string"))
    made["issued"] = dates.date(dates.integers(F.replace(when, F.lit("/"), F.lit("-")), "-"))
    known = {t: t for t in schema.TYPES} | schema.CSV_TYPES
    made["type"] = lookup(known, F.lower(value["type"]), "document") if "type" in value else F.lit("webpage")
    return made


def csv_records(table: DataFrame, seq: Column | None = None) -> DataFrame:
    """SRC6: rows of a table whose headers are known names; rows without a title go. Raises where no header is known."""
    field = {h: k for k, hs in HEADERS.items() for h in hs}
    found = {}
    for c in table.columns:
        found.setdefault(field.get(c.strip()), []).append(c)
    found.pop(None, None)
    if not found:
        raise ValueError(f"no known column among {table.columns}")
    value = {k: F.coalesce(*(blank_to_null(F.col(f"`{c}`")) for c in reversed(cs))) for k, cs in found.items()}
    number = F.monotonically_increasing_id() + 2 if seq is None else seq
    made = _csv_columns(value)
    return table.select(F.concat(F.lit("csv-"), number).alias("id"), number.alias("_seq"), *(c.alias(k) for k, c in made.items())).where("title IS NOT NULL")


def delimited(sep: str):
    """SRC6 for contents: the first line has the headers; a quoted field may hold separators, quotes and line ends."""
    quoted = r'"(?:[^"]|"")*+"'
    row, cell = rf'(?:{quoted}|[^"\n]++)++', rf'(?:^|{sep})({quoted}|[^"{sep}]*)'

    def cells(line: Column) -> Column:
        raw = F.regexp_extract_all(line, F.lit(cell), F.lit(1))
        return F.transform(raw, lambda x: F.when(x.startswith('"'), F.replace(F.substring(x, F.lit(2), F.length(x) - 2), F.lit('""'), F.lit('"'))).otherwise(x))

    def parse(df: DataFrame, content: str = "content") -> DataFrame:
        before = [c for c in df.columns if c != content]
        text = F.replace(F.replace(F.col(content), F.lit("\r\n"), F.lit("\n")), F.lit("\ufeff"), F.lit(""))
        lines = df.withColumn("_rows", F.regexp_extract_all(text, F.lit(row), F.lit(0)))
        field = {h: k for k, hs in HEADERS.items() for h in hs}
        heads = F.transform(cells(F.get("_rows", F.lit(0))), lambda h: lookup(field, F.trim(h)))
        lines = lines.withColumn("_heads", heads)
        got = lines.select(*before, "_heads", F.posexplode(F.slice("_rows", F.lit(2), F.size("_rows"))).alias("_at", "_entry"))
        got = got.withColumn("_cells", F.arrays_zip(F.col("_heads").alias("k"), cells(F.col("_entry")).alias("v"))).withColumn("_seq", F.col("_at") + 1)
        own = lambda k: F.filter("_cells", lambda x: (x["k"] == k) & blank_to_null(x["v"]).isNotNull())
        value = {k: blank_to_null(F.try_element_at(own(k), F.lit(-1))["v"]) for k in HEADERS}
        made = _csv_columns(value)
        made["type"] = F.when(F.array_contains("_heads", "type"), made["type"]).otherwise("webpage")
        columns = {"id": F.concat(F.lit("csv-"), F.col("_seq") + 1), **made, "_errors": F.when(F.size(F.array_compact("_heads")) > 0, _none()).otherwise(F.array(F.lit("no known column")))}
        return _finish(got, before, columns).where("title IS NOT NULL OR size(_errors) > 0")

    return parse


def read_csv(spark: SparkSession, path: str | list[str], sep: str = ",") -> DataFrame:
    return csv_records(spark.read.csv(path, header=True, sep=sep, quote='"', escape='"', multiLine=True))


def identifiers_text(df: DataFrame, content: str = "content") -> DataFrame:
    """SRC10: a placeholder record for each DOI and ISBN of a free text."""
    before = [c for c in df.columns if c != content]
    marks = F.concat(F.transform(identifiers.all_dois(F.col(content)), lambda x: F.struct(F.lit("DOI").alias("kind"), x.alias("value"))), F.transform(identifiers.all_isbns(F.col(content)), lambda x: F.struct(F.lit("ISBN").alias("kind"), x.alias("value"))))
    got = _entries(df, content, marks)
    is_doi = F.col("_entry.kind") == "DOI"
    value = F.col("_entry.value")
    columns = {"id": F.concat(F.lit("id-"), F.col("_seq")), "type": F.when(is_doi, "article-journal").otherwise("book"), "title": value, "DOI": F.when(is_doi, value), "ISBN": F.when(~is_doi, value), "_needsEnhance": F.lit(True), "_errors": _none()}
    return _finish(got, before, columns)


def sniff(c: Column) -> Column:
    """SRC11, SRC12: format by content."""
    s = F.ltrim(F.regexp_replace(c, r"^\s+", ""))
    line = F.split(s, "\n")[0]
    wide = lambda sep: F.size(F.split(line, sep)) >= 3
    return (
        F.when(s.startswith("@"), "bibtex").when(s.startswith("TY  -") | s.rlike(r"^[A-Z]{2}  -"), "ris").when(s.startswith("[") | s.startswith("{"), "csljson").when(s.rlike(r"^<(\?xml|xml|records)"), "endnote")
        .when(s.startswith("PMID-"), "medline").when(wide("\t"), "tsv").when(wide(","), "csv").otherwise("text")
    )


# File name endings.
ENDINGS = {"bib": "bibtex", "bibtex": "bibtex", "ris": "ris", "enw": "ris", "json": "csljson", "xml": "endnote", "nbib": "medline", "medline": "medline", "csv": "csv", "tsv": "tsv"}


def format_of_file(name: Column) -> Column:
    """SRC13: format by file name; null if unknown."""
    return lookup(ENDINGS, F.lower(F.regexp_extract(name, r"\.([A-Za-z]+)$", 1)))


PARSERS = {"bibtex": bibtex, "ris": ris, "medline": medline, "endnote": endnote, "csljson": csl_json, "csv": delimited(","), "tsv": delimited("\t"), "text": identifiers_text}


def conform(df: DataFrame) -> DataFrame:
    """All 89 columns of the record, then the others."""
    have = set(df.columns)
    rest = [c for c in df.columns if c not in schema.FIELDS]
    return df.select(*((F.col(k) if k in have else F.lit(None)).cast(v).alias(k) for k, v in schema.FIELDS.items()), *rest)


def parse_any(df: DataFrame, content: str = "content", fmt: Column | None = None) -> DataFrame:
    """Contents of mixed formats: each goes to its own parser; the results are one table (SRC22). A null content, and one
    of a format that no parser takes, is a row with an error. Only the parsers of the formats at hand are planned."""
    told = df.withColumn("_format", F.when(F.col(content).isNotNull(), sniff(F.col(content)) if fmt is None else F.coalesce(fmt, sniff(F.col(content)))))
    at_hand = list(PARSERS)
    if not df.isStreaming:
        told = materialise(told)  # so that files are read and sniffed once, not once a parser
        at_hand = [r[0] for r in told.select("_format").where(F.col("_format").isin(*PARSERS)).distinct().collect()] or ["text"]  # names of parsers only
    parts = [conform(PARSERS[k](told.where(F.col("_format") == k), content)) for k in PARSERS if k in at_hand]
    lost = told.where(F.col("_format").isNull() | ~F.col("_format").isin(*PARSERS)).drop(content)
    parts.append(conform(lost.withColumn("_errors", F.array(F.concat(F.lit("no parser for "), F.coalesce("_format", F.lit("a missing content")))))))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def read(spark: SparkSession, path: str | list[str], fmt: str | None = None, large: bool = False) -> DataFrame:
    """Records of files. fmt: None goes by file name, then by content. large: files of one line format are cut at record
    boundaries while they are scanned, so that one file is read by many tasks; entries are then numbered apart."""
    if fmt in ("csv", "tsv"):
        return conform(read_csv(spark, path, "," if fmt == "csv" else "\t"))
    if large and fmt in SEPARATORS:
        lines = spark.read.option("lineSep", SEPARATORS[fmt]).text(path).select("value")
        head = F.lit("@") if fmt == "bibtex" else F.lit("")
        whole = F.when(F.col("value").startswith("@") | (F.lit(fmt) != "bibtex"), F.regexp_replace("value", r"^\s+", "")).otherwise(F.concat(head, F.col("value")))
        return PARSERS[fmt](lines.select(whole.alias("content"))).withColumn("_seq", F.monotonically_increasing_id() + 1)
    files = spark.read.text(path, wholetext=True).select(F.col("value").alias("content"), F.input_file_name().alias("_file"))
    return PARSERS[fmt](files) if fmt else parse_any(files, fmt=format_of_file(F.col("_file")))
