"""Writers of exchange formats (SNK): each record becomes a text by expressions; files are written by Spark."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark import schema
from quillspark.functions import dates, names
from quillspark.functions.text import escape_csv, escape_xml, escape_yaml, lookup, undash_pages
from quillspark.sources.parse import conform

c = F.col
CSV_COLUMNS = ("type", "title", "author", "year", "container-title", "volume", "issue", "pages", "DOI", "URL", "publisher", "ISBN", "ISSN", "abstract", "keywords", "language")
# Month macros.
MACROS = tuple(m[:3] for m in dates.MONTHS)


def _year() -> Column:
    return dates.year_of(c("issued"))


def _part(i: int) -> Column:
    return F.get(dates.parts_of(c("issued")), F.lit(i))


def _family(n: Column) -> Column:
    particle = F.coalesce(n["non_dropping_particle"], F.lit(""))
    return F.when(particle == "", F.coalesce(n["family"], F.lit(""))).otherwise(F.concat_ws(" ", particle, n["family"]))


def _bibtex_name(n: Column) -> Column:
    """SNK1b."""
    given, suffix = F.coalesce(n["given"], F.lit("")), F.coalesce(n["suffix"], F.lit(""))
    plain = F.when(given == "", _family(n)).otherwise(F.concat(_family(n), F.lit(", "), given))
    return F.when(n["literal"].isNotNull(), F.concat(F.lit("{"), n["literal"], F.lit("}"))).when(suffix != "", F.concat(_family(n), F.lit(", "), suffix, F.lit(", "), given)).otherwise(plain)


def _ris_name(n: Column) -> Column:
    given, suffix = F.coalesce(n["given"], F.lit("")), F.coalesce(n["suffix"], F.lit(""))
    plain = F.when(given == "", _family(n)).otherwise(F.concat(_family(n), F.lit(", "), given))
    return F.when(n["literal"].isNotNull(), n["literal"]).when(suffix != "", F.concat(_family(n), F.lit(", "), given, F.lit(", "), suffix)).otherwise(plain)


def bibtex(abstract: bool = False, keywords: bool = True) -> Column:
    """SNK1: an entry of the record in this row."""
    field = lambda k, v: F.when(v.isNotNull(), F.concat(F.lit(f"  {k} = {{"), v, F.lit("}")))
    people = lambda k: F.when(F.size(k) > 0, F.array_join(F.transform(k, _bibtex_name), " and "))
    in_book = c("type").isin("chapter", "paper-conference")
    macro = F.get(F.array(*map(F.lit, MACROS)), _part(1) - 1)
    fields = [
        field("author", people("author")), field("editor", people("editor")), field("title", c("title")), field("booktitle", F.when(in_book, c("container_title"))), field("journal", F.when(~in_book, c("container_title"))),
        field("year", _year().cast("string")), F.when(_part(1).isNotNull(), F.concat(F.lit("  month = "), F.coalesce(macro, _part(1).cast("string")))), field("volume", c("volume")), field("number", c("issue")), field("pages", undash_pages(c("page"))),
        field("publisher", c("publisher")), field("address", c("publisher_place")), field("edition", c("edition")), field("doi", c("DOI")), field("isbn", c("ISBN")), field("issn", c("ISSN")), field("url", c("URL")),
        *([field("abstract", c("abstract"))] if abstract else []), *([field("keywords", c("keyword"))] if keywords else []), field("note", c("note")), field("series", c("collection_title")), field("language", c("language")),
    ]
    head = F.concat(F.lit("@"), lookup(schema.TO_BIBTEX, c("type"), "misc"), F.lit("{"), F.coalesce(c("citation_key"), c("id")), F.lit(",\n"))
    return F.concat(head, F.array_join(F.array_compact(F.array(*fields)), ",\n"), F.lit("\n}"))


def ris() -> Column:
    """SNK2: an entry of the record in this row."""
    line = lambda k, v: F.when(v.isNotNull(), F.array(F.concat(F.lit(f"{k}  - "), v))).otherwise(F.array().cast("array<string>"))
    many = lambda k, vs: F.transform(F.coalesce(vs, F.array().cast("array<string>")), lambda v: F.concat(F.lit(f"{k}  - "), v))
    in_book = c("type").isin("chapter", "paper-conference")
    two = lambda i: F.lpad(_part(i).cast("string"), 2, "0")
    dated = F.concat(_year().cast("string"), F.coalesce(F.concat(F.lit("/"), two(1), F.coalesce(F.concat(F.lit("/"), two(2)), F.lit(""))), F.lit("")))
    pages = F.regexp_replace("page", "[–—]", "-")
    ranged, at = pages.contains("-"), F.instr(pages, "-")
    words = F.filter(F.transform(F.split(c("keyword"), ","), lambda x: F.trim(x)), lambda w: w != "")
    lines = [
        line("TY", lookup(schema.TO_RIS, c("type"), "GEN")), many("AU", F.transform("author", _ris_name)), many("A2", F.transform("editor", _ris_name)), line("TI", c("title")), line("BT", F.when(in_book, c("container_title"))),
        line("JO", F.when(~in_book, c("container_title"))), line("T3", c("collection_title")), line("PY", dated), line("VL", c("volume")), line("IS", c("issue")),
        line("SP", F.when(ranged, F.trim(F.substring(pages, F.lit(1), at - 1))).otherwise(c("page"))), line("EP", F.when(ranged, F.trim(F.substring(pages, at + 1, F.length(pages))))), line("PB", c("publisher")), line("CY", c("publisher_place")),
        line("DO", c("DOI")), line("UR", c("URL")), line("SN", F.coalesce(c("ISBN"), c("ISSN"))), line("AB", c("abstract")), line("N1", c("note")), many("KW", words), line("LA", c("language")), line("ET", c("edition")), F.array(F.lit("ER  - ")),
    ]
    return F.array_join(F.flatten(F.array(*lines)), "\n")


def csv_row(delimiter: str = ",") -> Column:
    """SNK3: a line of sixteen columns."""
    value = [c("type"), c("title"), names.form_text(c("author")), _year().cast("string"), c("container_title"), c("volume"), c("issue"), c("page"), *map(c, ("DOI", "URL", "publisher", "ISBN", "ISSN", "abstract", "keyword", "language"))]
    return F.concat_ws(delimiter, *(escape_csv(F.coalesce(v, F.lit("")), delimiter) for v in value))


def word_source() -> Column:
    """SNK4: a b:Source element."""
    tag = lambda k, v, pad=4: F.when(v.isNotNull(), F.concat(F.lit(" " * pad + f"<b:{k}>"), escape_xml(v), F.lit(f"</b:{k}>\n"))).otherwise(F.lit(""))
    person = lambda n: F.concat(F.lit("          <b:Person>\n"), tag("Last", n["family"], 12), tag("First", n["given"], 12), tag("Last", n["literal"], 12), F.lit("          </b:Person>\n"))
    authors = F.concat(F.lit("    <b:Author>\n      <b:Author>\n        <b:NameList>\n"), F.array_join(F.transform("author", person), ""), F.lit("        </b:NameList>\n      </b:Author>\n    </b:Author>\n"))
    parts = [
        F.lit("  <b:Source>\n"), tag("Tag", c("id")), tag("SourceType", lookup(schema.TO_WORD, c("type"), "Misc")), tag("Title", c("title")), F.when(c("author").isNotNull(), authors).otherwise(F.lit("")), tag("Year", _year().cast("string")),
        tag("Month", _part(1).cast("string")), tag("Day", _part(2).cast("string")), tag("JournalName", c("container_title")), tag("Volume", c("volume")), tag("Pages", c("page")), tag("Publisher", c("publisher")), tag("DOI", c("DOI")),
        tag("URL", c("URL")), tag("StandardNumber", c("ISBN")), F.lit("  </b:Source>"),
    ]
    return F.concat(*parts)


WORD_HEAD = '<?xml version="1.0" encoding="UTF-8"?>\n<b:Sources xmlns:b="http://schemas.openxmlformats.org/officeDocument/2006/bibliography"\n           xmlns="http://schemas.openxmlformats.org/officeDocument/2006/bibliography"\n           SelectedStyle="">'


def yaml_item() -> Column:
    """SNK5: an item of the `references` list."""
    line = lambda k, v: F.when(v.isNotNull(), F.concat(F.lit(f'    {k}: "'), escape_yaml(v), F.lit('"\n'))).otherwise(F.lit(""))
    part = lambda k, v: F.when(v.isNotNull(), F.concat(F.lit(f'{k}: "'), escape_yaml(v), F.lit('"')))
    person = lambda n: F.when(n["literal"].isNotNull(), F.concat(F.lit("      - "), part("literal", n["literal"]), F.lit("\n"))).otherwise(F.concat(F.lit("      - {"), F.concat_ws(", ", part("family", n["family"]), part("given", n["given"])), F.lit("}\n")))
    authors = F.when(F.size("author") > 0, F.concat(F.lit("    author:\n"), F.array_join(F.transform("author", person), ""))).otherwise(F.lit(""))
    dated = F.array_join(F.transform(dates.parts_of(c("issued")), lambda p: p.cast("string")), "-")
    return F.concat(
        F.lit('  - id: "'), escape_yaml(c("id")), F.lit('"\n'), line("type", c("type")), line("title", c("title")), authors, line("issued", dated), line("container-title", c("container_title")), line("volume", c("volume")),
        line("issue", c("issue")), line("page", c("page")), line("DOI", c("DOI")), line("URL", c("URL")), line("publisher", c("publisher")), line("ISBN", c("ISBN")),
    )


def csl_json(df: DataFrame) -> Column:
    """SNK6: the record of this row as an object without nulls."""

    def hyphens(col: Column, kind) -> Column:
        from pyspark.sql import types as T

        if isinstance(kind, T.StructType):
            return F.when(col.isNotNull(), F.struct(*(hyphens(col[f.name], f.dataType).alias(schema.json_name(f.name)) for f in kind)))
        return F.transform(col, lambda x: hyphens(x, kind.elementType)) if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType) else col

    own = [f for f in df.schema if f.name in schema.FIELDS]
    return F.to_json(F.struct(*(hyphens(c(f.name), f.dataType).alias(schema.json_name(f.name)) for f in own)), {"ignoreNullFields": "true"})


def rendered(fmt: str, style: str = "apa") -> Column:
    """Bibliography entries as text, HTML or Markdown."""
    from quillspark.render import families

    html = families.bibliography(style)
    return html if fmt == "html" else F.regexp_replace(html, "</?i>", "*") if fmt == "markdown" else families.plain(html)


def entry(df: DataFrame, fmt: str, **options) -> Column:
    """SNK7: the text of one record in a format."""
    makers = {"bibtex": lambda: bibtex(**options), "ris": ris, "csv": lambda: csv_row(","), "tsv": lambda: csv_row("\t"), "word": word_source, "yaml": yaml_item, "csljson": lambda: csl_json(df)}
    return makers[fmt]() if fmt in makers else rendered(fmt, **options)


# What stands before the entries of a file, between them, and behind them.
WRAPS = {
    "csv": (",".join(CSV_COLUMNS), "", ""),
    "tsv": ("\t".join(CSV_COLUMNS), "", ""),
    "word": (WORD_HEAD, "", "</b:Sources>"),
    "yaml": ("---\nreferences:", "", "---"),
    "csljson": ("[", ",", "]"),
}


def _whole(batches: Iterator[pa.RecordBatch], head: str, tail: str) -> Iterator[pa.RecordBatch]:
    lines = lambda xs: pa.RecordBatch.from_arrays([pa.array(xs, pa.string())], names=["value"])
    yield lines([head])
    for batch in batches:
        yield lines(batch.column(0))
    yield lines([tail] if tail else [])


def export(df: DataFrame, fmt: str, path: str, **options) -> None:
    """Write the records into text files, in order of `_seq` where there is one. Each file is a whole of its format: it
    has the header line of CSV and TSV, the root element of Word XML, the list's head of YAML, the brackets of JSON."""
    full = conform(df)
    full = full.repartitionByRange("_seq").sortWithinPartitions("_seq") if "_seq" in df.columns else full
    head, between, tail = WRAPS.get(fmt, ("", "", ""))
    text = entry(full, fmt, **options)
    if between:  # the low 33 bits number the rows of a partition
        first = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) == 0
        text = F.when(first, text).otherwise(F.concat(F.lit(between), text))
    lines = full.select(text.alias("value"))
    if head:
        lines = lines.mapInArrow(lambda batches: _whole(batches, head, tail), "value string")
    lines.write.mode("overwrite").text(path, lineSep="\n\n" if fmt == "bibtex" else "\n")
