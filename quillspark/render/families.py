"""Six families of styles as Column expressions (FMT1 to FMT5): no Python runs on the executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions import dates
from quillspark.functions.text import dash_digits, escape_xml, initials_plain, unescape_html

NAMES = ("apa", "mla", "chicago", "harvard", "ieee", "vancouver")
NO_DATE = "n.d."


def _text(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def year() -> Column:
    y = dates.year_of(F.col("issued"))
    return F.coalesce(F.nullif(y, F.lit(0)).cast("string"), F.lit(NO_DATE))


def one_author(n: Column, family: str) -> Column:
    last, given = F.coalesce(n["family"], F.lit("")), F.coalesce(n["given"], F.lit(""))
    if family in ("mla", "chicago"):
        shown = F.regexp_replace(F.trim(F.concat(last, F.lit(", "), given)), ",$", "")
    elif family in ("ieee", "vancouver"):
        shown = F.trim(F.concat(initials_plain(given), F.lit(" "), last))
    else:
        shown = F.trim(F.concat(last, F.lit(", "), initials_plain(given)))
    return F.when(F.coalesce(n["literal"], F.lit("")) != "", n["literal"]).otherwise(shown)


def authors(family: str, people: str = "author") -> Column:
    """FMT3: the list of authors; empty where there are none."""
    shown = F.transform(people, lambda n: one_author(n, family))
    n = F.size(shown)
    first = F.get(shown, F.lit(0))
    two = {"apa": " & ", "mla": ", and "}.get(family, " and ")
    out = F.when(F.col(people).isNull() | (n == 0), F.lit("")).when(n == 1, first).when(n == 2, F.array_join(shown, two))
    if family == "mla":
        return out.otherwise(F.concat(first, F.lit(", et al.")))
    if family == "vancouver":
        out = out.when(n > 6, F.concat(F.array_join(F.slice(shown, 1, 6), ", "), F.lit(", et al.")))
    return out.otherwise(F.concat(F.array_join(F.slice(shown, 1, F.greatest(n - 1, F.lit(0))), ", "), F.lit(", & "), F.element_at(F.concat(F.array(F.lit("")), shown), -1)))


def _join(separator: str, *parts: Column) -> Column:
    return F.array_join(F.filter(F.array(*parts), lambda p: p.isNotNull() & (p != "")), separator)


def _if(value: Column, *shown: Column | str) -> Column:
    """The given texts end to end if value is not empty, else an empty text."""
    return F.when(value != "", F.concat(*(F.lit(s) if isinstance(s, str) else s for s in shown))).otherwise(F.lit(""))


def _journal() -> Column:
    return F.col("type").isin("article-journal", "article", "article-magazine")


def bibliography(family: str) -> Column:
    """FMT1: a bibliography entry as HTML, of the record in this row."""
    a = escape_xml(authors(family))
    y, kind = year(), F.col("type")
    title = escape_xml(F.coalesce(F.nullif(F.col("title"), F.lit("")), F.lit("Untitled")))
    container, vol, iss, pub = (escape_xml(_text(k)) for k in ("container_title", "volume", "issue", "publisher"))
    pages, url, raw = escape_xml(dash_digits(_text("page"))), escape_xml(_text("URL")), _text("DOI")
    doi = _if(raw, "https://doi.org/", escape_xml(raw))
    link = F.when(doi != "", doi).otherwise(url)
    italic = lambda x: F.concat(F.lit("<i>"), x, F.lit("</i>"))
    dots = lambda x: F.replace(x, F.lit(".."), F.lit("."))
    dated = F.when(y == NO_DATE, F.lit("")).otherwise(y)
    unless_journal = F.when(_journal(), F.lit("")).otherwise(pub)
    if family == "apa":
        named = F.when(kind.isin("book", "report", "thesis"), italic(title)).otherwise(title)
        source = _if(container, italic(container), _if(vol, ", ", italic(vol)), _if(iss, "(", iss, ")"), _if(pages, ", ", pages))
        body = _join(". ", F.when(a != "", a).otherwise(title), F.concat(F.lit("("), y, F.lit(")")), F.when(a != "", named).otherwise(F.lit("")), source, unless_journal, link)
        return F.concat(F.replace(dots(body), F.lit(". ."), F.lit(".")), F.lit("."))
    someone = F.when(a != "", a).otherwise(F.lit("Unknown"))
    if family == "mla":
        named = F.when(kind == "book", italic(title)).otherwise(F.concat(F.lit("“"), title, F.lit(".”")))
        place = _join(", ", _if(vol, "vol. ", vol), _if(iss, "no. ", iss))
        body = _join(", ", someone, named, _if(container, italic(container)), place, unless_journal, dated, _if(pages, "pp. ", pages), link)
        return F.concat(F.replace(body, F.lit(",."), F.lit(".")), F.lit("."))
    if family == "chicago":
        named = F.when(kind.isin("book", "thesis"), italic(title)).otherwise(F.concat(F.lit("“"), title, F.lit("”")))
        source = _if(container, italic(container), _if(vol, " ", vol), _if(iss, ", no. ", iss), _if(pages, ": ", pages))
        place = escape_xml(_text("publisher_place"))
        return F.concat(dots(_join(". ", someone, y, named, source, _if(pub, _if(place, place, ": "), pub), link)), F.lit("."))
    if family == "harvard":
        named = F.when(kind.isin("book", "thesis"), italic(title)).otherwise(F.concat(F.lit("‘"), title, F.lit("’")))
        source = _if(container, italic(container), _if(vol, ", ", vol), _if(iss, "(", iss, ")"), _if(pages, ", pp. ", pages))
        end = F.when(raw != "", F.concat(F.lit("doi:"), raw)).otherwise(_if(url, "Available at: ", url))
        return F.concat(dots(_join(". ", someone, F.concat(F.lit("("), y, F.lit(")")), named, source, pub, end)), F.lit("."))
    bare = authors(family)
    if family == "ieee":
        body = _join(", ", bare, F.concat(F.lit("“"), title, F.lit(",”")), _if(container, italic(container)), _if(vol, "vol. ", vol), _if(iss, "no. ", iss), _if(pages, "pp. ", pages), dated, _if(raw, "doi: ", raw))
        return F.concat(F.lit("[1] "), body, F.lit("."))
    source = F.when(container != "", F.concat(container, F.lit(". "), y, _if(vol, ";", vol), _if(iss, "(", iss, ")"), _if(pages, ":", pages), F.lit("."))).otherwise(_if(dated, dated, "."))
    return F.concat(F.lit("1. "), _join(" ", F.concat(bare, F.lit(".")), F.concat(title, F.lit(".")), source, _if(raw, "doi: ", raw)))


def plain(html: Column) -> Column:
    """FMT2."""
    return unescape_html(html)


def both(rendered: Column, rendered_in_text: Column, family: str, html: bool = False, narrative: bool = False) -> Column:
    """FMT5: entry and citation by a style's own renderer where it gave any, else by family; narrative always by family."""
    own = rendered if html else plain(rendered)
    by_family = bibliography(family) if html else plain(bibliography(family))
    cited = in_text(family, True) if narrative else F.coalesce(F.nullif(rendered_in_text, F.lit("")), in_text(family))
    return F.struct(F.coalesce(F.nullif(own, F.lit("")), by_family).alias("bib"), cited.alias("intext"))


def in_text(family: str, narrative: bool = False) -> Column:
    """FMT4: a citation in the text."""
    if family in ("ieee", "vancouver"):
        return F.lit("[1]")
    n = F.coalesce(F.size("author"), F.lit(0))
    n = F.when(F.col("author").isNull(), F.lit(0)).otherwise(n)
    first, second = F.get("author", F.lit(0)), F.coalesce(F.get("author", F.lit(1))["family"], F.lit(""))
    words = F.array_join(F.slice(F.split(F.col("title"), " "), 1, 3), " ")
    who = F.coalesce(F.nullif(first["family"], F.lit("")), F.nullif(first["literal"], F.lit("")), F.nullif(words, F.lit("")), F.lit("Unknown"))
    page, y = _text("page"), year()
    pair = " and " if family == "mla" else " & "
    shown = F.when(n >= 3, F.concat(who, F.lit(" et al."))).when(n == 2, F.concat(who, F.lit(pair), second)).otherwise(who)
    if family == "mla":
        return shown if narrative else F.concat(F.lit("("), shown, F.lit(" "), page, F.lit(")"))
    return F.concat(shown, F.lit(" ("), y, F.lit(")")) if narrative else F.concat(F.lit("("), shown, F.lit(", "), y, F.lit(")"))
