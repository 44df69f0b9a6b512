"""User templates (FMT6, FMT7) as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions.text import initials_plain
from quillspark.render.families import _text, year


def template_authors(order: str = "last-first", connector: str = "&", et_al: int = 3, short: bool = True) -> Column:
    def one(n: Column) -> Column:
        last, given = F.coalesce(n["family"], F.lit("")), F.coalesce(n["given"], F.lit(""))
        given = initials_plain(given) if short else given
        shown = F.concat(last, F.lit(", "), given) if order == "last-first" else F.concat(given, F.lit(" "), last)
        return F.when(F.coalesce(n["literal"], F.lit("")) != "", n["literal"]).otherwise(F.trim(shown))

    shown = F.transform("author", one)
    n, first = F.size(shown), F.get(shown, F.lit(0))
    last = F.element_at(F.concat(F.array(F.lit("")), shown), -1)
    many = F.concat(F.array_join(F.slice(shown, 1, F.greatest(n - 1, F.lit(0))), ", "), F.lit(f", {connector} "), last)
    return F.when(F.col("author").isNull() | (n == 0), F.lit("")).when(n >= et_al, F.concat(first, F.lit(" et al."))).when(n == 1, first).when(n == 2, F.array_join(shown, f" {connector} ")).otherwise(many)


def replace_first(c: Column, mark: str, value: Column) -> Column:
    """The first occurrence only, literally. The text is read once, so that a chain of marks stays linear."""
    literal = F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$"))
    return F.regexp_replace(c, F.lit(rf"(?s)^(.*?)\Q{mark}\E"), F.concat(F.lit("$1"), literal))


def render(template: Column | str, **options) -> Column:
    """Placeholders (each once), `*x*` as italics, and what empty fields leave behind removed."""
    out = F.lit(template) if isinstance(template, str) else template
    first, doi = F.get("author", F.lit(0)), _text("DOI")
    values = {
        "author": template_authors(**options), "author-short": F.coalesce(F.nullif(first["family"], F.lit("")), first["literal"], F.lit("")), "year": year(), "title": _text("title"), "container": _text("container_title"),
        "volume": _text("volume"), "issue": _text("issue"), "page": _text("page"), "doi": F.when(doi != "", F.concat(F.lit("https://doi.org/"), doi)).otherwise(F.lit("")), "url": _text("URL"), "publisher": _text("publisher"),
    }
    for k, v in values.items():
        out = replace_first(out, f"{{{k}}}", v)
    out = F.regexp_replace(out, r"\*([^*]+)\*", "<i>$1</i>")
    for a, b in (("()", ""), (", ,", ","), ("..", ".")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.regexp_replace(out, r",\s*\.", ".")
