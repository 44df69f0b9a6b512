"""Scalar text functions as Column expressions (STR, NUM of the inventory); none leaves the JVM."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as browsers and Rust see it; Java's \s is ASCII.
WS = r"[\s   -     　﻿]"


def blank_to_null(c: Column) -> Column:
    """Empty and white-space texts count as missing (rule 1.5)."""
    return F.nullif(F.trim(c), F.lit(""))


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that many parts of f read: it is bound, so that each row computes it once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def lookup(table: dict[str, str], key: Column, other: str | None = None) -> Column:
    """Value of a fixed table by key."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    found = F.try_element_at(F.create_map(*pairs), key)
    return found if other is None else F.coalesce(found, F.lit(other))


def title_key(c: Column) -> Column:
    """STR11: lower case, letters and digits only."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def title_words(c: Column) -> Column:
    """The distinct words of a title, without punctuation."""
    return F.array_distinct(F.split(F.regexp_replace(F.lower(c), r"[^\w\s]", ""), r"\s+"))


def title_similarity(a: Column, b: Column) -> Column:
    """STR12: shared words over the larger set of words."""
    words = title_words
    return F.size(F.array_intersect(words(a), words(b))) / F.greatest(F.size(words(a)), F.size(words(b)))


# Words that a title keeps in lower case.
STOP_WORDS = (
    "a", "an", "and", "as", "at", "but", "by", "for", "from", "in", "nor", "of", "on", "or", "the", "to", "up", "with",
)


def upper_first(w: Column) -> Column:
    return F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w)))


def title_case(c: Column) -> Column:
    """STR13: capitals but for stop words; the first word always."""
    words = F.filter(F.split(c, r"\s+"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w, i: F.when((i > 0) & F.lower(w).isin(*STOP_WORDS), F.lower(w)).otherwise(upper_first(w))), " ")


def text_case(c: Column, mode: str) -> Column:
    """STR14."""
    if mode in ("lowercase", "uppercase"):
        return F.lower(c) if mode == "lowercase" else F.upper(c)
    if mode == "capitalize-first":
        return upper_first(c)
    if mode == "capitalize-all":
        return F.array_join(F.transform(F.filter(F.split(c, r"\s+"), lambda w: w != ""), upper_first), " ")
    if mode == "sentence":
        return upper_first(F.lower(c))
    return title_case(c) if mode == "title" else c


def initials(given: Column) -> Column:
    """STR15: `John Andrew` to `J. A.`, `Jean-Paul` to `J.-P.`."""
    parts = F.filter(F.split(given, r"[\s.]+"), lambda w: w != "")
    one = lambda w: F.array_join(F.transform(F.filter(F.split(w, "-"), lambda p: p != ""), lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lit("."))), "-")
    return F.array_join(F.transform(parts, one), " ")


def initials_plain(given: Column) -> Column:
    """STR16: split at spaces and periods only, case as it is."""
    return F.array_join(F.transform(F.filter(F.split(given, r"[\s.]"), lambda w: w != ""), lambda w: F.concat(F.substring(w, 1, 1), F.lit("."))), " ")


# Roman numerals.
ROMAN = ((1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i"))


def roman(n: Column) -> Column:
    """STR17: positive integers in lower-case Roman numerals."""
    left, parts = n.cast("long"), []
    for value, sign in ROMAN:
        parts.append(F.repeat(F.lit(sign), F.floor(left / value).cast("int")))
        left = left % value
    return F.when(n > 0, F.concat(*parts)).otherwise(n.cast("string"))


def ordinal(n: Column) -> Column:
    """NUM1: every suffix is `th`."""
    return F.concat(n.cast("string"), F.lit("th"))


def is_plural(variable: str, value: Column) -> Column:
    """NUM2: several pages or numbers, or a count above one."""
    if variable.startswith("number_of_"):
        return F.coalesce(F.try_to_number(value, F.lit("999999999")) > 1, F.lit(False))
    return F.coalesce(value.rlike(r"[-–—,&]"), F.lit(False))


def join_parts(parts: Column, delimiter: str) -> Column:
    """STR18: join non-empty parts; a delimiter that begins with the sign before it loses that sign."""
    first = delimiter[:1]

    def step(acc: Column, x: Column) -> Column:
        glue = F.when(F.lit(first).isin(*".,:;!?") & (F.right(acc, F.lit(1)) == first), F.lit(delimiter[1:])).otherwise(F.lit(delimiter))
        return F.when(acc == "", x).otherwise(F.concat(acc, glue, x))

    return F.aggregate(F.filter(parts, lambda x: x.isNotNull() & (x != "")), F.lit(""), step)


def affix(c: Column, prefix: str = "", suffix: str = "") -> Column:
    """STR19: prefix and suffix of a non-empty text, with the sign at the seam once."""
    tail = F.when(F.lit(suffix[:1]).isin(*".,:;!?") & (F.right(c, F.lit(1)) == suffix[:1]), F.lit(suffix[1:])).otherwise(F.lit(suffix)) if suffix else F.lit("")
    return F.when(c.isNull() | (c == ""), c).otherwise(F.concat(F.lit(prefix), c, tail))


def escape_xml(c: Column) -> Column:
    """STR20: the four signs that XML and HTML escape."""
    return reduce(lambda x, kv: F.replace(x, F.lit(kv[0]), F.lit(kv[1])), (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")), c)


def unescape_html(c: Column) -> Column:
    """FMT2: the text of simple HTML: tags removed, entities decoded."""
    plain = F.regexp_replace(c, r"<[^>]*>", "")
    return reduce(lambda x, kv: F.replace(x, F.lit(kv[0]), F.lit(kv[1])), (("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")), plain)


def escape_yaml(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))


def escape_csv(c: Column, delimiter: str) -> Column:
    quoted = F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(c.contains(delimiter) | c.contains('"') | c.contains("\n"), quoted).otherwise(c)


def dash_pages(c: Column) -> Column:
    """STR21: hyphens of page ranges become en dashes."""
    return F.replace(F.replace(c, F.lit("--"), F.lit("–")), F.lit("-"), F.lit("–"))


def dash_digits(c: Column) -> Column:
    return F.regexp_replace(c, r"(\d)-(\d)", "$1–$2")


def undash_pages(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("–"), F.lit("--")), F.lit("—"), F.lit("---"))


# TeX sequences and what they stand for, in the order of replacement.
LATEX = (
    (r"\'{a}", "á"), (r"\'{e}", "é"), (r"\'{i}", "í"), (r"\'{o}", "ó"), (r"\'{u}", "ú"), (r"\`{a}", "à"), (r"\`{e}", "è"), (r"\`{o}", "ò"), (r"\^{a}", "â"), (r"\^{e}", "ê"), (r"\^{o}", "ô"),
    (r"\"{a}", "ä"), (r"\"{o}", "ö"), (r"\"{u}", "ü"), (r"\~{n}", "ñ"), (r"\c{c}", "ç"), (r"\ss", "ß"), (r"\'a", "á"), (r"\'e", "é"), (r"\'i", "í"), (r"\'o", "ó"), (r"\'u", "ú"), (r"\`a", "à"),
    (r"\`e", "è"), (r"\`o", "ò"), (r"\&", "&"), (r"\%", "%"), (r"\_", "_"), (r"\textendash", "–"), (r"\textemdash", "—"), ("--", "–"), ("---", "—"), (r"\textit", ""), (r"\textbf", ""), (r"\emph", ""), (r"\url", ""), ("~", " "),
)


def clean_latex(c: Column) -> Column:
    """STR1."""
    return reduce(lambda x, kv: F.replace(x, F.lit(kv[0]), F.lit(kv[1])), LATEX, c)


def strip_braces(c: Column) -> Column:
    """STR2."""
    return F.trim(F.regexp_replace(F.trim(c), "[{}]", ""))


def squeeze(c: Column) -> Column:
    """STR23: plain spaces and hyphens, words that a line break divides rejoined, blank lines squeezed."""
    c = F.regexp_replace(F.replace(c, F.lit(" "), F.lit(" ")), "[‐‑‒–—―]", "-")
    c = F.regexp_replace(F.replace(c, F.lit("\r\n"), F.lit("\n")), r"([A-Za-z])-\n([a-z])", "$1$2")
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"[ \t]+", " "), r"\n{3,}", "\n\n"))


def any_label(labels: tuple[str, ...]) -> str:
    """Pattern of a line that holds one of the labels with a value behind it."""
    any_ = "|".join(rf"\Q{x}\E" for x in labels)
    return rf"(?im)^((?:(?:{any_})[ \t]*[:\-]|.*\b(?:{any_})\b(?:[ \t]*[:\-]|[ \t]))[ \t]*\S.*)$"


def label_patterns(label: str) -> tuple[str, ...]:
    """Patterns of the value of a label within a line, strongest first: at its head, anywhere, without a sign between."""
    return (rf"(?i)^\Q{label}\E\s*[:\-]\s*(.+)$", rf"(?i)\b\Q{label}\E\b\s*[:\-]\s*(.+)$", rf"(?i)\b\Q{label}\E\b\s+(.+)$")


def value_at(c: Column, line: Column, patterns: Column) -> Column:
    """The first value that the patterns find in the first line that matches `line`."""
    found = lambda own: F.transform(patterns, lambda p: blank_to_null(F.trim(F.call_function("regexp_extract", own, p, F.lit(1)))))
    return once(F.call_function("regexp_extract", c, line, F.lit(1)), lambda own: F.when(own != "", F.get(F.array_compact(found(own)), F.lit(0))))


def labelled(c: Column, *labels: str) -> Column:
    """STR24: the value of a label on the first line that holds one; of several labels on it the first named counts."""
    return value_at(c, F.lit(any_label(labels)), F.array(*(F.lit(p) for x in labels for p in label_patterns(x))))


def term(terms: Column, name: Column, form: str = "long", plural: bool = False) -> Column:
    """STR27: a locale's term from a map of `name/form` to (value, plural); the long form where the own one is missing."""
    own = F.coalesce(F.try_element_at(terms, F.concat_ws("/", name, F.lit(form))), F.try_element_at(terms, F.concat_ws("/", name, F.lit("long"))))
    return F.coalesce(own["plural"], own["value"]) if plural else own["value"]


def strip_site(title: Column, site: Column) -> Column:
    """STR25: drop a trailing site name behind a bar, dash or colon."""
    tail = F.concat(F.lit(r"\s*[|\-–—:]\s*\Q"), F.replace(site, F.lit("\\E"), F.lit("")), F.lit(r"\E\s*$"))
    return F.when(blank_to_null(site).isNull(), title).otherwise(F.regexp_replace(title, tail, F.lit("")))


# Parts of style ids that decide the family, in order.
FAMILIES = (
    ("apa", ("apa",)), ("mla", ("mla", "modern-language")), ("chicago", ("chicago", "turabian")), ("harvard", ("harvard", "cite-them-right")), ("ieee", ("ieee",)),
    ("vancouver", ("vancouver", "ama", "medical", "nlm", "lancet", "bmj", "nejm", "nature", "science", "cell", "annual-review", "frontiers", "copernicus", "liebert", "acm", "springer-basic-brackets", "springer-lncs", "iso690-numeric", "cambridge-university-press-numeric", "din-1505", "gost", "sist02")),
)


def style_family(style: Column) -> Column:
    """STR26: one of six families by parts of the id; else apa."""
    s = F.lower(F.coalesce(style, F.lit("")))
    out = F.when(F.lit(False), F.lit("apa"))
    for family, parts in FAMILIES:
        out = out.when(reduce(lambda a, b: a | b, (s.contains(p) for p in parts)), family)
    return out.otherwise("apa")


def recent(items: Column, new: Column, n: int = 8) -> Column:
    """SRT5: move to the front of a list of n."""
    return F.slice(F.array_distinct(F.concat(F.array(new), items)), 1, n)


def places_of_words(words: Column) -> Column:
    """Inverse of PRJ9: a map from the words of an array to their places. Words are sorted with their places, so that those
    of one word are a slice."""

    def made(each: Column) -> Column:
        first = F.filter(F.transform(each, lambda x, i: F.struct(x["w"], i.alias("i"))), lambda x: (x["i"] == 0) | (F.get(each, x["i"] - 1)["w"] != x["w"]))
        own = lambda f: F.transform(f, lambda x, k: F.struct(x["w"], F.transform(F.slice(each, x["i"] + 1, F.coalesce(F.get(f, k + 1)["i"], F.size(each)) - x["i"]), lambda y: y["p"])))
        return once(first, lambda f: F.map_from_entries(own(f)))

    return once(F.sort_array(F.transform(words, lambda w, p: F.struct(w.alias("w"), p.alias("p")))), made)


def inverted_abstract(index: Column) -> Column:
    """PRJ9: the text behind a map from words to their places."""
    pairs = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.array_join(F.transform(F.sort_array(pairs), lambda x: x["w"]), " ")


def pdf_string(c: Column) -> Column:
    """STR22: a literal PDF string `(..)` with escapes, or a hex string `<..>`, UTF-16 if it begins with FEFF."""
    digits = F.regexp_replace(c, r"[<>\s]", "")
    wide = F.decode(F.unhex(F.substring(digits, F.lit(5), F.length(digits))), "UTF-16BE")
    narrow = F.decode(F.unhex(digits), "ISO-8859-1")
    inner = F.regexp_replace(F.regexp_replace(c, r"^\(|\)$", ""), r"\\([()\\])", "$1")
    return F.when(c.startswith("<"), F.when(F.upper(digits).startswith("FEFF"), wide).otherwise(narrow)).otherwise(inner)
