"""Name lists as Column expressions: the seven grammars that sources use (NAM1 to NAM7) and their inverse."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions.text import WS, blank_to_null
from quillspark.schema import NAME

_trim = lambda c: F.regexp_replace(c, f"^{WS}+|{WS}+$", "")


def name(family: Column | None = None, given: Column | None = None, suffix: Column | None = None, literal: Column | None = None, particle: Column | None = None) -> Column:
    own = {"family": family, "given": given, "suffix": suffix, "literal": literal, "non_dropping_particle": particle}
    null = lambda f: F.lit(None).cast(f.dataType)
    return F.struct(*(null(f).alias(f.name) if own.get(f.name) is None else own[f.name].alias(f.name) for f in NAME))


def _words(c: Column) -> Column:
    return F.filter(F.split(c, f"{WS}+"), lambda w: w != "")


def _last_word_family(c: Column) -> Column:
    w = _words(c)
    return F.when(F.size(w) <= 1, name(literal=F.element_at(F.concat(w, F.array(F.lit(""))), 1))).otherwise(name(F.element_at(w, -1), F.array_join(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), " ")))


def _comma(c: Column) -> Column:
    """The fields between commas, trimmed."""
    return F.transform(F.split(c, ",", -1), _trim)


def bibtex_name(c: Column) -> Column:
    """NAM1: `Last, First`, `Last, Suffix, First`; else words in lower case before the family are its particle. A
    name in braces is literal."""
    s = _trim(c)
    p = _comma(F.regexp_replace(s, "[{}]", ""))
    rest = F.array_join(F.slice(p, 3, 100), ", ")
    w = _words(F.regexp_replace(s, "[{}]", ""))
    low = F.transform(w, lambda x: F.substring(x, 1, 1).rlike(r"^\p{Ll}"))
    n = F.size(w)
    first_low = F.array_position(F.slice(low, 2, F.greatest(n - 2, F.lit(0))), True).cast("int")  # among the words between
    family = n
    given_end = F.when(first_low > 0, first_low).otherwise(n - 1)
    particle = F.when(first_low > 0, F.array_join(F.filter(F.slice(w, first_low + 1, F.greatest(n - 1 - first_low, F.lit(0))), lambda x: F.substring(x, 1, 1).rlike(r"^\p{Ll}")), " "))
    plain = name(F.element_at(w, F.greatest(family, F.lit(1))), blank_to_null(F.array_join(F.slice(w, 1, F.greatest(given_end, F.lit(0))), " ")), particle=particle)
    return (
        F.when(s.rlike(r"^\{.*\}$"), name(literal=F.regexp_replace(s, "[{}]", "")))
        .when(F.size(p) >= 3, name(p[0], rest, p[1]))
        .when(F.size(p) == 2, name(p[0], blank_to_null(p[1])))
        .when(n <= 1, name(literal=F.array_join(w, " ")))
        .otherwise(plain)
    )


def bibtex_names(c: Column) -> Column:
    """Names joined by ` and `; a brace pair around a name is kept apart from the pair around the list."""
    return F.filter(F.transform(F.split(c, rf"{WS}+and{WS}+"), bibtex_name), lambda n: n["family"].isNotNull() | n["given"].isNotNull() | (F.coalesce(n["literal"], F.lit("")) != ""))


def ris_name(c: Column) -> Column:
    """NAM2: `Last, First, Suffix`; without a comma literal."""
    p = _comma(c)
    rest = blank_to_null(F.array_join(F.slice(p, 3, 100), ", "))
    return F.when(F.size(p) >= 2, name(p[0], blank_to_null(p[1]), rest)).otherwise(name(literal=_trim(c)))


def plain_name(c: Column) -> Column:
    """A name as services tell it: the last word is the family; one word is literal."""
    return _last_word_family(_trim(c))


def endnote_name(c: Column) -> Column:
    """NAM3: split at the first comma; else the last word is the family."""
    at = F.instr(c, ",")
    return F.when(at > 0, name(_trim(F.substring(c, F.lit(1), at - 1)), blank_to_null(_trim(F.substring(c, at + 1, F.length(c)))))).otherwise(_last_word_family(_trim(c)))


def medline_name(c: Column) -> Column:
    """NAM4: first word family, the letters of the rest dotted initials."""
    w = _words(c)
    letters = F.filter(F.split(F.array_join(F.slice(w, F.lit(2), F.size(w)), ""), ""), lambda x: x != "")
    dotted = F.array_join(F.transform(letters, lambda x: F.concat(x, F.lit("."))), " ")
    return F.when(F.size(w) <= 1, name(literal=_trim(c))).otherwise(name(w[0], dotted))


def csv_names(c: Column) -> Column:
    """NAM5: separated by `;`, `&` or ` and `."""
    parts = F.filter(F.transform(F.split(c, r"[;&]|\sand\s"), _trim), lambda x: x != "")
    return F.transform(parts, endnote_name)


def byline_name(c: Column) -> Column:
    """NAM6: without `by` and role remarks; of fields between commas the first two count."""
    roles = r"(?i)\s*\((?:Author|Editor|Contributor|Translator|Illustrator|Narrator|Creator|Compiler|eds?\.?)\)\s*"
    s = _trim(F.regexp_replace(F.regexp_replace(_trim(c), r"(?i)^by\s+", ""), roles, ""))
    p = _comma(s)
    return F.when(F.size(p) >= 2, name(p[0], p[1])).otherwise(_last_word_family(s))


def form_names(c: Column, separator: str = ";") -> Column:
    """NAM7: separated by `;` (PDF: also ` and `)."""
    parts = F.filter(F.transform(F.split(c, separator), _trim), lambda x: x != "")
    return F.transform(parts, lambda s: F.when(s.contains(","), name(_comma(s)[0], F.get(_comma(s), F.lit(1)))).otherwise(_last_word_family(s)))


def display(n: Column) -> Column:
    """`Last, First`, or the literal, or the one part that there is."""
    both = F.concat_ws(", ", blank_to_null(n["family"]), blank_to_null(n["given"]))
    return F.coalesce(n["literal"], both)


def form_text(names: Column) -> Column:
    """Inverse of NAM7: `Last, First; Last, First`."""
    return F.array_join(F.transform(names, display), "; ")
