"""Partial dates as Column expressions (DT of the inventory). A date keeps the parts that its source gives."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions.identifiers import first_match
from quillspark.functions.text import lookup, once
from quillspark.schema import DATE

# Months.
MONTHS = (
    "january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november",
    "december",
)
MONTH_NUMBERS = {**{m[:3]: str(i) for i, m in enumerate(MONTHS, 1)}, **{str(i): str(i) for i in range(1, 13)}, **{f"0{i}": str(i) for i in range(1, 10)}}


def date(parts: Column | None = None, literal: Column | None = None) -> Column:
    """A date of its parts (array of integers; empty: null date unless there is a literal)."""
    fields = {"date_parts": None if parts is None else once(parts, lambda p: F.when(F.size(p) > 0, F.array(p))), "literal": literal}
    null = lambda f: F.lit(None).cast(f.dataType)
    made = F.struct(*(null(f).alias(f.name) if fields.get(f.name) is None else fields[f.name].cast(f.dataType).alias(f.name) for f in DATE))
    return once(made, lambda m: F.when(m["date_parts"].isNotNull() | m["literal"].isNotNull(), m))


def parts_of(d: Column) -> Column:
    return F.get(d["date_parts"], F.lit(0))


def year_of(d: Column) -> Column:
    return F.get(parts_of(d), F.lit(0))


def month_number(c: Column) -> Column:
    """DT2: number of a month by its first three letters or its digits."""
    s = F.regexp_replace(F.lower(c), "^[^a-z0-9]+|[^a-z0-9]+$", "")
    return lookup(MONTH_NUMBERS, F.substring(s, 1, 3)).cast("int")


def leading(*parts: Column) -> Column:
    """Parts up to the first that is missing."""

    def cut(arr: Column) -> Column:
        n = F.array_position(F.transform(arr, lambda x: x.isNull()), True).cast("int")
        return F.when(n == 0, arr).otherwise(F.slice(arr, 1, F.greatest(n - 1, F.lit(0))))

    return once(F.array(*parts), cut)


def integers(c: Column, separator: str) -> Column:
    return F.filter(F.transform(F.split(c, separator), lambda p: F.trim(p).try_cast("int")), lambda x: x.isNotNull())


def bibtex_date(year: Column, month: Column, day: Column, iso: Column) -> Column:
    """DT1: year (unreadable: 0), month, day; without a year the parts of an ISO date."""
    y = F.coalesce(F.trim(year).try_cast("int"), F.lit(0))
    return F.when(year.isNotNull(), date(leading(y, month_number(month), F.trim(day).try_cast("int")))).otherwise(date(integers(iso, "-")))


def slash_date(c: Column) -> Column:
    """DT3: `Y/M/D/`."""
    p = F.split(c, "/")
    return date(leading(*(F.trim(F.get(p, F.lit(i))).try_cast("int") for i in range(3))))


def medline_date(c: Column) -> Column:
    """`2024 Mar 15`, `2024 Mar`, `2024`."""
    w = F.split(F.trim(c), r"\s+")
    return date(leading(F.get(w, F.lit(0)).try_cast("int"), month_number(F.get(w, F.lit(1))), F.get(w, F.lit(2)).try_cast("int")))


_FULL, _SHORT = f"(?i)({'|'.join(MONTHS)})", f"(?i)({'|'.join(m[:3] for m in MONTHS)})"
#: Formats that general date texts are tried in, and what a text must hold for each: one that cannot be read costs much.
FORMATS = {
    "MMMM d, yyyy": f"{_FULL} [^,]*, ", "MMM d, yyyy": f"{_SHORT} [^,]*, ", "d MMMM yyyy": f"[0-9] {_FULL} ", "d MMM yyyy": f"[0-9] {_SHORT} ",
    "MMMM yyyy": f"^{_FULL} [^,]*$", "MMM yyyy": f"^{_SHORT} [^,]*$", "M/d/yyyy": "/.*/",
}


def page_date(c: Column) -> Column:
    """DT4, DT10: an ISO prefix of one to three parts, else one of FORMATS, else literal."""
    part = lambda s, i: first_match(s, r"^(\d{4})(?:-(\d{1,2})(?:-(\d{1,2}))?)?", i).cast("int")

    def worded(s: Column) -> Column:
        day = F.regexp_replace(s, r"^[A-Za-z]{3,9},\s+|\s+\d{1,2}:\d{2}.*$", "")  # without weekday and time: no pattern reads a weekday
        return once(day, lambda day: F.coalesce(*(F.when(day.rlike(holds), F.try_to_timestamp(day, F.lit(f))) for f, holds in FORMATS.items())))

    def parts(s: Column) -> Column:
        iso = leading(*(part(s, i) for i in (1, 2, 3)))
        return F.when(s.rlike(r"^\d{4}"), iso).otherwise(once(worded(s), lambda t: F.when(t.isNotNull(), F.array(F.year(t), F.month(t), F.day(t)))))

    whole = lambda s: once(parts(s), lambda p: F.when(p.isNotNull(), date(p)).otherwise(date(literal=s)))
    return once(F.trim(c), whole)


# Dates in the front matter of a paper, in the order they are tried.
FRONT = (
    r"(?i)(\d{1,2}\s+(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\.?\s+\d{4})",
    r"(?i)((?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\.?\s+\d{1,2},?\s+\d{4})",
    r"(\d{4}-\d{2}-\d{2})",
)


def front_date(c: Column) -> Column:
    """DT10: the first of three kinds of date in a text that is a day of the calendar; null if none is."""
    def made(found: Column) -> Column:
        number = F.lpad(month_number(F.regexp_extract(found, r"([A-Za-z]+)", 1)).cast("string"), 2, "0")
        day = F.lpad(F.regexp_extract(found, r"^\D*(\d{1,2})\b", 1), 2, "0")
        return F.try_to_timestamp(F.concat_ws("-", F.regexp_extract(found, r"(\d{4})$", 1), number, day), F.lit("yyyy-MM-dd"))

    iso = F.try_to_timestamp(first_match(c, FRONT[2]), F.lit("yyyy-MM-dd"))
    t = F.coalesce(once(first_match(c, FRONT[0]), made), once(first_match(c, FRONT[1]), made), iso)
    return once(t, lambda t: F.when(t.isNotNull(), date(F.array(F.year(t), F.month(t), F.day(t)))))


def fuzzy_date(c: Column) -> Column:
    """DT5: a year from 1500 to 2999, a full English month, a day up to 31; without a year literal."""
    month = month_number(first_match(F.lower(c), f"({'|'.join(MONTHS)})"))
    day = once(first_match(c, r"\b(\d{1,2})\b").cast("int"), lambda d: F.when(d <= 31, d))
    year = first_match(c, r"\b(1[5-9]\d{2}|2\d{3})\b").cast("int")
    return once(year, lambda y: F.when(y.isNull(), date(literal=c)).otherwise(date(leading(y, month, day))))


def pdf_date(c: Column) -> Column:
    """DT6: `D:YYYYMMDD`."""
    part = lambda i: first_match(c, r"^(?:D:)?(\d{4})(\d{2})?(\d{2})?", i).cast("int")
    return date(leading(part(1), part(2), part(3)))


def form_date(c: Column) -> Column:
    """DT7: numbers joined by hyphens, else literal."""
    nums = integers(c, "-")
    return F.when(F.trim(c) != "", F.when(F.size(nums) > 0, date(nums)).otherwise(date(literal=c)))


def form_text(d: Column) -> Column:
    """Inverse of DT7, month and day of two digits."""
    padded = F.transform(parts_of(d), lambda x, i: F.when(i > 0, F.lpad(x.cast("string"), 2, "0")).otherwise(x.cast("string")))
    return F.coalesce(F.array_join(padded, "-"), d["literal"])


def check_date(c: Column, this_year: int) -> Column:
    """DT8: a code for what is wrong with a form date; null if nothing is."""
    p = F.split(c, "-")
    num = lambda i: first_match(F.trim(F.get(p, F.lit(i))), r"^([+-]?\d+)").try_cast("int")
    n, y, m, d = F.size(p), num(0), num(1), num(2)
    out = F.when(F.lower(c).isin("n.d.", "nd"), "no_date").when(y.isNull(), "invalid_year").when(y < 1, "year_not_positive").when(y > this_year + 5, "future_year")
    return F.when(c.isNull() | (c == ""), F.lit(None)).otherwise(out.when((n >= 2) & ~F.coalesce(m.between(1, 12), F.lit(False)), "invalid_month").when((n >= 3) & ~F.coalesce(d.between(1, 31), F.lit(False)), "invalid_day"))


def text_date(d: Column, form: str = "text") -> Column:
    """DT9: a date by default: literal, or month, day and year; numeric: year, month and day joined by hyphens."""
    p = parts_of(d)
    y, m, day = (F.get(p, F.lit(i)) for i in range(3))
    if form == "numeric":
        shown = F.concat_ws("-", y.cast("string"), F.lpad(m.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0"))
    else:
        shown = F.concat_ws(" ", F.get(F.array(*(F.lit(x.capitalize()) for x in MONTHS)), m - 1), day.cast("string"), y.cast("string"))
    return F.coalesce(d["literal"], F.when(y.isNotNull(), shown))
