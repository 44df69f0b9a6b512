"""Lists of names and dates by rules that are columns (ARR2, DT9, NUM1): each row can have its own."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions import dates
from quillspark.functions.text import ordinal, roman

#: Rule of a list of names: from `min` names on `use_first` are shown, then the last one (use_last) or the term et_al;
#: `conjunction` stands before the last name; given names become initials that end with initialize_with, unless it is
#: null; sort_order: all, first or null for which names the family comes first.
NAME_RULE = "struct<min:int,use_first:int,use_last:boolean,conjunction:string,delimiter:string,et_al:string,initialize_with:string,sort_order:string>"
#: Rule of a date: its parts in order, or where there are none a form, text or numeric.
DATE_RULE = "struct<form:string,delimiter:string,parts:array<struct<name:string,form:string,prefix:string,suffix:string>>>"
# Short names of months.
SHORT_MONTHS = ("Jan.", "Feb.", "Mar.", "Apr.", "May", "Jun.", "Jul.", "Aug.", "Sep.", "Oct.", "Nov.", "Dec.")


def _filled(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _joined(separator: Column | str, *parts: Column) -> Column:
    """Parts that are not empty, with a separator between."""
    kept = F.filter(F.array(*parts), lambda p: p != "")
    mark = F.lit(separator) if isinstance(separator, str) else separator
    return F.aggregate(kept, F.lit(""), lambda acc, p: F.when(acc == "", p).otherwise(F.concat(acc, mark, p)))


def initials_with(given: Column, mark: Column) -> Column:
    """Initials that end with a mark of the row's own; parts between hyphens keep them."""
    words = F.filter(F.split(given, r"[\s.]+"), lambda w: w != "")
    one = lambda w: F.array_join(F.transform(F.filter(F.split(w, "-"), lambda p: p != ""), lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.rtrim(mark))), "-")
    return F.array_join(F.transform(words, one), " ")


def one_name(n: Column, place: Column, rule: Column) -> Column:
    """One name of a list, by its place from 0."""
    family, particle, suffix = _filled(n["family"]), _filled(n["non_dropping_particle"]), _filled(n["suffix"])
    given = F.when(rule["initialize_with"].isNotNull(), initials_with(_filled(n["given"]), rule["initialize_with"])).otherwise(_filled(n["given"]))
    inverted = _joined(", ", _joined(" ", particle, family), given, suffix)
    plain = _joined(" ", given, particle, family, suffix)
    first = (rule["sort_order"] == "all") | ((rule["sort_order"] == "first") & (place == 0))
    return F.coalesce(n["literal"], F.when(F.coalesce(first, F.lit(False)), inverted).otherwise(plain))


def names_by_rule(people: Column, rule: Column) -> Column:
    """ARR2: a list of names as its row's rule has it; null for no names."""
    n, delimiter = F.size(people), F.coalesce(rule["delimiter"], F.lit(", "))
    cut = F.coalesce(n >= rule["min"], F.lit(False))
    count = F.when(cut, F.least(F.coalesce(rule["use_first"], F.lit(1)), n)).otherwise(n)
    shown = F.transform(F.slice(people, F.lit(1), F.greatest(count, F.lit(0))), lambda p, i: one_name(p, i, rule))
    last = F.element_at(people, -1)
    both = F.concat(F.get(shown, F.lit(0)), F.lit(" "), rule["conjunction"], F.lit(" "), F.get(shown, F.lit(1)))

    def add(acc: Column, x: Column) -> Column:
        mark = F.when(~cut & (x["i"] == count - 1) & rule["conjunction"].isNotNull(), F.concat(delimiter, rule["conjunction"], F.lit(" "))).otherwise(delimiter)
        return F.when(x["i"] == 0, x["s"]).otherwise(F.concat(acc, mark, x["s"]))

    row = F.aggregate(F.transform(shown, lambda s, i: F.struct(i.alias("i"), s.alias("s"))), F.lit(""), add)
    plain = F.when(~cut & (n == 2) & rule["conjunction"].isNotNull(), both).otherwise(row)
    tail = F.when(F.coalesce(rule["use_last"], F.lit(False)) & (n > count + 1), F.concat(delimiter, F.lit("… "), F.coalesce(last["literal"], F.concat(_filled(last["given"]), F.lit(" "), _filled(last["family"]))))).otherwise(F.concat(F.lit(", "), F.coalesce(rule["et_al"], F.lit("et al."))))
    return F.when(n > 0, F.when(cut, F.concat(plain, tail)).otherwise(plain))


def date_by_rule(d: Column, rule: Column) -> Column:
    """DT9: a date by its row's rule: the literal, or the rule's parts that the date has, or the rule's form: text is
    month, day and year, numeric year, month and day of two digits. Null for no date."""
    p = dates.parts_of(d)
    y, m, day = (F.get(p, F.lit(i)) for i in range(3))
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    long = F.get(F.array(*(F.lit(x.capitalize()) for x in dates.MONTHS)), m - 1)
    short = F.get(F.array(*map(F.lit, SHORT_MONTHS)), m - 1)

    def part(x: Column) -> Column:
        month = F.when(x["form"] == "numeric", m.cast("string")).when(x["form"] == "numeric-leading-zeros", two(m)).when(x["form"] == "short", short).otherwise(long)
        of_day = F.when(x["form"] == "numeric-leading-zeros", two(day)).when(x["form"] == "ordinal", ordinal(day)).otherwise(day.cast("string"))
        value = F.when(x["name"] == "year", y.cast("string")).when(x["name"] == "month", month).when(x["name"] == "day", of_day)
        return F.when(F.coalesce(value, F.lit("")) != "", F.concat(_filled(x["prefix"]), value, _filled(x["suffix"])))

    found = F.array_compact(F.transform(rule["parts"], part))
    made = F.aggregate(found, F.lit(None).cast("string"), lambda acc, x: F.when(acc.isNull(), x).otherwise(F.concat(acc, _filled(rule["delimiter"]), x)))
    plain = F.when(rule["form"] == "numeric", F.concat_ws("-", y.cast("string"), two(m), two(day))).otherwise(F.concat_ws(" ", long, day.cast("string"), y.cast("string")))
    return F.when(d["literal"].isNotNull(), d["literal"]).when(F.size(p) > 0, F.when(F.size(rule["parts"]) > 0, F.coalesce(made, F.lit(""))).otherwise(plain))


def number_by_form(value: Column, form: Column) -> Column:
    """NUM1: numeric, ordinal, long-ordinal (as it is) or roman, by the row's own form; what is no whole number stays."""
    n = F.when(value.rlike(r"^[+-]?\d{1,9}$"), value.try_cast("int"))
    return F.when(n.isNull(), value).when(form == "ordinal", ordinal(n)).when(form == "roman", roman(n)).otherwise(value)
