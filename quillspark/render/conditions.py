"""Tests of a style's choices on records (FLT11), what a style tells of itself (FMT8) and its sort keys (SRT7)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark import schema
from quillspark.operators.extract import attribute, element


def has_type(*types: str) -> Column:
    """The record is of one of the types."""
    return F.coalesce(F.col("type").isin(*types), F.lit(False))


def _held(column: str) -> Column:
    if column in schema.ROLES:
        return F.size(column) > 0
    if column in schema.DATES:
        return F.col(column).isNotNull()
    return F.col(column) != ""


def has_variable(*columns: str) -> Column:
    """One of the columns has a value: a text, a date, or a list of names that is not empty."""
    return reduce(lambda a, b: a | b, (F.coalesce(_held(c), F.lit(False)) for c in columns))


def is_numeric(*columns: str) -> Column:
    """One of the columns holds digits, hyphens and commas alone."""
    return reduce(lambda a, b: a | b, (F.coalesce(F.col(c).rlike("^[0-9,-]*$"), F.lit(False)) for c in columns))


def is_uncertain(*columns: str) -> Column:
    """One of the dates is marked circa."""
    return reduce(lambda a, b: a | b, (F.coalesce(F.col(c)["circa"], F.lit(False)) for c in columns))


def choose(match: str, *tests: Column) -> Column:
    """FLT11: `all`, `any` or `none` of the tests hold."""
    if match == "all":
        return reduce(lambda a, b: a & b, tests)
    met = reduce(lambda a, b: a | b, tests)
    return ~met if match == "none" else met


def style_info(xml: Column) -> Column:
    """FMT8: title, id, locale, class and parts of a style."""
    head = F.regexp_extract(xml, r"(?is)<style\b[^>]*>", 0)
    return F.struct(
        element(xml, "title").alias("title"), element(xml, "id").alias("id"), attribute(head, "default-locale").alias("default_locale"), F.coalesce(attribute(head, "class"), F.lit("in-text")).alias("class"),
        xml.rlike(r"<bibliography\b").alias("has_bibliography"), xml.rlike(r"<citation\b").alias("has_citation"),
    )


def sort_keys(xml: Column, layout: str = "bibliography") -> Column:
    """SRT7: the keys of a layout in order: a variable or a macro, and whether it ascends."""
    part = F.regexp_extract(xml, rf"(?is)<{layout}\b[^>]*>(.*?)</{layout}\s*>", 1)
    keys = F.regexp_extract_all(F.regexp_extract(part, r"(?is)<sort\b[^>]*>(.*?)</sort\s*>", 1), F.lit(r"(?is)<key\b[^>]*>"), F.lit(0))
    return F.transform(keys, lambda k: F.struct(attribute(k, "variable").alias("variable"), attribute(k, "macro").alias("macro"), (F.coalesce(attribute(k, "sort"), F.lit("ascending")) == "ascending").alias("ascending")))
