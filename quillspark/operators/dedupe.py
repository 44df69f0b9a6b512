"""Duplicates by derived keys (JN1 to JN3, AGG4, AGG5, MUT9): unions of equi joins instead of a disjunctive join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.dates import year_of
from quillspark.functions.identifiers import doi_key, isbn_key
from quillspark.functions.text import title_key
from quillspark.operators.components import components

# Fixed value: hosts whose URLs identify nothing.
SEARCH_URL = r"^https?://(www\.)?(google|bing|yahoo)\."


def keys(min_title: int, with_url: bool) -> dict[str, Column]:
    """Keys by rule in order of priority; null where a record has none."""
    title = title_key(F.col("title"))
    out = {"doi": doi_key(F.col("DOI")), "isbn": isbn_key(F.col("ISBN")), "title": F.when(F.length(title) > min_title, title)}
    if with_url:
        out["url"] = F.when(~F.col("URL").rlike(SEARCH_URL), F.nullif(F.col("URL"), F.lit("")))
    return out


def keyed(df: DataFrame, min_title: int, with_url: bool) -> DataFrame:
    """(id, _seq, rule, key) of all keys that records have."""
    every = F.array(*(F.struct(F.lit(i).alias("rule"), k.alias("key")) for i, k in enumerate(keys(min_title, with_url).values())))
    return df.select("id", "_seq", F.inline(every)).where("key IS NOT NULL")


def find_duplicates(new: DataFrame, library: DataFrame, min_title: int = 10, with_url: bool = True) -> DataFrame:
    """JN1: for each new record the first library record that shares a key, as `duplicate_of` (null: none).

    The library side has one row per key, so that a key many records share does not multiply rows."""
    first = keyed(library, min_title, with_url).groupBy("rule", "key").agg(F.min(F.struct("_seq", "id")).alias("hit"))
    found = keyed(new, min_title, with_url).join(first, ["rule", "key"]).groupBy("id").agg(F.min("hit")["id"].alias("duplicate_of"))
    return new.join(found, "id", "left")


def import_new(new: DataFrame, library: DataFrame) -> DataFrame:
    """JN2: the new records of which the library has no duplicate; URLs do not count, nor do the new ones among themselves."""
    return find_duplicates(new, library, with_url=False).where("duplicate_of IS NULL").drop("duplicate_of")


def duplicate_links(df: DataFrame, min_title: int = 15) -> DataFrame:
    """JN3: each record that shares a key with an earlier one: (id, first, rule), the first such record by the first rule
    that applies. A group of copies has a link per record, not per pair."""
    every = keyed(df, min_title, False)
    first = every.groupBy("rule", "key").agg(F.min(F.struct("_seq", "id")).alias("hit"))
    met = every.join(first, ["rule", "key"]).where(F.col("hit.id") != F.col("id"))
    best = met.groupBy("id").agg(F.min(F.struct("rule", "hit")).alias("b"))
    names = F.array(*map(F.lit, ("Same DOI", "Same ISBN", "Same title")))
    return best.select("id", F.col("b.hit.id").alias("first"), F.get(names, F.col("b.rule")).alias("reason"))


def pair_counts(df: DataFrame, min_title: int = 15) -> DataFrame:
    """JN3 as counts: pairs of records by the first rule under which they agree, without listing the pairs: pairs that
    share a key, less those that share a key of an earlier rule as well."""
    own = df.select("id", *(k.alias(n) for n, k in keys(min_title, False).items()))

    def pairs(*by: str) -> DataFrame:
        n = F.count(F.lit(1))
        full = own.where(" AND ".join(f"{c} IS NOT NULL" for c in by)).groupBy(*by).agg(n.alias("n"))
        return full.agg(F.coalesce(F.sum(F.col("n") * (F.col("n") - 1) / 2), F.lit(0)).cast("long").alias("n"))

    p = {by: pairs(*by).withColumnRenamed("n", "_".join(by)) for by in (("doi",), ("isbn",), ("title",), ("doi", "isbn"), ("doi", "title"), ("isbn", "title"), ("doi", "isbn", "title"))}
    all_ = None
    for d in p.values():
        all_ = d if all_ is None else all_.join(F.broadcast(d))
    return all_.select(F.col("doi").alias("same_doi"), (F.col("isbn") - F.col("doi_isbn")).alias("same_isbn"), (F.col("title") - F.col("doi_title") - F.col("isbn_title") + F.col("doi_isbn_title")).alias("same_title"))


def groups(df: DataFrame, min_title: int = 15) -> DataFrame:
    """AGG4: groups of records linked by keys, directly or through others: (id, group), group the smallest `_seq`.

    Each record hangs on the first of its key, so that a key of many records needs no pairs."""
    every = keyed(df, min_title, False).select("_seq", "rule", "key")
    first = every.groupBy("rule", "key").agg(F.min("_seq").alias("b"))
    linked = components(every.join(first, ["rule", "key"]).select(F.col("_seq").alias("a"), "b"))
    found = df.select("id", "_seq").join(linked.withColumnRenamed("node", "_seq"), "_seq", "left")
    return found.select("id", F.coalesce("root", "_seq").alias("group"))


def fields_filled() -> Column:
    """AGG5: how many of six fields a record has."""
    people = F.array_join(F.transform("author", lambda a: F.coalesce(a["family"], a["literal"], F.lit(""))), "")
    has = [F.col("title"), people, year_of(F.col("issued")).cast("string"), F.col("container_title"), F.col("DOI"), F.col("URL")]
    total = F.lit(0)
    for c in has:
        total = total + F.when(F.coalesce(c, F.lit("")) != "", 1).otherwise(0)
    return total


def keep_one(df: DataFrame, min_title: int = 15, keep: str = "first") -> DataFrame:
    """MUT9: one record of each group: the first, or the fullest (then the first)."""
    best = F.struct((-fields_filled() if keep == "fullest" else F.lit(0)).alias("f"), F.col("_seq"))
    g = df.join(groups(df, min_title), "id")
    chosen = g.groupBy("group").agg(F.min(best)["_seq"].alias("_seq"))
    return df.join(chosen.select("_seq"), "_seq", "left_semi")
