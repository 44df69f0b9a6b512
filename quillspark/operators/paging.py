"""Deep pages and numbers of rows without a sort in one task (SRT2, SRT7): ranges, keyset pages, islands of numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.tables import materialise


def numbered(df: DataFrame, *order: Column | str, name: str = "row") -> DataFrame:
    """Number all rows from 0 in the given order, which must tell all rows apart (ties are numbered in any order).

    Rows are dealt by ranges of the order and numbered within their range; the ranges' sizes, one row each, give the
    number at which each begins. The dealt table is written once, so that both reads see the same ranges.
    """
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    dealt = df.repartitionByRange(*keys).withColumn("_range", F.spark_partition_id())
    here = Window.partitionBy("_range").orderBy(*keys)
    dealt = materialise(dealt.withColumn("_at", F.row_number().over(here) - 1))
    sizes = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))  # a row per shuffle partition
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_range", before.alias("_start"))
    return dealt.join(F.broadcast(starts), "_range").withColumn(name, F.col("_start") + F.col("_at")).drop("_range", "_at", "_start", "_n")


def page(df: DataFrame, number: int, *order: Column | str, size: int = 50) -> DataFrame:
    """Page `number`, from 0: its range alone is read beyond the counting of the ranges."""
    return numbered(df, *order).where(F.col("row").between(number * size, (number + 1) * size - 1)).orderBy("row")


def page_after(df: DataFrame, last: dict[str, object], *descending: str, size: int = 50) -> DataFrame:
    """SRT2: the page behind the row whose order columns have the values `last`, in the order of these columns; those
    named descend, and nulls stand last. The columns must tell all rows apart. Each task keeps `size` rows at most."""
    behind, equal = F.lit(False), F.lit(True)
    for c, v in last.items():
        if v is None:
            further = F.lit(False)
        else:
            further = F.coalesce(F.col(c) < F.lit(v) if c in descending else F.col(c) > F.lit(v), F.lit(True))
        behind, equal = behind | (equal & further), equal & F.col(c).eqNullSafe(F.lit(v))
    keys = [F.col(c).desc_nulls_last() if c in descending else F.col(c).asc_nulls_last() for c in last]
    return df.where(behind).orderBy(*keys).limit(size)


def citation_numbers(records: DataFrame, *order: Column | str, key: str = "id") -> DataFrame:
    """SRT7 applied: the number, from 1, of each record in a bibliography sorted by several keys."""
    return numbered(records.select(key, *(c.alias(f"_k{i}") if isinstance(c, Column) else F.col(c).alias(f"_k{i}") for i, c in enumerate(order))), *(f"_k{i}" for i in range(len(order))), name="number").select(key, (F.col("number") + 1).alias("number"))


def collapsed(cited: DataFrame, cluster: str = "cluster", number: str = "number") -> DataFrame:
    """The numbers that each cluster cites as one text: neighbours become a range from three on, `1-3, 5, 6`. A number
    counts once. Rows: one a cited number."""
    one = cited.where(F.col(number).isNotNull()).select(cluster, F.col(number).cast("long").alias("_n")).distinct()
    ordered = Window.partitionBy(cluster).orderBy("_n")
    islands = one.withColumn("_island", F.col("_n") - F.row_number().over(ordered)).groupBy(cluster, "_island").agg(F.min("_n").alias("_a"), F.max("_n").alias("_b"))
    a, b = F.col("_a").cast("string"), F.col("_b").cast("string")
    shown = F.when(F.col("_b") - F.col("_a") >= 2, F.concat(a, F.lit("-"), b)).when(F.col("_b") > F.col("_a"), F.concat(a, F.lit(", "), b)).otherwise(a)
    return islands.groupBy(cluster).agg(F.array_sort(F.collect_list(F.struct("_a", shown.alias("_s")))).alias("_p")).select(cluster, F.array_join(F.transform("_p", lambda p: p["_s"]), ", ").alias("cited"))


def letters(n: Column) -> Column:
    """a to z, aa, ab and so on, for a number from 0; up to four letters."""
    out, base, width = F.lit(None).cast("string"), 0, 26
    for size in range(1, 5):
        own = F.lit("")
        for place in range(size):
            own = F.concat(F.char(F.lit(97) + F.pmod(F.floor((n - base) / 26**place), F.lit(26))), own)
        out = F.coalesce(out, F.when(n < base + width, own))
        base, width = base + width, width * 26
    return out


def year_suffixes(records: DataFrame, *order: str, names: str = "names", year: str = "year", key: str = "id") -> DataFrame:
    """The letter that tells records of the same names and year apart, in the given order; null where one stands alone.
    (key, year_suffix). Records without a year have none. A hot group of names and year is a window of its own: names
    of a third of all rows take a dealt order as in `numbered`."""
    of = records.where(F.col(year).isNotNull()).select(*dict.fromkeys([key, names, year, *order]))
    rows = numbered(of, names, year, *order)
    first = rows.groupBy(names, year).agg(F.min("row").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    match = [rows[c].eqNullSafe(first[c]) for c in (names, year)]
    met = rows.join(first, match[0] & match[1], "left").select(rows[key], "row", "_first")
    given = met.select(key, F.when(F.col("_first").isNotNull(), letters(F.col("row") - F.col("_first"))).alias("year_suffix"))
    return given.unionByName(records.where(F.col(year).isNull()).select(key, F.lit(None).cast("string").alias("year_suffix")))
