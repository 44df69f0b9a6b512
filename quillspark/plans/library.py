"""A library of citation records over the driver tables, with the same columns in Spark and in SQL.

No bibliographic table is given, so every column derives from `documents` and `labels` by expressions that both engines
read alike. RECORDS_SQL gives flat columns; names are two parallel lists, families and givens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import dates
from quillspark.functions.names import name

FAMILY_NAMES = ("Smith", "Garcia", "Muller", "Tanaka", "Okafor", "Silva", "Novak", "Dubois", "Rossi", "Kim", "Ivanov")
GIVEN_NAMES = ("Anna Maria", "John", "Li Wei", "Pedro J.", "Zoe", "Karl", "Mina R. T.")
KINDS = ("article-journal", "book", "chapter", "thesis", "webpage", "article-newspaper")
PUBLISHERS = ("North Press", "Harbor & Sons", "University of Lund")


def _pick(values: tuple[str, ...], at: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), F.pmod(at, F.lit(len(values))).cast("int"))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The title is taken before the join, so that texts are not shuffled.
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.split("text", "\n")[0].alias("title"), "lang", "source")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality", "toxic")
    n = F.col("doc_id")
    people = F.transform(F.sequence(F.lit(1).cast("long"), F.greatest(n % 8, F.lit(1))), lambda i: name(_pick(FAMILY_NAMES, n + i * 3), _pick(GIVEN_NAMES, n + i)))
    group = name(literal=F.concat(F.lit("Group "), n % 13))
    year, month, day = (F.lit(1990) + n % 35).cast("int"), (F.lit(1) + n % 12).cast("int"), (F.lit(1) + n % 28).cast("int")
    issued = F.when(n % 11 != 0, dates.date(F.when(n % 3 == 0, F.array(year)).when(n % 3 == 1, F.array(year, month)).otherwise(F.array(year, month, day))))
    kind = _pick(KINDS, n)
    host = F.when(n % 6 != 1, F.concat(F.lit("Journal of Studies "), n % 17))
    tags = F.when(F.col("quality").isNotNull(), F.array_compact(F.array(F.when(F.col("quality") == 1, "good"), F.when(F.col("toxic") == 1, "toxic"), F.concat(F.lit("t"), n % 5))))
    return d.join(labels, "doc_id", "left").select(
        F.concat(F.lit("d"), n).alias("id"), n.alias("_seq"), kind.alias("type"), "title", F.when(n % 9 == 0, F.lit(None)).when(n % 8 == 0, F.array(group)).otherwise(people).alias("author"),
        issued.alias("issued"), host.alias("container_title"), F.when(n % 4 != 0, (n % 90 + 1).cast("string")).alias("volume"), F.when(n % 5 != 0, (n % 12 + 1).cast("string")).alias("issue"),
        F.when(n % 7 != 0, F.concat((n % 400 + 1).cast("string"), F.lit("-"), (n % 400 + 12).cast("string"))).alias("page"), F.when(n % 3 != 2, _pick(PUBLISHERS, n)).alias("publisher"),
        F.when(n % 4 != 3, F.concat(F.lit("10."), F.lit(1000) + n % 40, F.lit("/Ab."), n % 701)).alias("DOI"), F.when(n % 6 == 1, F.concat(F.lit("978-0-"), F.lit(10000000) + n % 350)).alias("ISBN"),
        F.when(n % 2 == 0, F.concat(F.lit("https://example.org/"), n % 333)).alias("URL"), F.when(n % 10 != 0, F.array("source")).alias("_projectIds"), tags.alias("_tags"),
        F.coalesce(F.col("quality") == 1, F.lit(False)).alias("_starred"), F.concat(F.lit("2024-01-"), F.lpad((n % 28 + 1).cast("string"), 2, "0")).alias("_dateAdded"), F.col("lang").alias("language"), F.concat_ws(", ", "lang", "source").alias("keyword"),
        F.when(n % 5 == 0, F.concat(F.lit("note "), n % 21)).alias("_notes"),
    )


def _sql_pick(values: tuple[str, ...], at: str) -> str:
    return f"[{', '.join(repr(v) for v in values)}][CAST(({at}) % {len(values)} AS INT) + 1]"


RECORDS_SQL = f"""rec AS (
  SELECT 'd' || d.doc_id AS id, d.doc_id AS n, d.doc_id AS _seq, {_sql_pick(KINDS, "d.doc_id")} AS type, split_part(text, chr(10), 1) AS title,
    CASE WHEN d.doc_id % 9 = 0 THEN 0 WHEN d.doc_id % 8 = 0 THEN 1 ELSE greatest(d.doc_id % 8, 1) END AS n_authors, d.doc_id % 9 <> 0 AND d.doc_id % 8 = 0 AS is_group,
    CASE WHEN d.doc_id % 9 = 0 THEN [] WHEN d.doc_id % 8 = 0 THEN ['Group ' || (d.doc_id % 13)] ELSE list_transform(range(1, greatest(d.doc_id % 8, 1) + 1), lambda i: {_sql_pick(FAMILY_NAMES, "d.doc_id + i * 3")}) END AS families,
    CASE WHEN d.doc_id % 9 = 0 OR d.doc_id % 8 = 0 THEN [] ELSE list_transform(range(1, greatest(d.doc_id % 8, 1) + 1), lambda i: {_sql_pick(GIVEN_NAMES, "d.doc_id + i")}) END AS givens,
    CASE WHEN d.doc_id % 11 <> 0 THEN 1990 + d.doc_id % 35 END AS year, CASE WHEN d.doc_id % 11 <> 0 AND d.doc_id % 3 > 0 THEN 1 + d.doc_id % 12 END AS month, CASE WHEN d.doc_id % 11 <> 0 AND d.doc_id % 3 = 2 THEN 1 + d.doc_id % 28 END AS day,
    CASE WHEN d.doc_id % 6 <> 1 THEN 'Journal of Studies ' || (d.doc_id % 17) END AS container_title, CASE WHEN d.doc_id % 4 <> 0 THEN CAST(d.doc_id % 90 + 1 AS VARCHAR) END AS volume,
    CASE WHEN d.doc_id % 5 <> 0 THEN CAST(d.doc_id % 12 + 1 AS VARCHAR) END AS issue, CASE WHEN d.doc_id % 7 <> 0 THEN (d.doc_id % 400 + 1) || '-' || (d.doc_id % 400 + 12) END AS page,
    CASE WHEN d.doc_id % 3 <> 2 THEN {_sql_pick(PUBLISHERS, "d.doc_id")} END AS publisher, CASE WHEN d.doc_id % 4 <> 3 THEN '10.' || (1000 + d.doc_id % 40) || '/Ab.' || (d.doc_id % 701) END AS DOI,
    CASE WHEN d.doc_id % 6 = 1 THEN '978-0-' || (10000000 + d.doc_id % 350) END AS ISBN, CASE WHEN d.doc_id % 2 = 0 THEN 'https://example.org/' || (d.doc_id % 333) END AS URL,
    CASE WHEN d.doc_id % 10 <> 0 THEN source END AS project, CASE WHEN quality IS NOT NULL THEN list_filter([CASE WHEN quality = 1 THEN 'good' END, CASE WHEN toxic = 1 THEN 'toxic' END, 't' || (d.doc_id % 5)], lambda t: t IS NOT NULL) END AS tags,
    COALESCE(quality = 1, FALSE) AS starred, '2024-01-' || lpad(CAST(d.doc_id % 28 + 1 AS VARCHAR), 2, '0') AS date_added, lang AS language, lang || ', ' || source AS keyword, CASE WHEN d.doc_id % 5 = 0 THEN 'note ' || (d.doc_id % 21) END AS notes
  FROM documents d LEFT JOIN labels USING (doc_id)
)"""
