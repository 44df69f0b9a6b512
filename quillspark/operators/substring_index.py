"""A substring index of texts (FLT2, FLT6, FLT9): postings of trigrams, intersected rarest first, then verified."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Letters of a gram; files of postings are dealt by a hash of the gram into so many folders.
GRAM, FOLDERS = 3, 64
#: Grams of a query whose postings are read: the rarest ones.
READ = 4
#: Letters of indexed texts a task sorts the postings of, at most about; tables of fewer are dealt over the usual tasks.
LETTERS = 2_000_000


def grams(c: Column) -> Column:
    """The distinct trigrams of a text in lower case."""
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("(?s)(?=(" + "." * GRAM + "))"), F.lit(1)))


def _folder(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(FOLDERS)).cast("int")


def build(df: DataFrame, key: str, fields: list[str], path: str) -> None:
    """Write the index of the fields of a table: `postings` (gram, key), sorted by gram within each folder, and `counts`
    (gram, n). A row stands once under a gram, whichever of its fields holds it. A gram that most rows hold is dealt over
    the tasks of its folder by the key, so that no task has more than its share; their number grows with the texts."""
    every = F.array_distinct(F.flatten(F.array(*(F.coalesce(grams(F.col(f)), F.array().cast("array<string>")) for f in fields))))
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.explode(every).alias("gram")).withColumn("folder", _folder(F.col("gram")))
    letters = df.agg(F.sum(sum((F.coalesce(F.length(f), F.lit(0)).cast("long") for f in fields), F.lit(0).cast("long")))).first()[0] or 0
    parts = letters // LETTERS
    deals = ("folder", F.pmod(F.xxhash64("key"), F.lit(max(8, parts * 4 // FOLDERS))))
    usual = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = (rows.repartition(parts, *deals) if parts > usual else rows.repartition(*deals)).sortWithinPartitions("folder", "gram", "key")
    dealt.write.partitionBy("folder").parquet(f"{path}/postings")
    counts = df.sparkSession.read.parquet(f"{path}/postings").groupBy("folder", "gram").agg(F.count(F.lit(1)).alias("n"))
    counts.repartition("folder").sortWithinPartitions("folder", "gram").write.partitionBy("folder").parquet(f"{path}/counts")


def _of(spark: SparkSession, path: str, table: str, wanted: list[str]) -> DataFrame:
    """Rows of some grams: folders and row groups that cannot hold them are not read."""
    folders = [r[0] for r in spark.createDataFrame([(g,) for g in wanted], "gram string").select(_folder(F.col("gram"))).distinct().collect()]
    return spark.read.parquet(f"{path}/{table}").where(F.col("folder").isin(*folders) & F.col("gram").isin(*wanted))


def candidates(spark: SparkSession, path: str, text: str) -> DataFrame | None:
    """Keys of rows that hold the rarest trigrams of a text, all of them; None if the text is shorter than a gram."""
    low = text.lower()
    wanted = sorted({low[i : i + GRAM] for i in range(len(low) - GRAM + 1)})
    if not wanted:
        return None
    counts = {r["gram"]: r["n"] for r in _of(spark, path, "counts", wanted).groupBy("gram").agg(F.sum("n").alias("n")).collect()}  # a row a gram of the text
    schema = spark.read.parquet(f"{path}/postings").select("key").schema
    if len(counts) < len(wanted):
        return spark.createDataFrame([], schema)  # a gram that no row holds
    rare = sorted(wanted, key=lambda g: (counts[g], g))[:READ]
    postings = _of(spark, path, "postings", rare)
    return postings.distinct().groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(rare)).select("key")


def search(df: DataFrame, key: str, fields: list[str], path: str, text: str) -> DataFrame:
    """Rows of the indexed table of which a field holds the text, in any case: what a scan finds. A text shorter than a
    gram is looked for by a scan."""
    holds = F.lit(False)
    for f in fields:
        holds = holds | F.coalesce(F.contains(F.lower(f), F.lit(text.lower())), F.lit(False))
    found = candidates(df.sparkSession, path, text)
    return (df if found is None else df.join(found.withColumnRenamed("key", "_found"), F.col(key) == F.col("_found"), "left_semi")).where(holds)
