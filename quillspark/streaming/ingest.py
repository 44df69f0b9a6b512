"""Structured Streaming ingest: records arrive as files, copies within the watermark go, the rest is appended."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillspark.functions.identifiers import doi_key, isbn_key
from quillspark.functions.text import title_key
from quillspark.operators.dedupe import import_new
from quillspark.sources.parse import parse_any
from quillspark.tables import drop_table, materialise


def contents(spark: SparkSession, path: str, per_batch: int = 1000) -> DataFrame:
    """Files of a folder as they arrive: content and arrival time."""
    raw = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("maxFilesPerTrigger", per_batch).load(path)
    return raw.select(F.decode("content", "UTF-8").alias("content"), F.col("path").alias("_file"), F.col("modificationTime").alias("arrived"))


def records(stream: DataFrame) -> DataFrame:
    """Records of arriving contents; parsing keeps no state."""
    return parse_any(stream)


def distinct_records(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """One record per derived key among those that arrive within the delay; state is dropped behind the watermark."""
    title = title_key(F.col("title"))
    key = F.coalesce(F.concat(F.lit("d:"), doi_key(F.col("DOI"))), F.concat(F.lit("i:"), isbn_key(F.col("ISBN"))), F.concat(F.lit("t:"), F.when(F.length(title) > 10, title)), F.concat(F.lit("x:"), F.coalesce("_file", F.lit("")), F.col("_seq")))
    return stream.withColumn("_key", key).withWatermark("arrived", delay).dropDuplicatesWithinWatermark(["_key"]).drop("_key")


def into_library(stream: DataFrame, library: str, checkpoint: str) -> StreamingQuery:
    """Append arriving records that the library table does not hold. The table is partitioned by _batch; a batch that is
    tried again is held against the rows of the others and overwrites its own partition, so that none comes twice. Sessions that read the table before refresh it."""

    def add(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.withColumn("_batch", F.lit(number).cast("long"))
        if not spark.catalog.tableExists(library):
            rows.write.partitionBy("_batch").saveAsTable(library)
            return
        held = spark.table(library)
        columns = [c for c in held.columns if c != "_batch"]
        new = materialise(import_new(batch, held.where(F.col("_batch") != number).drop("_batch")).select(*columns))
        view = f"_batch_{uuid.uuid4().hex}"
        new.createOrReplaceTempView(view)
        spark.sql(f"INSERT OVERWRITE TABLE {library} PARTITION (_batch = {number}) SELECT {', '.join(f'`{c}`' for c in columns)} FROM {view}")
        spark.catalog.dropTempView(view)
        drop_table(new)

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
