"""A stored library (SNK9, SNK10, SRC16, MUT on a table): keyed records in files dealt by a hash of the key.

A change writes new files for the parts that hold its keys and then puts one small file in place that names the files
of every part. Until then readers see the old version, also when an executor or the driver is lost; a version once
opened stays as it is.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Stored:
    """A table of records with one row a key, under a path that all executors see."""

    def __init__(self, spark: SparkSession, path: str, key: str = "id", parts: int = 64) -> None:
        self.spark, self.path, self.key, self.parts = spark, path.rstrip("/"), key, parts
        hadoop = spark._jvm.org.apache.hadoop.fs
        self._file = lambda name: hadoop.Path(f"{self.path}/{name}")
        self._fs = self._file("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _part(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.parts)).cast("int")

    def manifest(self) -> dict:
        """The version that readers see: schema and the folder of each part that has rows."""
        at = self._file("CURRENT")
        if not self._fs.exists(at):
            return {"schema": None, "folders": {}}
        stream = self._fs.open(at)
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text)

    def _commit(self, manifest: dict) -> None:
        draft = self._file(f"draft-{uuid.uuid4().hex}")
        stream = self._fs.create(draft)
        stream.write(bytearray(json.dumps(manifest), "utf-8"))
        stream.close()
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        replace = self.spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        options = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = replace
        context.rename(draft, self._file("CURRENT"), options)

    def _read(self, manifest: dict, parts: list[int] | None = None) -> DataFrame:
        folders = [f for p, f in manifest["folders"].items() if parts is None or int(p) in parts]
        schema = self._schema(manifest)
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    @staticmethod
    def _schema(manifest: dict) -> StructType:
        return StructType.fromJson(manifest["schema"])

    def read(self) -> DataFrame:
        """All records of the present version."""
        return self._read(self.manifest())

    def get(self, keys: list) -> DataFrame:
        """SRC16: the records of some keys; only the parts that can hold them are read."""
        manifest = self.manifest()
        kind = self._schema(manifest)[self.key].dataType
        wanted = self.spark.createDataFrame([(k,) for k in keys], f"{self.key} {kind.simpleString()}")
        parts = [r[0] for r in wanted.select(self._part()).distinct().collect()]  # as many as parts at most
        return self._read(manifest, parts).where(F.col(self.key).isin(*keys))

    def _change(self, touched: list[int], rows: DataFrame, manifest: dict) -> int:
        """Write the rows of the touched parts anew and commit; returns the number of parts."""
        folder = f"{self.path}/v-{uuid.uuid4().hex}"
        names = rows.columns
        dealt = rows.withColumn("_part", self._part()).repartition("_part")
        dealt.write.partitionBy("_part").parquet(folder)
        folders = {p: f for p, f in manifest["folders"].items() if int(p) not in touched}
        here = self._file(folder.removeprefix(f"{self.path}/"))
        held = {s.getPath().getName() for s in self._fs.listStatus(here)}
        folders |= {str(p): f"{folder}/_part={p}" for p in touched if f"_part={p}" in held}
        self._commit({"schema": json.loads(rows.select(*names).schema.json()), "folders": folders})
        return len(touched)

    def upsert(self, rows: DataFrame) -> int:
        """SNK9: put records, a new one or one in place of that with its key; of rows that repeat a key any one counts, a
        null key is no record. Returns the number of parts that were written: of a few keys a few, whatever the table."""
        manifest = self.manifest()
        rows = rows.where(F.col(self.key).isNotNull()).dropDuplicates([self.key])
        touched = sorted(r[0] for r in rows.select(self._part()).distinct().collect())
        if not touched:
            return 0
        if manifest["schema"] is None:
            return self._change(touched, rows, manifest)
        old = self._read(manifest, touched)
        return self._change(touched, old.join(rows.select(self.key), self.key, "left_anti").unionByName(rows, allowMissingColumns=True).select(*old.columns), manifest)

    def delete(self, keys: DataFrame) -> int:
        """SNK10: leave out the records of some keys."""
        manifest = self.manifest()
        keys = keys.select(self.key).distinct()
        touched = sorted(r[0] for r in keys.select(self._part()).distinct().collect() if str(r[0]) in manifest["folders"])
        if not touched:
            return 0
        return self._change(touched, self._read(manifest, touched).join(keys, self.key, "left_anti"), manifest)

    def update(self, keys: DataFrame, **columns: Column) -> int:
        """MUT1, MUT2: set columns of the records of some keys to expressions of the record."""
        manifest = self.manifest()
        keys = keys.select(self.key).distinct()
        touched = sorted(r[0] for r in keys.select(self._part()).distinct().collect() if str(r[0]) in manifest["folders"])
        if not touched:
            return 0
        met = self._read(manifest, touched).join(keys.withColumn("_hit", F.lit(True)), self.key, "left")
        names = [c for c in met.columns if c != "_hit"]
        return self._change(touched, met.select(*(F.when(F.col("_hit"), columns[c]).otherwise(F.col(f"`{c}`")).alias(c) if c in columns else F.col(f"`{c}`") for c in names)), manifest)
