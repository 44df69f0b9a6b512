"""Operator 10: token ids as Parquet list columns with controlled encodings, row groups and page indexes."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.llm import common
from quillspark.llm.kernels import slices, text_bytes
from quillspark.llm.tokens import encoder, vocabulary

#: Text of a file: 16 MB, for large inputs up to 1 GB.
FILE_BYTES, MAX_FILE_BYTES, FILES = 1 << 24, 1 << 30, 4096
#: Files whose sizes are broadcast: a few bytes each.
BROADCAST_FILES = 500_000
FILE_SCHEMA = "doc_id long, part int, before long, n_tokens long, tokens array<int>"


def write_tokens(docs: DataFrame, path: str, vocab: str, end_id: int = 2, row_group_mb: int = 16, page_rows: int = 2000) -> None:
    """Write one row per document (doc_id, text; null text: the end id alone), in ascending doc_id order over
    the files by name. Rows of equal doc_id stand in order of their text; a null doc_id comes first.

    The ids are a dictionary-encoded list column, doc_id and the running counts are delta-encoded; row groups
    and pages are small enough for a reader to seek by the column indexes on doc_id.
    """
    _, n_bytes = common.text_volume(docs)
    n_files = common.batches_for(n_bytes, min(max(FILE_BYTES, n_bytes // FILES), MAX_FILE_BYTES))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before, enc = TaskContext.get().partitionId(), 0, encoder(vocab)
        for batch in (piece for whole in batches for piece in slices(whole, "text")):
            raw, offsets = text_bytes(batch.column("text"))
            ids, first = enc.encode(raw, offsets)
            n = batch.num_rows
            out = np.insert(ids, first[1:], end_id).astype(np.int32)
            bounds = first + np.arange(n + 1)
            count = np.diff(bounds)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.full(n, part, np.int32)), pa.array(before + bounds[:-1]), pa.array(count), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(out))],
                names=["doc_id", "part", "before", "n_tokens", "tokens"],
            )
            before += int(bounds[-1])

    ranged = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange(n_files, "doc_id").sortWithinPartitions("doc_id", "text")
    options = {
        "compression": "zstd", "parquet.writer.version": "v2", "parquet.block.size": str(row_group_mb << 20), "parquet.page.row.count.limit": str(page_rows),
        "parquet.enable.dictionary": "true", **{f"parquet.enable.dictionary#{c}": "false" for c in ("doc_id", "part", "before", "n_tokens")},
    }
    ranged.mapInArrow(encode, FILE_SCHEMA).write.options(**options).parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and tokens of each document of the files.

    The number of ids in each file is summed first, from the delta-encoded counts alone; that table has a row per file.
    A filter on doc_id reaches the files' indexes, and without tokens only the small columns are read.
    """
    files = spark.read.schema(FILE_SCHEMA).parquet(path)
    sizes = common.materialise(files.groupBy("part").agg(F.sum("n_tokens").alias("size")))
    ahead = sizes.select("part", (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("ahead"))
    small = sizes.count() <= BROADCAST_FILES
    return files.join(F.broadcast(ahead) if small else ahead, "part").select("doc_id", (F.col("ahead") + F.col("before")).alias("start"), "n_tokens", "tokens")


def token_digests(tokens: DataFrame) -> DataFrame:
    """The crc32 of each document's ids as little-endian unsigned 32-bit integers."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("tokens")
            bounds = lists.offsets.to_numpy().astype(np.int64) * 4
            data = memoryview(np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False).astype("<u4"))).cast("B")
            crc = np.fromiter((zlib.crc32(data[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)), np.int64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), batch.column("n_tokens"), pa.array(crc)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return tokens.mapInArrow(digest, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{common.shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(common.documents(spark, sf_dir), path, vocabulary())
    return token_digests(read_tokens(spark, path))
