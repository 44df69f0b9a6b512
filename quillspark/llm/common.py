"""Spark helpers that the operators share."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.tables import drop_table, materialise, shared_dir

__all__ = ["batch_bytes", "batch_key", "batches_for", "documents", "drop_table", "fresh", "least_by_hash", "materialise", "shared_dir", "text_volume"]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_volume(df: DataFrame, column: str = "text") -> tuple[int, int]:
    """Rows and bytes of text: two numbers, by which groups are sized."""
    row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(column).cast("long")).alias("b")).first()
    return int(row["n"] or 0), int(row["b"] or 0)


def batch_key(n_batches: int, *columns: str) -> Column:
    """Deals rows evenly into n_batches groups; rows that are equal in all columns share one."""
    return F.pmod(F.xxhash64(*columns), F.lit(n_batches)).cast("long")


def batches_for(n_bytes: int, target: int = 1 << 21) -> int:
    return max(1, math.ceil(n_bytes / target))


def batch_bytes(n_bytes: int) -> int:
    """Text of a batch: 2 MB, and for large inputs up to 32 MB, so that a passage in many documents, which each batch
    sends once, does not meet itself more often than need be."""
    return min(max(1 << 21, n_bytes // 20_000), 1 << 25)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the table does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def least_by_hash(df: DataFrame, limit: int, *keys: str) -> DataFrame:
    """The `limit` rows of least hash of the keys. A bound on the hash, set by the number of rows, leaves little more
    than `limit` rows before they are sorted, however many partitions there are."""
    turn = F.xxhash64(*keys)
    share = 1.2 * limit + 1000
    n = df.count()
    if n > share:
        df = df.where(turn < int((share / n) * 2.0**64 - 2.0**63))
    return df.orderBy(turn, *keys).limit(limit)
