"""A training corpus from documents: each stage works on all rows that the one before it kept.

Rows whose doc_id repeats, or is null, are documents of their own; a stage that drops a document by its id drops all
rows of that id. Extra columns of documents pass through every stage but the last.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import common, decontamination, jaccard_join, language_id, packing, secret_scan
from quillspark.llm.tokens import vocabulary

#: No SQL expresses a trained network, so the stages are tested against brute-force versions.
ORACLE_SQL = None


def _by_id(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """Documents whose doc_id is (left_semi) or is not (left_anti) among ids; a null id is an id."""
    ids = ids.select(F.col("doc_id").alias("_id")).distinct()
    return docs.join(ids, docs["doc_id"].cast("long").eqNullSafe(ids["_id"]), how)


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in a language: null texts and texts without a letter are `und` and go."""
    net = language_id.train(docs.select("doc_id", "text", "lang"))
    language, score = common.fresh(docs, "lang_pred"), common.fresh(docs, "score")
    ruled = language_id.identify(docs, net, language, score)
    return (ruled if net is None else ruled.where(F.col(language) != "und")).select(*(F.col(f"`{c}`") for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest doc_id of each group whose sets of five-word shingles are linked at 0.8 or more."""
    groups = jaccard_join.join(docs, size=5, percent=80)
    return _by_id(docs, groups.where(F.col("doc_id").eqNullSafe(F.col("component_id"))), "left_semi")


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that hold no item of the benchmark."""
    held = decontamination.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _by_id(docs, held, "left_anti")


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Put a mark in place of every secret."""
    return secret_scan.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the token ids of all documents into sequences of at most 2048."""
    return packing.pack(packing.token_pieces(docs, vocabulary()))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", languages),
    ("jaccard_join", near_duplicates),
    ("decontamination", decontaminated),
    ("secret_scan", secrets),
    ("best_fit_packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    for i, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES):
            docs = common.materialise(docs)
    return docs
