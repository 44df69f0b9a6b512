"""Operator 12: audit of how filters interact, by Walsh-Hadamard sums.

Every document has a mask of the filters that it fails. One pass aggregates, for each part and label, the 32 parity
sums: documents counted plus or minus by the parity of the bits that their mask shares with a pattern. The transform
is its own inverse up to a factor of 32, so that the sums give the number of documents of every mask exactly. All
that any order of the filters does follows from those 32 numbers: a document is removed by the first filter of the
order that it fails. Over all 120 orders each of the f filters that it fails comes first in 120 / f of them, which is
the Shapley count in closed form.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import common
from quillspark.llm.kernels import slices

#: Filters in the order of their bits.
FILTERS = "ABCDE"
CELLS = 1 << len(FILTERS)
ORDERS = ["".join(p) for p in itertools.permutations(FILTERS)]
UPPER = bytes(range(ord("A"), ord("Z") + 1))
#: Bytes that continue a code point.
CONTINUED = bytes(range(0x80, 0xC0))
MARKS = re.compile(rb"[#$%&*|]")


def text_failures(text: bytes) -> int:
    """Mask of the filters A to D that a text, as UTF-8, fails."""
    words = text.split()  # at ASCII white space
    points = len(text.translate(None, CONTINUED))
    fails = len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * (len(text) - len(text.translate(None, UPPER))) > 5 * points, MARKS.search(text) is not None
    return sum(1 << i for i, failed in enumerate(fails) if failed)


def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, part and text to doc_id, part, mask of A to D and SHA-256 of the text."""
    for batch in batches:
        for piece in slices(batch, "text"):
            texts = [x or b"" for x in piece.column("text").cast(pa.large_binary()).to_pylist()]
            mask = pa.array([text_failures(x) for x in texts], pa.int32())
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("part"), mask, pa.array([hashlib.sha256(x).digest() for x in texts], pa.binary())], names=["doc_id", "part", "mask", "hash"])


def failures(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """part, mask, good and toxic of every document: rows that agree in all and in text and doc_id are one, with their
    number n.

    A text is known by its SHA-256. It fails E unless its row has the smallest doc_id of all rows with that text. That
    row is found by a join on the hash and the doc_id together, so that a text in a third of all rows meets in no task.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"), "text")
    rows = rows.mapInArrow(judge, "doc_id long, part string, mask int, hash binary")
    flags = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    rows = rows.groupBy("doc_id", "hash", "part", "mask").agg(F.count(F.lit(1)).alias("n")).join(flags, "doc_id", "left")
    rows = common.materialise(rows.select("doc_id", "hash", "part", "mask", "n", *(F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic"))))
    least = rows.where("doc_id IS NOT NULL").groupBy("hash").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    seen = rows.join(least, ["hash", "doc_id"], "left")
    again = F.when(F.col("first").isNull() & F.col("doc_id").isNotNull(), CELLS >> 1).otherwise(0)
    return seen.select("part", (F.col("mask") + again).alias("mask"), "good", "toxic", "n")


def parity_sums(failed: DataFrame) -> DataFrame:
    """The 32 signed sums of each part and label (good and toxic, yes or no): sum s counts a document as -1 where its
    mask shares an odd number of bits with s, else as 1."""

    def signed(s: int) -> Column:
        odd = F.bit_count(F.col("mask").bitwiseAND(F.lit(s))).bitwiseAND(F.lit(1))
        return F.sum((1 - 2 * odd) * F.col("n"))

    return failed.groupBy("part", "good", "toxic").agg(F.array(*(signed(s) for s in range(CELLS))).alias("sums"))


def mask_cells(sums: DataFrame) -> DataFrame:
    """The number of documents of each mask in each part: 32 cells (mask, n, good, toxic). The transform of the sums is
    divided by 32, without a rest."""
    sign = lambda m, k: 1 - 2 * F.bit_count(m.bitwiseAND(k)).bitwiseAND(F.lit(1))
    places = F.sequence(F.lit(0), F.lit(CELLS - 1))
    back = F.transform(places, lambda m: F.aggregate(places, F.lit(0).cast("long"), lambda acc, k: acc + F.get("sums", k) * sign(m, k)))
    sums = sums.select("part", "good", "toxic", back.alias("sums"))
    each = sums.select("part", "good", "toxic", F.posexplode("sums").alias("mask", "sum")).withColumn("n", F.expr(f"sum div {CELLS}"))
    one = each.groupBy("part", "mask").agg(F.sum("n").alias("n"), *(F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(c) for c in ("good", "toxic")))
    in_order = F.array_sort(F.collect_list(F.struct("mask", "n", "good", "toxic"))).alias("cells")  # 32 of a part
    return one.groupBy("part").agg(in_order)


def audit(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """What each of the five filters does at each step of each order of them, in each part of the corpus.

    docs: doc_id, text and the column that names the part; labels: doc_id, quality, toxic; other columns are ignored.
    A null text is empty, a null part the empty string. Rows that repeat a doc_id are documents of their own; none is
    a copy of another with the same doc_id, and a null doc_id is neither a copy nor the original of one. A doc_id with
    several labels is good, or toxic, if any says so; one without is neither. Tables without rows give none. Returns
    part, filter_order, step and the counts kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley.
    """
    cells = mask_cells(parity_sums(failures(docs, labels, part)))
    places: dict[tuple[int, int], list[str]] = {}  # a filter and those before it: the orders in which they stand so
    for order in ORDERS:
        for k, letter in enumerate(order):
            places.setdefault((1 << FILTERS.index(letter), sum(1 << FILTERS.index(c) for c in order[:k])), []).append(order)
    every = json.dumps([{"own": own, "prior": prior, "orders": orders} for (own, prior), orders in places.items()])
    every = F.from_json(F.lit(every), "array<struct<own:int,prior:int,orders:array<string>>>")
    at = cells.select("part", "cells", F.explode(every).alias("s")).select("part", "cells", "s.*")

    def total(name: str, counts: Callable[[Column], Column], value: str = "n") -> Column:
        return F.aggregate("cells", F.lit(0).cast("long"), lambda acc, c: acc + F.when(counts(c["mask"]), c[value]).otherwise(F.lit(0))).alias(name)

    fails = lambda mask, which: mask.bitwiseAND(F.col(which)) != 0
    removed = lambda m: fails(m, "own") & ~fails(m, "prior")
    shares = F.array(*(F.lit(len(ORDERS) // f).cast("long") for f in range(1, len(FILTERS) + 1)))
    shapley = F.aggregate("cells", F.lit(0).cast("long"), lambda acc, c: acc + F.when(fails(c["mask"], "own"), c["n"] * F.element_at(shares, F.bit_count(c["mask"]))).otherwise(F.lit(0)))
    counted = at.select(
        "part",
        "orders",
        (F.bit_count("prior") + 1).cast("int").alias("step"),
        total("kept", lambda m: ~fails(m, "own") & ~fails(m, "prior")),
        total("removed", removed),
        total("redundant", lambda m: fails(m, "own") & fails(m, "prior")),
        total("unique_fails", lambda m: m == F.col("own")),
        total("good_lost", removed, "good"),
        total("toxic_lost", removed, "toxic"),
        shapley.alias("shapley"),
    )
    return counted.select("part", F.explode("orders").alias("filter_order"), "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def op12_interaction_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


#: Walks every document through every order, without the cells.
ORACLE_SQL = r"""
WITH letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
orders AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5
), texts AS (
  SELECT doc_id, COALESCE(text, '') AS t, COALESCE(source, '') AS part, regexp_extract_all(COALESCE(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), firsts AS (SELECT t, MIN(doc_id) AS least FROM texts GROUP BY t),
failed AS (
  SELECT doc_id, part,
    CASE WHEN len(w) < 50 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 'B' ELSE '' END
    || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN doc_id > least THEN 'E' ELSE '' END AS fails
  FROM texts JOIN firsts USING (t)
), flags AS (SELECT doc_id, MAX(COALESCE(quality, 0) = 1) AS good, MAX(COALESCE(toxic, 0) = 1) AS toxic FROM labels GROUP BY doc_id),
walked AS (
  SELECT f.part, o.filter_order, s.step, substr(o.filter_order, s.step, 1) AS own, COALESCE(g.good, false) AS good, COALESCE(g.toxic, false) AS toxic, f.fails,
    (CASE WHEN fails = '' THEN NULL ELSE list_min(list_transform(string_split(fails, ''), lambda x: strpos(o.filter_order, x))) END) AS falls
  FROM failed f LEFT JOIN flags g USING (doc_id), orders o, (SELECT unnest(range(1, 6)) AS step) s
), counted AS (
  SELECT part, filter_order, step, own, COUNT(*) FILTER (falls IS NULL OR falls > step) AS kept, COUNT(*) FILTER (falls = step) AS removed,
    COUNT(*) FILTER (contains(fails, own) AND falls < step) AS redundant, COUNT(*) FILTER (fails = own) AS unique_fails,
    COUNT(*) FILTER (falls = step AND good) AS good_lost, COUNT(*) FILTER (falls = step AND toxic) AS toxic_lost
  FROM walked GROUP BY ALL
), shares AS (SELECT part, own, SUM(removed) AS shapley FROM counted GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(shapley AS BIGINT) AS shapley
FROM counted JOIN shares USING (part, own)"""
