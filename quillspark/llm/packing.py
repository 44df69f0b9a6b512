"""Operator 8: best-fit decreasing packing of documents into sequences of bounded length.

Best-fit decreasing depends on the lengths alone, so it runs over the histogram of lengths: all pieces of one
length that the rule sends to bins of one remaining capacity move together. The plan is as large as the number
of lengths and capacities, whatever the number of documents; a segment tree over the remaining capacities
finds the tightest open bins. The pieces are then numbered within their length and look their place up.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.llm import common
from quillspark.llm.kernels import slices, spread, text_bytes
from quillspark.llm.tokens import encoder, vocabulary

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class CapacityTree:
    """Segment tree over remaining capacities 0..size; a leaf counts the open bins with that much room."""

    def __init__(self, size: int) -> None:
        self.width = 1 << size.bit_length()
        self.count = [0] * (2 * self.width)

    def add(self, room: int, n: int) -> None:
        at = room + self.width
        while at:
            self.count[at] += n
            at //= 2

    def tightest(self, need: int) -> int | None:
        """The least room of at least `need` that an open bin has."""
        at = need + self.width
        if self.count[at]:
            return need
        while at > 1:
            if at % 2 == 0 and self.count[at + 1]:
                at += 1
                while at < self.width:
                    at = 2 * at if self.count[2 * at] else 2 * at + 1
                return at - self.width
            at //= 2
        return None


def best_fit_plan(histogram: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """Best-fit decreasing over {length: pieces}. Rows (length, first rank, pieces, pieces per bin, first bin,
    offset): the piece of rank first + j goes to bin first bin + j // per, at offset + (j % per) * length."""
    tree, pools, plan, bins = CapacityTree(capacity), {}, [], 0
    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            room = tree.tightest(length)
            if room is None:  # all further pieces of this length open bins of their own
                room, first, have = capacity, bins, -(-left // (capacity // length))
                bins += have
            else:
                first, have = pools[room].popleft()
                tree.add(room, -have)
            per = room // length
            full = min(have, left // per)
            rest = [(full, per)] if full else []
            if full < have and left - full * per:  # one more bin takes the last pieces of this length
                rest.append((1, left - full * per))
            used = 0
            for n, each in rest:
                plan.append((length, rank, n * each, each, first + used, capacity - room))
                rank, left, used = rank + n * each, left - n * each, used + n
                pools.setdefault(room - each * length, deque()).append((first + used - n, n))
                tree.add(room - each * length, n)
            if used < have:
                pools[room].appendleft((first + used, have - used))
                tree.add(room, have - used)
    return np.array(plan, np.int64).reshape(-1, 6), bins


def token_pieces(docs: DataFrame, vocab: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Pieces of at most `capacity` ids of every document (null text: empty, which is the end id alone)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocab)
        for batch in (piece for whole in batches for piece in slices(whole, "text")):
            raw, offsets = text_bytes(batch.column("text"))
            ids, first = enc.encode(raw, offsets)
            n = batch.num_rows
            ids = np.insert(ids, first[1:], end_id)
            bounds = first + np.arange(n + 1)
            size = np.diff(bounds)
            count = -(-size // capacity)
            piece = spread(np.zeros(n, np.int64), count)
            start = piece * capacity
            length = np.minimum(np.repeat(size, count) - start, capacity)
            at = 4 * (np.repeat(bounds[:-1], count) + start)
            data = memoryview(np.ascontiguousarray(ids.astype("<u4"))).cast("B")
            crc = np.fromiter((zlib.crc32(data[a:b]) for a, b in zip(at.tolist(), (at + 4 * length).tolist(), strict=True)), np.int64, len(at))
            doc = batch.column("doc_id").take(pa.array(np.repeat(np.arange(n), count)))
            yield pa.RecordBatch.from_arrays([doc, pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, PIECES)


def ranks(pieces: DataFrame, salts: int) -> DataFrame:
    """Number the pieces of each length from 0: columns piece (a struct with doc_id and piece), length, rank. Each
    length is dealt over `salts` groups, so that a length that most pieces have is numbered in parallel."""
    dealt = pieces.withColumn("salt", common.batch_key(salts, "row.doc_id", "row.piece", "row.ids_crc32"))
    sizes = dealt.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    ahead = sizes.select("length", "salt", (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("ahead"))
    numbered = dealt.withColumn("own", F.row_number().over(Window.partitionBy("length", "salt").orderBy("row.doc_id", "row.piece")) - 1)
    return numbered.join(ahead, ["length", "salt"]).select("row", "length", (F.col("own") + F.col("ahead")).alias("rank"))


def pack(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """Add sequence_id and offset to pieces with a length of 1 to `capacity` (columns of `PIECES`); other columns stay."""
    pieces = common.materialise(pieces)
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per length
    plan, _ = best_fit_plan(histogram, capacity)
    salts = max(1, sum(histogram.values()) // 50_000)
    shared = pieces.sparkSession.sparkContext.broadcast(plan[np.lexsort((plan[:, 1], plan[:, 0]))])
    names = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    ranked = ranks(pieces.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), "length"), salts)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = shared.value
        step = int(plan[:, 1].max(initial=0)) + 1
        keys = plan[:, 0] * step + plan[:, 1]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            move = plan[np.searchsorted(keys, length * step + np.minimum(rank, step - 1), side="right") - 1]
            j = rank - move[:, 1]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(move[:, 4] + j // move[:, 3]), pa.array(move[:, 5] + j % move[:, 3] * length)], names=["row", "sequence_id", "offset"])

    placed = ranked.mapInArrow(place, f"row {ranked.schema['row'].dataType.simpleString()}, sequence_id long, offset long")
    return placed.select("row.*", "sequence_id", "offset")


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack(token_pieces(common.documents(spark, sf_dir), vocabulary()))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
