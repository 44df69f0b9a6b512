"""Operator 1: remove word windows that occur more than once, behind a count-min prefilter.

1. Every task counts its windows in a count-min sketch of two rows with counters that stop at 2; the partial
   sketches are summed by chunk of counters. A sum never falls below the true count, so that a window whose
   estimate is 1 occurs once.
2. Windows with an estimate of 2 or more are grouped exactly, by 96-bit fingerprints. A batch of documents sends
   each distinct fingerprint once to the block that owns it, packed with its others, so that a passage in a third
   of all documents is no hot key; the block answers with one bit per fingerprint.
3. Each batch of documents marks the words that repeated windows cover.

The sketch is broadcast as one bit per counter ("2 or more"), at most MAX_COUNTERS bits a row whatever the input.
Beyond the input that it is sized for it lets more windows through to step 2, which stays exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import compress

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import common
from quillspark.llm.kernels import U64, covered, mix, slices, text_bytes, window_hash, windows, word_hash, words

#: Counters a row of the sketch has at most: 2**28 bits are 32 MB.
MAX_COUNTERS = 1 << 28
ROWS = 2
CHUNK_BITS = 22
SALT = (0x9FB21C651E98DF25, 0xC2B2AE3D27D4EB4F)
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def fingerprints(raw: np.ndarray, offsets: np.ndarray, size: int, both: bool) -> tuple[np.ndarray, ...]:
    """Bounds of words, words before each text, first word of every window, and its hashes."""
    starts, ends, first = words(raw, offsets)
    at = windows(first, size)
    hashes = [window_hash(word_hash(raw, starts, ends, k), at, size, k) if len(at) else np.zeros(0, np.uint64) for k in range(1 + both)]
    return starts, ends, first, at, *hashes


def counter(hashes: np.ndarray, row: int, bits: int) -> np.ndarray:
    return (mix(hashes ^ U64(SALT[row])) >> U64(64 - bits)).astype(np.uint32)


def sketch(docs: DataFrame, hasher: Callable[[np.ndarray, np.ndarray], np.ndarray], bits: int) -> dict[tuple[int, int], bytes]:
    """The counters that reach 2, as packed bits by (row, chunk). hasher: hashes of what is counted in a batch."""
    chunk_bits = min(bits, CHUNK_BITS)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[list[np.ndarray]] = [[] for _ in range(ROWS)]
        for batch in (piece for whole in batches for piece in slices(whole, "text")):
            h = hasher(*text_bytes(batch.column("text")))
            for row in range(ROWS):
                seen[row].append(counter(h, row, bits))
        for row in range(ROWS):
            cells = np.sort(np.concatenate([np.zeros(0, np.uint32), *seen[row]]))
            seen[row] = []
            again = np.zeros(len(cells), bool)
            again[1:] = cells[1:] == cells[:-1]
            lead = np.ones(len(cells), bool)
            lead[1:] = ~again[1:]
            for once, values in ((True, cells[lead]), (False, np.unique(cells[again]))):
                chunks, low = values >> np.uint32(chunk_bits), values & np.uint32((1 << chunk_bits) - 1)
                edges = np.flatnonzero(np.diff(chunks, prepend=-1, append=-1 if len(chunks) else 0)) if len(chunks) else []
                for a, b in zip(edges[:-1], edges[1:], strict=True):
                    yield pa.RecordBatch.from_pydict({"row": [row], "chunk": [int(chunks[a])], "once": [once], "cells": [pack_cells(low[a:b])]}, schema=partial_schema)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, one, two = None, None, None
        for batch in batches:
            for row, chunk, once, cells in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if (row, chunk) != key:
                    if key is not None:
                        yield merged(key, two)
                    key, one, two = (row, chunk), np.zeros(1 << chunk_bits, bool), np.zeros(1 << chunk_bits, bool)
                at = unpack_cells(cells)
                if once:
                    two[at] |= one[at]
                    one[at] = True
                else:
                    two[at] = True
        if key is not None:
            yield merged(key, two)

    partials = docs.select("text").mapInArrow(partial, "row int, chunk int, once boolean, cells binary")
    sums = partials.repartition("row", "chunk").sortWithinPartitions("row", "chunk").mapInArrow(merge, "row int, chunk int, bits binary")
    return {(r["row"], r["chunk"]): bytes(r["bits"]) for r in sums.toLocalIterator(prefetchPartitions=True)}  # MAX_COUNTERS bits a row at most


partial_schema = pa.schema([("row", pa.int32()), ("chunk", pa.int32()), ("once", pa.bool_()), ("cells", pa.binary())])


def pack_cells(low: np.ndarray) -> bytes:
    """Sorted places below 2**22: how many share each upper part, then the lower 16 bits of each."""
    return np.bincount(low >> np.uint32(16), minlength=64).astype("<u4").tobytes() + low.astype("<u2").tobytes()


def unpack_cells(data: bytes) -> np.ndarray:
    upper = np.frombuffer(data, "<u4", 64)
    return np.repeat(np.arange(64, dtype=np.uint32) << np.uint32(16), upper) | np.frombuffer(data, "<u2", offset=256)


def merged(key: tuple[int, int], two: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"row": [key[0]], "chunk": [key[1]], "bits": [np.packbits(two).tobytes()]}, schema=pa.schema([("row", pa.int32()), ("chunk", pa.int32()), ("bits", pa.binary())]))


class Estimate:
    """Looks estimates up in the merged sketch."""

    def __init__(self, chunks: dict[tuple[int, int], bytes], bits: int) -> None:
        self.bits, width = bits, 1 << min(bits, CHUNK_BITS)
        self.rows = []
        for row in range(ROWS):
            table = np.zeros((1 << bits) // 8 or 1, np.uint8)
            for (r, chunk), data in chunks.items():
                if r == row:
                    table[chunk * width // 8 : chunk * width // 8 + len(data)] = np.frombuffer(data, np.uint8)
            self.rows.append(table)

    def repeated(self, hashes: np.ndarray) -> np.ndarray:
        found = np.ones(len(hashes), bool)
        for row, table in enumerate(self.rows):
            live = np.flatnonzero(found)
            at = counter(hashes[live], row, self.bits)
            found[live] = (table[at >> np.uint32(3)] >> (np.uint8(7) - (at & np.uint32(7)).astype(np.uint8))) & 1 == 1
        return found


def in_order(table: pa.Table) -> pa.Table:
    """Rows of a batch in an order that does not depend on how they arrived."""
    return table.sort_by([("doc_id", "ascending"), ("text", "ascending")]) if table.num_rows else table


def candidates(table: pa.Table, size: int, estimate: Estimate) -> tuple:
    """Words and windows of a batch; of windows that the sketch deems repeated the distinct fingerprints (sorted),
    whether each occurs twice here, and the place of each window's fingerprint among them."""
    raw, offsets = text_bytes(table.column("text"))
    starts, ends, first, at, h, g = fingerprints(raw, offsets, size, True)
    keep = estimate.repeated(h)
    at, h, g = at[keep], h[keep], (g[keep] >> U64(32)).astype(np.uint32)
    pair = np.empty(len(h), [("h", "<u8"), ("g", "<u4")])
    order = np.lexsort((g, h))
    pair["h"], pair["g"] = h[order], g[order]
    new = np.ones(len(pair), bool)
    new[1:] = (pair["h"][1:] != pair["h"][:-1]) | (pair["g"][1:] != pair["g"][:-1])
    group = np.empty(len(pair), np.int64)
    group[order] = np.cumsum(new) - 1
    return raw, offsets, starts, ends, first, at, pair[new], np.bincount(group, minlength=int(new.sum())) > 1, group


def blocks_of(keys: np.ndarray, n_blocks: int) -> np.ndarray:
    """First fingerprint of each block; blocks are equal ranges of the sorted first hash."""
    limits = np.array([(i << 64) // n_blocks for i in range(n_blocks)], np.uint64)
    return np.append(np.searchsorted(keys["h"], limits), len(keys))


def repeats(docs: DataFrame, size: int = 35) -> DataFrame:
    """Remove every word that a window of `size` words covers whose word sequence starts anywhere else.

    docs: doc_id and text; other columns are ignored. Words are runs of `[^\\x20\\x09-\\x0D]`. A null or empty
    text has no words; a text shorter than a window keeps all. Rows that share a doc_id are texts of their own.
    Returns doc_id, n_words, n_removed and the SHA-256 of the kept words joined by a space, a row for each row.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    _, n_bytes = common.text_volume(docs)
    n_windows = max(1, n_bytes // 6)
    bits = min(max(10, (2 * n_windows - 1).bit_length()), MAX_COUNTERS.bit_length() - 1)
    n_batches, n_blocks = common.batches_for(n_bytes, common.batch_bytes(n_bytes)), max(1, n_windows // 1_000_000)
    shared = spark.sparkContext.broadcast(Estimate(sketch(docs, lambda raw, offsets: fingerprints(raw, offsets, size, False)[-1], bits), bits))
    batched = docs.withColumn("batch", common.batch_key(n_batches, "doc_id", "text"))

    def send(key: tuple, table: pa.Table) -> pa.Table:
        keys, twice = candidates(in_order(table), size, shared.value)[6:8]
        edges = blocks_of(keys, n_blocks)
        used = np.flatnonzero(np.diff(edges))
        return pa.table({
            "batch": pa.array(np.full(len(used), key[0].as_py(), np.int64)), "block": pa.array(used),
            "keys": pa.array([keys[edges[i] : edges[i + 1]].tobytes() for i in used], pa.binary()),
            "twice": pa.array([np.packbits(twice[edges[i] : edges[i + 1]]).tobytes() for i in used], pa.binary()),
        })

    def answer(table: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x, [("h", "<u8"), ("g", "<u4")]) for x in table.column("keys").to_pylist()]
        flags = [np.unpackbits(np.frombuffer(x, np.uint8), count=len(p)).astype(bool) for x, p in zip(table.column("twice").to_pylist(), parts, strict=True)]
        pair, found = np.concatenate(parts), np.concatenate(flags)
        order = np.lexsort((pair["g"], pair["h"]))
        same = (pair["h"][order][1:] == pair["h"][order][:-1]) & (pair["g"][order][1:] == pair["g"][order][:-1])
        group = np.concatenate([[0], np.cumsum(~same)])
        many = np.bincount(group) > 1
        many[group[found[order]]] = True
        found[order] = many[group]
        cuts = np.cumsum([len(p) for p in parts])[:-1]
        return pa.table({"batch": table.column("batch"), "block": table.column("block"), "found": pa.array([np.packbits(x).tobytes() for x in np.split(found, cuts)], pa.binary())})

    def finish(table: pa.Table, answers: pa.Table) -> pa.Table:
        table = in_order(table)
        raw, offsets, starts, _, first, at, keys, _, group = candidates(table, size, shared.value)
        edges = blocks_of(keys, n_blocks)
        repeated = np.zeros(len(keys), bool)
        for block, bits in zip(answers.column("block").to_pylist(), answers.column("found").to_pylist(), strict=True):
            a, b = edges[block], edges[block + 1]
            repeated[a:b] = np.unpackbits(np.frombuffer(bits, np.uint8), count=b - a)
        gone = covered(at[repeated[group]], size, len(starts))
        n_words = np.diff(first)
        total = np.concatenate([[0], np.cumsum(gone)])
        removed = total[first[1:]] - total[first[:-1]]
        data, digests = raw.tobytes(), []
        for i, n in enumerate(removed.tolist()):
            kept = data[offsets[i] : offsets[i + 1]].split()
            if n:
                kept = compress(kept, (~gone[first[i] : first[i + 1]]).tolist())
            digests.append(hashlib.sha256(b" ".join(kept)).hexdigest())
        return pa.table({"doc_id": table.column("doc_id"), "n_words": pa.array(n_words), "n_removed": pa.array(removed), "kept_sha256": pa.array(digests, pa.string())})

    sent = batched.groupBy("batch").applyInArrow(send, "batch long, block long, keys binary, twice binary")
    answers = sent.groupBy("block").applyInArrow(answer, "batch long, block long, found binary")
    return batched.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(finish, RESULT)


def brute_force(docs: pd.DataFrame, size: int = 35) -> pd.DataFrame:
    """The same result by a dictionary of word tuples, for small tables."""
    texts = [(d, (t or "").encode().split()) for d, t in zip(docs.doc_id, docs.text, strict=True)]
    count: dict[tuple, int] = {}
    for _, w in texts:
        for i in range(len(w) - size + 1):
            count[tuple(w[i : i + size])] = count.get(tuple(w[i : i + size]), 0) + 1
    rows = []
    for d, w in texts:
        gone = [False] * len(w)
        for i in range(len(w) - size + 1):
            if count[tuple(w[i : i + size])] > 1:
                gone[i : i + size] = [True] * size
        rows.append((d, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest()))
    return pd.DataFrame(rows, columns=["doc_id", "n_words", "n_removed", "kept_sha256"])


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(common.documents(spark, sf_dir))
