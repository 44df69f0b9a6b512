"""Operator 2: benchmark decontamination by SimHash over item-sized windows.

Windows of the size of an item slide over a document word by word. Each window that holds enough shingles of the
benchmark has a 128-bit SimHash; its sixteen blocks of 8 bits look up the items of its size whose block lies within
RADIUS // 16 bits, which finds every item within RADIUS bits (pigeonhole). The weighted Jaccard similarity of
shingle counts then decides. Windows with too few shared shingles for the similarity are not hashed. An item of fewer
words than a shingle is one shingle of its own size.

The benchmark is read in blocks of at most ITEMS items; every block is broadcast and held against all documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import common
from quillspark.llm.kernels import U64, lower_ascii, mix, slices, spread, text_bytes, window_hash, windows, word_hash, words

SHINGLE, SIMILARITY = 5, 0.8
RADIUS, BLOCKS = 39, 16
#: Items of the benchmark that one broadcast holds, and bytes of their text.
ITEMS, ITEM_BYTES = 20_000, 16 << 20
RESULT = "doc_id long, item_id long, similarity double, first_word long, n_words long"


def planes(shingles: np.ndarray) -> np.ndarray:
    """+1 or -1 for each shingle and each of 128 bits."""
    two = np.stack([mix(shingles), mix(shingles ^ U64(0xA5A5A5A55A5A5A5A))], axis=1)
    bits = np.unpackbits(np.ascontiguousarray(two).view(np.uint8), axis=1)
    return bits.astype(np.int16) * 2 - 1


def shingles_of(word: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of each text, which has a shingle for each word but the last size - 1 (one at least,
    if it has words at all), and the number of shingles before each text."""
    n = np.diff(first)
    count = np.where(n == 0, 0, np.maximum(n - size + 1, 1))
    at = spread(first[:-1], count)
    h = np.zeros(len(at), np.uint64)
    width = np.repeat(np.minimum(n, size), count)
    for k in np.unique(width).tolist():
        h[width == k] = window_hash(word, at[width == k], k, 1)
    return h, np.concatenate([[0], np.cumsum(count)])


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low = lower_ascii(raw)
    starts, ends, first = words(low, offsets)
    return (word_hash(low, starts, ends) if len(starts) else np.zeros(0, np.uint64)), first


class Benchmark:
    """Items by shingle, and those of each size by blocks of their SimHash."""

    def __init__(self, ids: list, texts: list[str | None], size: int = SHINGLE) -> None:
        raw, offsets = text_bytes(pa.array(texts, pa.string()))
        word, first = word_hashes(raw, offsets)
        h, cut = shingles_of(word, first, size)
        self.ids, self.size = ids, size
        self.sets = [h[cut[i] : cut[i + 1]] for i in range(len(ids))]
        self.n_words = np.diff(first)
        #: Items of fewer words than a shingle, by their number of words: hash and item.
        self.short = {k: (own := np.flatnonzero(self.n_words == k), h[cut[own]]) for k in range(1, size) if (self.n_words == k).any()}
        long = np.flatnonzero(self.n_words >= size)
        self.known = np.unique(np.concatenate([np.zeros(0, np.uint64), *(self.sets[i] for i in long)]))
        self.prints = np.zeros((len(ids), BLOCKS), np.uint8)
        for i in long:
            self.prints[i] = np.packbits(planes(self.sets[i]).sum(axis=0) > 0)
        near = np.array([sum(1 << b for b in c) for k in range(RADIUS // BLOCKS + 1) for c in combinations(range(8), k)], np.uint8)
        sizes = self.n_words[long] - size + 1
        self.tables = {k: [self.lookup(long[sizes == k], b, near) for b in range(BLOCKS)] for k in np.unique(sizes).tolist()}

    def lookup(self, items: np.ndarray, block: int, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each value of a block, where the items that lie near begin, and these items."""
        value = (self.prints[items, block][:, None] ^ near[None]).ravel()
        item = np.repeat(items, len(near))
        order = np.argsort(value, kind="stable")
        return np.searchsorted(value[order], np.arange(257)), item[order].astype(np.int32)

    def matches(self, h: np.ndarray, similarity: float) -> list[tuple[int, float, int]]:
        """Item, similarity and first shingle of the best window for each item that a text holds."""
        hit = np.zeros(len(h), bool)
        at = np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)
        hit = self.known[at] == h
        if not hit.any():
            return []
        total = np.concatenate([[0], np.cumsum(hit)])
        out: dict[int, tuple[float, int]] = {}
        for length in self.tables:
            size = min(length, len(h))
            least = max(1, int(np.ceil(similarity * (length + size) / (1 + similarity) - 1e-9)))  # shared shingles that a window needs
            start = np.arange(len(h) - size + 1)
            start = start[total[start + size] - total[start] >= least]
            if len(start) == 0:
                continue
            for part in np.split(start, np.flatnonzero(np.diff(start >> 12)) + 1):  # so that long texts take bounded memory
                low = int(part[0])
                sums = np.zeros((int(part[-1]) + size - low + 1, 128), np.int32)
                np.cumsum(planes(h[low : low + len(sums) - 1]), axis=0, out=sums[1:])
                prints = np.packbits(sums[part - low + size] - sums[part - low] > 0, axis=1)
                for w, item in self.within(prints, length):
                    own = weighted(h[part[w] : part[w] + size], self.sets[item])
                    if own >= similarity - 1e-12 and own > out.get(item, (0.0, 0))[0]:
                        out[item] = (own, int(part[w]))
        return [(i, s, p) for i, (s, p) in sorted(out.items())]

    def within(self, prints: np.ndarray, length: int) -> Iterator[tuple[int, int]]:
        """Windows and items of one size whose fingerprints lie within RADIUS bits, by way of the blocks."""
        found = []
        for b, (begin, near) in enumerate(self.tables[length]):
            value = prints[:, b].astype(np.int64)
            n = begin[value + 1] - begin[value]
            found.append(np.repeat(np.arange(len(prints)), n) * np.int64(len(self.ids)) + near[spread(begin[value], n)])
        pairs = np.unique(np.concatenate(found))
        w, item = pairs // len(self.ids), pairs % len(self.ids)
        close = np.bitwise_count(prints[w] ^ self.prints[item]).sum(axis=1) <= RADIUS
        return zip(w[close].tolist(), item[close].tolist(), strict=True)

    def short_matches(self, word: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """Text, item and first word of the first place of each short item in each text."""
        for k, (items, own) in self.short.items():
            at = windows(first, k)
            h = window_hash(word, at, k, 1)
            at, h = at[np.isin(h, own)], h[np.isin(h, own)]
            text = np.searchsorted(first, at, side="right") - 1
            for item, x in zip(items.tolist(), own, strict=True):
                texts, lead = np.unique(text[h == x], return_index=True)
                yield from ((t, item, int(at[h == x][i] - first[t])) for t, i in zip(texts.tolist(), lead.tolist(), strict=True))


def weighted(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two bags of shingles."""
    keys, back = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = np.bincount(back[: len(a)], minlength=len(keys)), np.bincount(back[len(a) :], minlength=len(keys))
    return float(np.minimum(x, y).sum() / np.maximum(x, y).sum())


def item_blocks(benchmark: DataFrame) -> Iterator[pd.DataFrame]:
    """The items in blocks that are small enough to broadcast."""
    held, size = [], 0
    for row in benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text IS NOT NULL").orderBy("item_id").toLocalIterator():
        held.append((row["item_id"], row["text"]))
        size += len(row["text"].encode())
        if len(held) >= ITEMS or size >= ITEM_BYTES:
            yield pd.DataFrame(held, columns=["item_id", "text"])
            held, size = [], 0
    if held:
        yield pd.DataFrame(held, columns=["item_id", "text"])


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, size: int = SHINGLE) -> DataFrame:
    """Items of the benchmark that documents hold.

    docs: doc_id and text; benchmark: item_id and text; other columns are ignored. Words are white-space delimited,
    A-Z in lower case. A text of fewer than `size` words is one shingle, and an item of so few words is held where
    its words stand in a row; null and empty texts hold nothing and are held by nothing. Returns doc_id, item_id, the similarity of the best window (0.8 or more), its first word
    and its number of words, a row for each document row and item; equal windows: the first.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = None
    for block in item_blocks(benchmark):
        shared = spark.sparkContext.broadcast(Benchmark(block["item_id"].tolist(), block["text"].tolist(), size))

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            bench = shared.value
            for batch in (piece for whole in batches for piece in slices(whole, "text")):
                word, first = word_hashes(*text_bytes(batch.column("text")))
                h, cut = shingles_of(word, first, bench.size)
                ids = batch.column("doc_id").to_pylist()
                rows = [(ids[i], bench.ids[item], 1.0, at, int(bench.n_words[item])) for i, item, at in bench.short_matches(word, first)]
                live = np.zeros(0, np.int64)
                if len(h) and len(bench.known):
                    hit = bench.known[np.minimum(np.searchsorted(bench.known, h), len(bench.known) - 1)] == h
                    live = np.flatnonzero(np.diff(np.concatenate([[0], np.cumsum(hit)])[cut]) > 0)
                for i in live.tolist():
                    for item, score, at in bench.matches(h[cut[i] : cut[i + 1]], similarity):
                        rows.append((ids[i], bench.ids[item], score, at, int(min(bench.n_words[item], first[i + 1] - first[i] - at))))
                if rows:
                    kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "item_id", "similarity", "first_word", "n_words"])

        part = docs.mapInArrow(search, RESULT)
        found = part if found is None else found.unionByName(part)
    return spark.createDataFrame([], RESULT) if found is None else found


def brute_force(docs: pd.DataFrame, benchmark: pd.DataFrame, similarity: float = SIMILARITY, size: int = SHINGLE) -> pd.DataFrame:
    """The same pairs from all windows of all documents, without fingerprints, for small tables."""
    from collections import Counter

    def words_of(text: str | None) -> list[bytes]:
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()

    def bag(text: str | None) -> list[tuple]:
        w = words_of(text)
        return [tuple(w[i : i + size]) for i in range(max(len(w) - size + 1, 1))] if w else []

    rows = []
    items = [(i, bag(t)) for i, t in zip(benchmark.item_id, benchmark.text, strict=True)]
    for d, t in zip(docs.doc_id, docs.text, strict=True):
        s, w = bag(t), words_of(t)
        have = set(s)
        for i, want in items:
            if not want or len(want[0]) < size:
                if want and want[0] in {tuple(w[p : p + len(want[0])]) for p in range(len(w))}:
                    rows.append((d, i, 1.0))
                continue
            if have.isdisjoint(want):
                continue
            n, need, best = min(len(want), len(s)), Counter(want), 0.0
            for p in range(len(s) - n + 1):
                own = Counter(s[p : p + n])
                best = max(best, sum((own & need).values()) / sum((own | need).values()))
            if best >= similarity - 1e-12:
                rows.append((d, i, best))
    return pd.DataFrame(rows, columns=["doc_id", "item_id", "similarity"])


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
