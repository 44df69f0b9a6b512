"""Operator 13: periodic runs of words by a suffix automaton.

A run of period q and of max(24, 3 * q) words or more has a window of 16 words that also starts q words further on.
So the runs of a text lie within the stretches of words that repeated windows of 16 cover, each run whole in one of
them; numpy finds these stretches for a batch of texts at once, and the other texts have no run.

Each stretch gets a suffix automaton. From the longest strings up, the end positions of a state join those of its
suffix link, the smaller ordered set into the larger. Two end positions that become neighbours at a distance of no
more than the length of the state are the ends of a square. The state's length is all that the two places share to
the left, so that the seed starts where its run does; a seed that the next word extends leaves the run to the seed
there. What is left are the runs, once those that have a smaller period are gone.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import common
from quillspark.llm.kernels import covered, slices, text_bytes, window_hash, windows, word_hash, words

#: A run has so many words at least, and so many times its period.
LEAST_WORDS, LEAST_TIMES = 24, 3
#: Words of a window that every run repeats: a run of n words repeats each of its first n - q - 15 windows q words on.
WINDOW = 16
#: Places of a block of an ordered set.
BLOCK = 512

Run = tuple[int, int, int]
FOUND = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


class Ends:
    """An ordered set of places in blocks."""

    __slots__ = ("blocks", "tops", "size")

    def __init__(self, place: int) -> None:
        self.blocks, self.tops, self.size = [[place]], [place], 1

    def add(self, place: int) -> tuple[int, int]:
        """Put in a place that is not there; its neighbours (-1: none)."""
        tops, at = self.tops, 0
        if len(tops) > 1:
            at = min(bisect_left(tops, place), len(tops) - 1)
        block = self.blocks[at]
        i = bisect_left(block, place)
        after = block[i] if i < len(block) else -1  # places beyond the last block only
        before = block[i - 1] if i else tops[at - 1] if at else -1
        block.insert(i, place)
        if after < 0:
            tops[at] = place
        self.size += 1
        if len(block) > 2 * BLOCK:
            self.blocks[at : at + 1] = [block[:BLOCK], block[BLOCK:]]
            tops[at : at + 1] = [block[BLOCK - 1], block[-1]]
        return before, after

    def __iter__(self) -> Iterator[int]:
        for block in self.blocks:
            yield from block


def automaton(text: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Length and suffix link of every state, and the state of each prefix."""
    step: list[dict[int, int]] = [{}]
    length, link, prefix = [0], [-1], []
    last = 0
    for i, symbol in enumerate(text):
        now = len(length)
        length.append(i + 1)
        link.append(0)
        step.append({})
        at = last
        while at >= 0 and symbol not in step[at]:
            step[at][symbol] = now
            at = link[at]
        if at >= 0:
            to = step[at][symbol]
            if length[to] == length[at] + 1:
                link[now] = to
            else:
                copy = len(length)
                length.append(length[at] + 1)
                link.append(link[to])
                step.append(dict(step[to]))
                link[to] = link[now] = copy
                while at >= 0 and step[at].get(symbol) == to:
                    step[at][symbol] = copy
                    at = link[at]
        prefix.append(now)
        last = now
    return length, link, prefix


def squares(text: list[int]) -> list[Run]:
    """Every stretch (start, length, period) of the least length that a pair of neighbouring ends seeds and that no
    word beside it extends with that period."""
    n, found = len(text), set()
    length, link, prefix = automaton(text)
    # Strings of fewer words than a window seed no run that is long enough: they gather no ends.
    joins = [s for s in range(1, len(length)) if length[link[s]] >= WINDOW]
    joined = set(joins)
    joined.update(link[s] for s in joins)
    ends: list[Ends | None] = [None] * len(length)
    for i, state in enumerate(prefix):
        if state in joined:
            ends[state] = Ends(i)

    def seed(a: int, b: int, shared: int) -> None:
        period = b - a
        size = shared + period
        if period <= shared and size >= LEAST_WORDS and size >= LEAST_TIMES * period and (b + 1 == n or text[b + 1] != text[b + 1 - period]):
            found.add((a - shared + 1, size, period))

    for state in sorted(joins, key=length.__getitem__, reverse=True):
        own, up = ends[state], link[state]
        ends[state] = None
        other = ends[up]
        if other is None:
            ends[up] = own
            continue
        large, small = (own, other) if own.size >= other.size else (other, own)
        shared = length[up]
        for place in small:
            before, after = large.add(place)
            if before >= 0:
                seed(before, place, shared)
            if after >= 0:
                seed(place, after, shared)
        ends[up] = large
    return sorted(found)


def smallest_periods(found: list[Run]) -> list[Run]:
    """Those without the stretches that have a smaller period: a run of a divisor of their period holds them."""
    by_period: dict[int, list[Run]] = {}
    for run in found:  # sorted; runs of one period share less than it, so that their ends are sorted too
        by_period.setdefault(run[2], []).append(run)

    def held(start: int, size: int, q: int) -> bool:
        runs = by_period.get(q, [])
        at = bisect_right(runs, (start, 1 << 62, 0)) - 1
        return at >= 0 and runs[at][0] + runs[at][1] >= start + size

    def proper_divisors(period: int) -> set[int]:
        return {d for k in range(1, isqrt(period) + 1) if period % k == 0 for d in (k, period // k)} - {period}

    return [(start, size, period) for start, size, period in found if not any(held(start, size, q) for q in proper_divisors(period))]


def runs_of(ids: np.ndarray, first: int, last: int) -> list[Run]:
    """The runs among the words first to last of a text, ids being the identity of each of those words."""
    return [(first + s, n, q) for s, n, q in smallest_periods(squares(ids.tolist()))]


def stretches(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, dict[int, list[tuple[int, int]]]]:
    """Hash of every word, words before each text, and for texts with repeated windows the stretches that they cover."""
    starts, ends, first = words(raw, offsets)
    hashes = word_hash(raw, starts, ends)
    at = windows(first, WINDOW)
    of = np.searchsorted(first, at, side="right") - 1
    seen = window_hash(hashes, at, WINDOW)
    order = np.lexsort((seen, of))
    same = (seen[order][1:] == seen[order][:-1]) & (of[order][1:] == of[order][:-1])
    again = np.zeros(len(at), bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    held = covered(at[again], WINDOW, len(starts))
    edge = np.diff(np.concatenate([[0], held.astype(np.int8), [0]]))
    opens, closes = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    out: dict[int, list[tuple[int, int]]] = {}
    for a, b in zip(opens.tolist(), closes.tolist(), strict=True):
        while a < b:  # stretches that meet where one text ends and the next begins are cut there
            text = int(np.searchsorted(first, a, side="right")) - 1
            end = min(b, int(first[text + 1]))
            if end - a >= LEAST_WORDS:
                out.setdefault(text, []).append((a - int(first[text]), end - int(first[text])))
            a = end
    return hashes, first, out


def collapse(tokens: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words but those that any run holds after its first period."""
    if not runs:
        return tokens
    starts = np.array([s + q for s, _, q in runs], np.int64)
    drop = covered(starts, np.array([n - q for _, n, q in runs], np.int64), len(tokens))
    return [w for w, gone in zip(tokens, drop.tolist(), strict=True) if not gone]


def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id and text to FOUND, a piece of a batch at a time."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    for piece in (p for batch in batches for p in slices(batch, "text")):
        _, _, repeated = stretches(*text_bytes(piece.column("text")))
        runs, kept, n_words = [], [], []
        for i, text in enumerate(piece.column("text").cast(pa.large_binary()).to_pylist()):
            tokens = (text or b"").split()  # at ASCII white space
            n_words.append(len(tokens))
            own: list[Run] = []
            for a, b in repeated.get(i, ()):
                same: dict[bytes, int] = {}
                own += runs_of(np.array([same.setdefault(w, len(same)) for w in tokens[a:b]]), a, b)
            own.sort(key=lambda r: (r[0], r[2]))
            runs.append([{"start": s, "length": n, "period": q} for s, n, q in own])
            kept.append(b" ".join(collapse(tokens, own)).decode())
        yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(runs, kind), pa.array(kept, pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])


def periodic_runs(docs: DataFrame) -> DataFrame:
    """The periodic runs of words of every document.

    docs: doc_id and text; other columns are ignored. Words are runs of `[^\\x20\\x09-\\x0D]`, numbered from 0. A run
    is a stretch of consecutive words with smallest period q, of max(24, 3 * q) words or more, that no word beside it
    extends. A null or empty text has no words and no runs; rows that share a doc_id are texts of their own; an empty
    table gives none. Returns for each row doc_id, n_words, runs (start, length, period) by start, then period, and
    collapsed, the words without those that any run holds after its first period, joined by a space.

    No row leaves its partition. A task holds about 2 MB of texts, or one longer text, and some 500 bytes for each
    word of the repeated stretch that it works on.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(find, FOUND)


def longest_for_period(runs: Column) -> Column:
    """The run of greatest length / period, as an exact fraction; ties go to the smallest start, then period."""
    better = lambda x, y: (x["length"] * y["period"] > y["length"] * x["period"]) | ((x["length"] * y["period"] == y["length"] * x["period"]) & (F.struct(x["start"], x["period"]) < F.struct(y["start"], y["period"])))
    return F.aggregate(F.slice(runs, 2, F.greatest(F.size(runs), F.lit(1))), F.get(runs, F.lit(0)), lambda best, x: F.when(better(x, best), x).otherwise(best))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """The texts that the query is asked about: with h the CRC-32 of the doc_id in decimal digits and g = h div 10,
    the words of a tenth of the documents (h mod 10 = 0) repeat with a period p from word a on."""
    tokens = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.crc32(F.encode(F.col("doc_id").cast("long").cast("string"), "UTF-8")).alias("h"))
    turn = F.col("h") % 10 == 0
    rows = rows.withColumn("w", F.when(turn, tokens)).withColumn("n", F.size("w").cast("long"))
    rows = rows.withColumn("g", F.floor(F.col("h") / 10).cast("long")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    rows = rows.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)).cast("long"))
    place = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p"))
    changed = F.array_join(F.transform("w", lambda w, i: F.get("w", place(i).cast("int"))), " ")
    return rows.select("doc_id", F.when(F.col("a").isNotNull(), changed).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(with_planted_runs(common.documents(spark, sf_dir)))
    best = found.withColumn("best", longest_for_period(F.col("runs")))
    line = lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    return best.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def brute_runs(tokens: list) -> list[Run]:
    """All runs by comparing the words of every period, for short texts."""
    n, out = len(tokens), []
    for q in range(1, n // LEAST_TIMES + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and tokens[j] == tokens[j + q]:
                j += 1
            size = j - i + q
            if size >= max(LEAST_WORDS, LEAST_TIMES * q) and j > i:
                piece = tokens[i : i + size]
                if not any(piece[k:] == piece[:-k] for k in range(1, q)):
                    out.append((i, size, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_force(docs: pd.DataFrame) -> pd.DataFrame:
    """The query's result, for small tables: the planted runs too."""
    rows = []
    for doc_id, text in zip(docs.doc_id, docs.text, strict=True):
        w = (text or "").encode().split()
        h = zlib.crc32(str(doc_id).encode())
        g, n = h // 10, len(w)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = brute_runs(w)
        dropped = {i for s, size, q in runs for i in range(s + q, s + size)}
        best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        rows.append((doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha("".join(f"{s},{size},{q}\n" for s, size, q in runs).encode()), sha(b" ".join(x for i, x in enumerate(w) if i not in dropped))))
    columns = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    return pd.DataFrame(rows, columns=columns).astype({c: "Int64" for c in columns[2:6]})
