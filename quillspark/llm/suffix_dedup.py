"""Operator 4: remove byte strings that an earlier document holds too, by two-stage suffix sorting.

Strings of 50 bytes meet by an anchor: of the 27 strings of 24 bytes in a window, the one with the least hash.
Equal windows have equal anchors, wherever they stand.

1. Each batch of documents sends the hashes of its anchors to blocks; a block answers which of them two or more
   documents hold. All other anchors are done with: no window over them occurs twice.
2. For the anchors that are left, a batch sends the stretch of text that holds the windows of the anchor, each
   distinct stretch once, to the block of the anchor.
3. A block sorts the suffixes of its distinct stretches in two stages: only suffixes smaller than their successor
   are sorted directly; the others follow from a scan over the buckets of first bytes. Neighbours that share 50
   bytes form a group, whose smallest doc_id owns the string. The block answers with the windows of each batch
   that an earlier document owns.
4. Each batch removes the bytes that those windows cover.

A passage that a third of all documents share reaches a block once per batch and is sorted once.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import common
from quillspark.llm.kernels import U64, covered, load8, mix, spread, text_bytes
from quillspark.llm.substring_dedup import in_order

ANCHOR = 24
#: Low bits of an anchor's hash that hold its place within a segment of windows.
PLACE_BITS = 24
SEGMENT = 1 << 22
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
STRETCHES = "batch long, block long, keys binary, lengths binary, data binary, least binary, stretch binary, starts binary, counts binary, docs binary"


def anchors(raw: np.ndarray, offsets: np.ndarray, size: int, segment: int = SEGMENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: first window, number of windows, hash of the anchor.

    The place of an anchor takes the low bits of its hash, so that places are counted within segments of windows;
    segments overlap by the bytes of a window. A run over the edge of two segments is two runs with the same hash."""
    n = len(raw)
    none = np.zeros(0, np.int64)
    parts = [(none, none, np.zeros(0, np.uint64))]
    for at in range(0, n - size + 1, segment):
        lead, count, h = segment_anchors(raw[at : at + segment + size - 1], offsets - at, size)
        parts.append((lead + at, count, h))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def segment_anchors(raw: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The runs of a segment; offsets count from its start and may lie outside of it."""
    n, span = len(raw), size - ANCHOR + 1
    m = n - ANCHOR + 1
    h = load8(raw, m) * U64(0x9E3779B97F4A7C15)
    h ^= (h >> U64(29)) ^ (load8(raw, m, 8) * U64(0xD6E8FEB86659FD93))
    h ^= (h >> U64(32)) ^ (load8(raw, m, 16) * U64(0xC2B2AE3D27D4EB4F))
    h = mix(h)
    place = U64((1 << PLACE_BITS) - 1)
    least = (h & ~place) | np.arange(m, dtype=np.uint64)
    done = 1
    while 2 * done <= span:
        least = np.minimum(least[: len(least) - done], least[done:])
        done *= 2
    least = np.minimum(least[: n - size + 1], least[span - done : span - done + n - size + 1])
    inside = np.clip(offsets, 0, n)  # a text that goes on after the segment has all its windows that start here within it
    left = np.repeat(inside[1:], np.diff(inside))[: n - size + 1] - np.arange(n - size + 1)
    valid = np.flatnonzero(left >= size)
    anchor = (least[valid] & place).astype(np.int64)
    lead = np.flatnonzero(np.diff(anchor, prepend=-1) != 0)
    return valid[lead], np.diff(np.append(lead, len(valid))), mix(h[anchor[lead]])  # mixed again: least hashes are small, and blocks are ranges


def two_stage_suffixes(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of a text in order of their first `depth` bytes at least; 0 separates stretches.

    Suffixes smaller than their successor are sorted directly, by words of 8 bytes and only as far as they tie.
    The rest follow: bucket by bucket, in order, each sorted suffix places the one that starts a byte before it,
    if larger than its successor, next in the bucket of its first byte.
    """
    n = len(text)
    if n == 0:
        return np.zeros(0, np.int64)
    padded = np.concatenate([text, np.zeros(depth + 16, np.uint8)])
    change = np.flatnonzero(np.append(text[1:] != text[:-1], True))
    until = change[np.searchsorted(change, np.arange(n))]  # last place of the run of equal bytes
    smaller = text < padded[until + 1]
    direct = sort_directly(padded, np.flatnonzero(smaller), depth)
    own = np.searchsorted(text[direct], np.arange(257))
    buckets: list[list[np.ndarray]] = [[] for _ in range(256)]
    out: list[np.ndarray] = []

    def induce(order: np.ndarray) -> None:
        before = order[order > 0] - 1
        before = before[~smaller[before]]
        first = text[before]
        by = np.argsort(first, kind="stable")
        before, first = before[by], first[by]
        edges = np.flatnonzero(np.diff(first)) + 1
        for part in np.split(before, edges):
            if len(part):
                buckets[text[part[0]]].append(part)

    induce(np.array([n]))  # the empty suffix is the smallest
    for c in range(256):
        done = 0
        while done < len(buckets[c]):  # larger suffixes of this bucket, those that they place here included
            part = np.concatenate(buckets[c][done:])
            done = len(buckets[c])
            out.append(part)
            induce(part)
        part = direct[own[c] : own[c + 1]]
        out.append(part)
        induce(part)
    return np.concatenate(out)


def sort_directly(padded: np.ndarray, places: np.ndarray, depth: int) -> np.ndarray:
    """Places in order of the `depth` bytes from each on."""
    order, tied, group = places, np.arange(len(places)), np.zeros(len(places), np.int64)
    for at in range(0, depth, 8):
        if len(tied) == 0:
            break
        key = load8(padded, len(padded) - 8 - at, at, ">u8")[order[tied]].astype(np.uint64)
        by = np.argsort(key, kind="stable") if at == 0 else np.lexsort((key, group))
        key, group = key[by], group[by]
        order[tied] = order[tied][by]
        new = np.ones(len(tied), bool)
        new[1:] = (key[1:] != key[:-1]) | (group[1:] != group[:-1])
        group = np.cumsum(new)
        more = ~(new & np.append(new[1:], True))
        tied, group = tied[more], group[more]
    return order


def common_prefixes(padded: np.ndarray, order: np.ndarray, size: int) -> np.ndarray:
    """Bytes that each suffix shares with the one before it in order, `size` at most: eight bytes a step, the last step
    ends at the first byte that differs."""
    shared, same = np.zeros(len(order), np.int64), np.arange(1, len(order))
    for at in range(0, size, 8):
        word = load8(padded, len(padded) - 8 - at, at)
        apart = word[order[same]] ^ word[order[same - 1]]
        ends = apart != 0
        lowest = apart[ends]
        lowest &= ~lowest + np.uint64(1)
        shared[same[ends]] = at + (np.bitwise_count(lowest - np.uint64(1)) >> 3)
        same = same[~ends]
    shared[same] = size
    return np.minimum(shared, size)


def owners(data: np.ndarray, lengths: np.ndarray, least: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """For stretches laid end to end, each with its smallest doc_id: the smallest doc_id that holds each window,
    window by window, and the number of windows before each stretch."""
    used = np.flatnonzero(np.bincount(data, minlength=256))
    code = np.zeros(256, np.uint8)
    code[used] = np.arange(1, len(used) + 1)  # UTF-8 leaves at least 13 byte values unused
    n = len(lengths)
    first = np.cumsum(lengths) - lengths
    text = np.zeros(len(data) + n, np.uint8)
    text[np.arange(len(data)) + np.repeat(np.arange(n), lengths)] = code[data]
    first = first + np.arange(n)
    order = two_stage_suffixes(text, size)
    windows = lengths - size + 1
    ahead = np.concatenate([[0], np.cumsum(windows)])
    number = np.full(len(text), -1, np.int64)
    number[spread(first, windows)] = np.arange(ahead[-1])
    order = order[number[order] >= 0]
    padded = np.concatenate([text, np.zeros(size + 16, np.uint8)])
    group = np.cumsum(common_prefixes(padded, order, size) < size) - 1
    stretch = np.repeat(np.arange(n), windows)
    doc = least[stretch[number[order]]]
    best = np.minimum.reduceat(doc, np.flatnonzero(np.diff(group, prepend=-1))) if len(group) else doc
    owner = np.empty(len(order), np.int64)
    owner[number[order]] = best[group]
    return owner, ahead


def block_edges(hashes: np.ndarray, n_blocks: int) -> np.ndarray:
    return np.append(np.searchsorted(hashes, np.array([(i << 64) // n_blocks for i in range(n_blocks)], np.uint64)), len(hashes))


def ragged(parts: list[bytes], kind: str) -> tuple[np.ndarray, np.ndarray]:
    arrays = [np.frombuffer(x, kind) for x in parts]
    return np.concatenate([np.zeros(0, kind), *arrays]), np.array([len(x) for x in arrays], np.int64)


def earlier_strings(docs: DataFrame, size: int = 50) -> DataFrame:
    """Remove every byte that a string of `size` bytes covers which also starts in a document of smaller doc_id.

    docs: doc_id and text; other columns are ignored. A null or empty text has no bytes; a text shorter than
    `size` keeps all. Rows that share a doc_id are no earlier than each other; a null doc_id counts as the
    smallest number. Returns a row for each row: doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and
    the SHA-256 of the kept bytes.
    """
    lowest = -(1 << 63)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    _, n_bytes = common.text_volume(docs)
    n_batches, n_blocks = common.batches_for(n_bytes, common.batch_bytes(n_bytes)), common.batches_for(n_bytes, 1 << 22)
    batched = docs.withColumn("batch", common.batch_key(n_batches, "doc_id", "text"))

    def read(table: pa.Table) -> tuple:
        table = in_order(table)
        raw, offsets = text_bytes(table.column("text"))
        start, count, h = anchors(raw, offsets, size)
        doc = table.column("doc_id").combine_chunks().fill_null(lowest).to_numpy()[np.searchsorted(offsets, start, side="right") - 1] if len(start) else start
        distinct, back = np.unique(h, return_inverse=True)
        return table, raw, offsets, start, count, doc, distinct, back

    def send(key: tuple, table: pa.Table) -> pa.Table:
        *_, doc, distinct, back = read(table)
        low, high = np.full(len(distinct), np.iinfo(np.int64).max), np.full(len(distinct), lowest)
        np.minimum.at(low, back, doc)
        np.maximum.at(high, back, doc)
        edges = block_edges(distinct, n_blocks)
        used = np.flatnonzero(np.diff(edges))
        short = (distinct & U64(0xFFFFFFFF)).astype("<u4")  # within a block 32 bits tell anchors apart well enough: a clash costs work only
        return pa.table({
            "batch": pa.array(np.full(len(used), key[0].as_py(), np.int64)), "block": pa.array(used),
            "keys": pa.array([short[edges[i] : edges[i + 1]].tobytes() for i in used], pa.binary()),
            "twice": pa.array([np.packbits((low < high)[edges[i] : edges[i + 1]]).tobytes() for i in used], pa.binary()),
        })

    def answer(table: pa.Table) -> pa.Table:
        keys, n = ragged(table.column("keys").to_pylist(), "<u4")
        found = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=k).astype(bool) for x, k in zip(table.column("twice").to_pylist(), n.tolist(), strict=True)])
        order = np.argsort(keys, kind="stable")
        group = np.concatenate([[0], np.cumsum(keys[order][1:] != keys[order][:-1])])
        many = np.bincount(group) > 1
        many[group[found[order]]] = True
        found[order] = many[group]
        return pa.table({"batch": table.column("batch"), "block": table.column("block"), "found": pa.array([np.packbits(x).tobytes() for x in np.split(found, np.cumsum(n)[:-1])], pa.binary())})

    def stretches(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        _, raw, _, start, count, doc, distinct, back = read(table)
        edges = block_edges(distinct, n_blocks)
        shared = np.zeros(len(distinct), bool)
        for block, bits in zip(answers.column("block").to_pylist(), answers.column("found").to_pylist(), strict=True):
            a, b = edges[block], edges[block + 1]
            shared[a:b] = np.unpackbits(np.frombuffer(bits, np.uint8), count=b - a)
        live = shared[back]
        start, count, doc, h = start[live], count[live], doc[live], distinct[back[live]]
        length = count + size - 1
        whole = [raw[s:e].tobytes() for s, e in zip(start.tolist(), (start + length).tolist(), strict=True)]
        index: dict[bytes, int] = {}
        stretch = np.fromiter((index.setdefault(x, len(index)) for x in whole), np.int64, len(whole))
        least = np.full(len(index), np.iinfo(np.int64).max)
        np.minimum.at(least, stretch, doc)
        lead = np.unique(stretch, return_index=True)[1]
        rows: dict[str, list] = {name: [] for name in ("block", "keys", "lengths", "data", "least", "stretch", "starts", "counts", "docs")}
        order = np.argsort(h, kind="stable")
        cuts = block_edges(h[order], n_blocks)
        for block in np.flatnonzero(np.diff(cuts)):
            own = order[cuts[block] : cuts[block + 1]]
            local, mine = np.unique(stretch[own], return_inverse=True)
            for name, value in (
                ("block", int(block)), ("keys", h[lead[local]].tobytes()), ("lengths", length[lead[local]].astype("<u2").tobytes()), ("data", b"".join([whole[i] for i in lead[local]])), ("least", least[local].tobytes()),
                ("stretch", mine.astype("<u4").tobytes()), ("starts", start[own].astype("<u4").tobytes()), ("counts", count[own].astype("<u2").tobytes()), ("docs", doc[own].tobytes()),
            ):
                rows[name].append(value)
        kinds = {k: pa.binary() for k in rows} | {"block": pa.int64()}
        return pa.table({"batch": pa.array(np.full(len(rows["block"]), key[0].as_py(), np.int64)), **{k: pa.array(v, kinds[k]) for k, v in rows.items()}})

    def sort_block(table: pa.Table) -> pa.Table:
        get = lambda name, kind: ragged(table.column(name).to_pylist(), kind)
        (lengths, n), (least, _) = get("lengths", "<u2"), get("least", "<i8")
        blob = b"".join(table.column("data").to_pylist())
        ends = np.cumsum(lengths.astype(np.int64))
        pieces = [blob[a:b] for a, b in zip((ends - lengths).tolist(), ends.tolist(), strict=True)]
        index: dict[bytes, int] = {}
        distinct = np.fromiter((index.setdefault(x, len(index)) for x in pieces), np.int64, len(pieces))
        first = np.full(len(index), np.iinfo(np.int64).max)
        np.minimum.at(first, distinct, least)
        owner, ahead = owners(np.frombuffer(b"".join(index), np.uint8), np.array([len(x) for x in index], np.int64), first, size)
        (stretch, m), (starts, _), (counts, _), (docs_, _) = get("stretch", "<u4"), get("starts", "<u4"), get("counts", "<u2"), get("docs", "<i8")
        row = np.repeat(np.arange(len(m)), m)
        mine = distinct[stretch + np.repeat(np.cumsum(n) - n, m)]
        counts = counts.astype(np.int64)
        gone = owner[spread(ahead[mine], counts)] < np.repeat(docs_, counts)
        at, row = spread(starts.astype(np.int64), counts)[gone], np.repeat(row, counts)[gone]
        lead = np.ones(len(at), bool)
        lead[1:] = (row[1:] != row[:-1]) | (at[1:] != at[:-1] + 1)
        lead = np.flatnonzero(lead)
        run, at, row = np.diff(np.append(lead, len(at))), at[lead], row[lead]
        edges = np.searchsorted(row, np.arange(len(m) + 1))
        keep = np.flatnonzero(np.diff(edges))
        return pa.table({"batch": table.column("batch").take(pa.array(keep)), "starts": pa.array([at[edges[i] : edges[i + 1]].astype("<u4").tobytes() for i in keep], pa.binary()), "runs": pa.array([run[edges[i] : edges[i + 1]].astype("<u4").tobytes() for i in keep], pa.binary())})

    def finish(table: pa.Table, removed: pa.Table) -> pa.Table:
        table = in_order(table)
        raw, offsets = text_bytes(table.column("text"))
        starts, runs = (ragged(removed.column(c).to_pylist(), "<u4")[0].astype(np.int64) for c in ("starts", "runs"))
        gone = covered(starts, runs + size - 1, len(raw))
        opens = gone.copy()
        opens[1:] &= ~gone[:-1]
        edge = offsets[1:-1]
        edge = edge[edge < len(raw)]
        opens[edge] = gone[edge]
        lost, spans = (np.diff(np.concatenate([[0], np.cumsum(x)])[offsets]) for x in (gone, opens))
        kept = np.ascontiguousarray(raw)
        digests = [hashlib.sha256(kept[a:b][~gone[a:b]] if k else kept[a:b]).hexdigest() for a, b, k in zip(offsets[:-1].tolist(), offsets[1:].tolist(), lost.tolist(), strict=True)]
        return pa.table({"doc_id": table.column("doc_id"), "n_bytes": pa.array(np.diff(offsets)), "n_removed": pa.array(lost), "n_spans": pa.array(spans), "kept_sha256": pa.array(digests, pa.string())})

    groups = batched.groupBy("batch")
    answers = groups.applyInArrow(send, "batch long, block long, keys binary, twice binary").groupBy("block").applyInArrow(answer, "batch long, block long, found binary")
    sent = groups.cogroup(answers.groupBy("batch")).applyInArrow(stretches, STRETCHES)
    removed = sent.groupBy("block").applyInArrow(sort_block, "batch long, starts binary, runs binary")
    return batched.groupBy("batch").cogroup(removed.groupBy("batch")).applyInArrow(finish, RESULT)


def brute_force(docs: pd.DataFrame, size: int = 50) -> pd.DataFrame:
    """The same result by a dictionary of strings, for small tables."""
    texts = sorted((d, (t or "").encode()) for d, t in zip(docs.doc_id, docs.text, strict=True))
    first: dict[bytes, int] = {}
    for d, t in texts:
        for i in range(len(t) - size + 1):
            first.setdefault(t[i : i + size], d)
    rows = []
    for d, t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - size + 1):
            if first[t[i : i + size]] < d:
                gone[i : i + size] = True
        spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(t) else 0
        rows.append((d, len(t), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest()))
    return pd.DataFrame(rows, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return earlier_strings(common.documents(spark, sf_dir))
