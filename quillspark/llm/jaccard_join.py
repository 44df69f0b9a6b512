"""Operator 7: n-gram Jaccard join with count vectors in an R-tree.

1. A document links to another only if enough of its shingles occur elsewhere. A slice of the space of hashes, twice as
   large as the share that may differ, is dealt out by hash and counted: documents of which too many shingles of the
   slice occur once are done with, whatever the size of the input. A count-min sketch over the shingles of the others
   tells which occur in one document only, and drops most of what the slice let through.
2. Equal sets become one node. A node meets others at its prefix: the rarest shingles, one more than it can do
   without. Two linked nodes share one of their prefixes.
3. Where nodes meet, a shingle's nodes are points of an R-tree: tokens hashed into groups, the counts per group
   the coordinates. The sum of coordinate minima bounds the overlap of two nodes, and of a node and a box. A spanning
   forest of the pairs that the bound admits leaves the shingle, fewer rows than nodes; its components over all
   shingles are families. Linked nodes are always of one family.
4. Each set goes to its family once. There an R-tree over the family finds the pairs that the bound admits, those of
   nodes that are not joined yet are verified exactly, and a spanning forest of the links leaves the family. A large
   family is dealt over pairs of blocks.
   So a group of copies never becomes all its pairs, and no link is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import common
from quillspark.llm.kernels import U64, lower_ascii, mix, slices, spread, text_bytes, window_hash, windows, word_hash, words
from quillspark.llm.substring_dedup import MAX_COUNTERS, Estimate, sketch
from quillspark.operators.components import components

GROUPS = 64
#: The largest count of a vector: this many or more.
FULL = 65535
CLASS_BITS = 18
#: Nodes of one shingle, and nodes and shingles of one family, that meet in one task; more are dealt over pairs of blocks.
BLOCK, FAMILY, FAMILY_SHINGLES = 8192, 4096, 1 << 21
LEAF, FAN = 32, 16
#: Vector rows that a task holds before it works on the groups they make up.
HOLD = 8192
#: Shingles of the slice that a task sends at once, and that meet in one part.
SEND, PART = 1 << 21, 1 << 19
#: Bits of the table of sets that may have a link: at most 2**28, 32 MB.
MAX_BITS = 28
SLICE = U64(0xA24BAED4963EE407)
OWNER = np.dtype([("key", "<u4"), ("left", "<u4")])


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of every text end to end, and the number of them before each text."""
    low = lower_ascii(raw)
    starts, ends, first = words(low, offsets)
    word = word_hash(low, starts, ends)
    at, n_words = windows(first, size), np.diff(first)
    h = [window_hash(word, at, size, 1)]
    few = [first[:-1][n_words == k] for k in range(1, size)]
    h += [window_hash(word, x, k, 1) for k, x in enumerate(few, 1)]
    at, h = np.concatenate([at, *few]), np.concatenate(h)
    order = np.argsort(at, kind="stable")
    h, cuts = h[order], np.searchsorted(at[order], first)
    parts = [np.unique(h[a:b]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
    return np.concatenate([np.zeros(0, np.uint64), *parts]), np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int64)


def set_keys(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """32 bits for each set; equal sets have one key, and sets that share one by chance are told apart nowhere."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes)])
    return (mix((total[first[1:]] - total[first[:-1]]) ^ np.diff(first).astype(np.uint64)) >> U64(32)).astype(np.uint32)


class Linkable:
    """Keys of the sets that may have a link, one bit for each range of keys."""

    def __init__(self, chunks: dict[int, bytes], bits: int) -> None:
        self.bits = bits
        self.table = np.frombuffer(b"".join(chunks[i] for i in sorted(chunks)), np.uint8)

    def holds(self, keys: np.ndarray) -> np.ndarray:
        at = keys >> np.uint32(32 - self.bits)
        return (self.table[at >> np.uint32(3)] >> (np.uint8(7) - (at & np.uint32(7)).astype(np.uint8))) & 1 == 1


def linkable(docs: DataFrame, size: int, percent: int, n_rows: int, n_bytes: int) -> Linkable:
    """Sets of which as many shingles occur elsewhere as a link needs, as far as a slice of the hashes tells.

    Of n shingles a link leaves n * (100 - percent) / 100 alone at most, so a set with more lone ones in the slice has
    none. A task sends each shingle of the slice to its part once: with the key of its set, or as known if it met it in
    two sets itself. A part answers with the keys of the sets whose shingle another task has too. Parts compare 32 bits
    of a hash and sets have 32 bits: what is equal by chance lets a set through, and never drops one.
    """
    share = min(100, 2 * (100 - percent))
    last = (share << 64) // 100 - 1
    span = (last >> 32) + 1
    n_parts = max(1, n_bytes * share // 600 // PART)
    owner_bits = max(0, (n_parts // 8).bit_length() - 1)
    bits = min(max(10, owner_bits + 3, (16 * n_rows).bit_length()), MAX_BITS)
    n_owners = 1 << owner_bits
    sent = pa.schema([("part", pa.int32()), ("tokens", pa.binary()), ("keys", pa.binary()), ("known", pa.binary()), ("owner", pa.int32()), ("owners", pa.binary())])
    answered = pa.schema([("owner", pa.int32()), ("hits", pa.binary()), ("owners", pa.binary())])
    table = lambda schema, rows: pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
    owner_edges = np.arange(n_owners + 1, dtype=np.uint64) << U64(32 - owner_bits)

    def send(marks: list[np.ndarray], rows: list[np.ndarray], keys: np.ndarray, needed: np.ndarray) -> Iterator[pa.RecordBatch]:
        m, row = np.concatenate(marks), np.concatenate(rows)
        order = np.argsort(m)
        m, row = m[order], row[order]
        lead = np.ones(len(m), bool)
        lead[1:] = m[1:] != m[:-1]
        alone = lead.copy()
        alone[:-1] &= lead[1:]
        left = np.maximum(needed - np.bincount(row[~alone], minlength=len(keys)), 0)
        known = m[lead & ~alone]
        m, key = m[alone], keys[row[alone]]
        part = lambda x: np.searchsorted((x >> U64(32)) * U64(n_parts) // U64(span), np.arange(n_parts + 1, dtype=np.uint64))
        a, b = part(m), part(known)
        m, known = m.astype("<u4"), known.astype("<u4")
        used = np.flatnonzero((np.diff(a) > 0) | (np.diff(b) > 0)).tolist()
        out = [(i, m[a[i] : a[i + 1]].tobytes(), key[a[i] : a[i + 1]].tobytes(), known[b[i] : b[i + 1]].tobytes(), None, None) for i in used]
        order = np.lexsort((left, keys))
        own = np.empty(len(keys), OWNER)
        own["key"], own["left"] = keys[order], np.minimum(left[order], 0xFFFFFFFF)
        own = own[np.concatenate([[True], own["key"][1:] != own["key"][:-1]])]
        c = np.searchsorted(own["key"].astype(np.uint64), owner_edges)
        out += [(i, None, None, None, i, own[c[i] : c[i + 1]].tobytes()) for i in np.flatnonzero(np.diff(c)).tolist()]
        yield table(sent, out)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks, rows, keys, needed, n, n_sets = [], [], [], [], 0, 0
        for batch in (piece for whole in batches for piece in slices(whole, "text")):
            h, first = shingle_sets(*text_bytes(batch.column("text")), size)
            first = np.concatenate([first[:1], first[1:][np.diff(first) > 0]])
            if len(first) == 1:
                continue
            m = mix(h ^ SLICE)
            inside = np.flatnonzero(m <= U64(last))
            own = np.searchsorted(first, inside, side="right") - 1
            n_set = np.diff(first)
            marks.append(m[inside])
            rows.append(own + n_sets)
            keys.append(set_keys(h, first))
            needed.append(np.bincount(own, minlength=len(n_set)) - (n_set - -(-percent * n_set // 100)))
            n, n_sets = n + len(inside), n_sets + len(n_set)
            if n >= SEND:
                yield from send(marks, rows, np.concatenate(keys), np.concatenate(needed))
                marks, rows, keys, needed, n, n_sets = [], [], [], [], 0, 0
        if keys:
            yield from send(marks, rows, np.concatenate(keys), np.concatenate(needed))

    def meet(tokens: list[bytes], keys: list[bytes], known: list[bytes]) -> Iterator[pa.RecordBatch]:
        lone, key = np.frombuffer(b"".join(tokens), "<u4"), np.frombuffer(b"".join(keys), "<u4")
        t = np.concatenate([lone, np.frombuffer(b"".join(known), "<u4")])
        order = np.argsort(t)
        same = np.diff(t[order]) == 0
        many = np.zeros(len(t), bool)
        many[1:] |= same
        many[:-1] |= same
        at = order[many]
        hits = np.sort(key[at[at < len(lone)]])
        c = np.searchsorted(hits.astype(np.uint64), owner_edges)
        used = np.flatnonzero(np.diff(c)).tolist()
        if used:
            yield table(answered, [(i, hits[c[i] : c[i + 1]].tobytes(), None) for i in used])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, ([], [], [])
        for batch in batches:
            for part, tokens, keys, known, owner, owners in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if owners is not None:
                    yield table(answered, [(owner, None, owners)])
                    continue
                if part != at:
                    if at is not None:
                        yield from meet(*held)
                    at, held = part, ([], [], [])
                for x, y in zip(held, (tokens, keys, known), strict=True):
                    x.append(y)
        if at is not None:
            yield from meet(*held)

    def chunk(owner: int, hits: list[bytes], owners: list[bytes]) -> pa.RecordBatch:
        own, hit = np.frombuffer(b"".join(owners), OWNER), np.sort(np.frombuffer(b"".join(hits), "<u4"))
        n = np.searchsorted(hit, own["key"], side="right") - np.searchsorted(hit, own["key"])
        live = own["key"][n >= own["left"]]
        found = np.zeros(1 << (bits - owner_bits), bool)
        found[(live >> np.uint32(32 - bits)).astype(np.int64) - (owner << (bits - owner_bits))] = True
        return pa.RecordBatch.from_pydict({"owner": pa.array([owner], pa.int32()), "bits": [np.packbits(found).tobytes()]})

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, ([], [])
        for batch in batches:
            for owner, hits, owners in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if owner != at:
                    if at is not None:
                        yield chunk(at, *held)
                    at, held = owner, ([], [])
                held[0].append(hits or b"")
                held[1].append(owners or b"")
        if at is not None:
            yield chunk(at, *held)

    parts = docs.select("text").mapInArrow(partial, "part int, tokens binary, keys binary, known binary, owner int, owners binary")
    met = parts.repartition("part").sortWithinPartitions("part").mapInArrow(merge, "owner int, hits binary, owners binary")
    chunks = met.repartition("owner").sortWithinPartitions("owner").mapInArrow(decide, "owner int, bits binary")
    empty = bytes((1 << (bits - owner_bits)) // 8)
    return Linkable(dict.fromkeys(range(n_owners), empty) | {r["owner"]: bytes(r["bits"]) for r in chunks.toLocalIterator(prefetchPartitions=True)}, bits)


def frequency_classes(nodes: DataFrame) -> np.ndarray:
    """Nodes per hash class of their shingles: 2**18 counts, to tell frequent shingles from rare ones."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << CLASS_BITS, np.int64)
        for batch in batches:
            for data in batch.column("shingles").to_pylist():
                np.add.at(total, class_of(np.frombuffer(data, "<u8")), 1)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], names=["class", "n"])

    sums = nodes.select("shingles").mapInArrow(count, "class int, n long").groupBy("class").agg(F.sum("n").alias("n"))
    table = np.zeros(1 << CLASS_BITS, np.int64)
    got = sums.toPandas()  # 2**18 rows at most
    table[got["class"].to_numpy()] = got["n"].to_numpy()
    return table


def class_of(hashes: np.ndarray) -> np.ndarray:
    return (mix(hashes) >> U64(64 - CLASS_BITS)).astype(np.int64)


def count_vector(shingles: np.ndarray) -> np.ndarray:
    return np.minimum(np.bincount((shingles >> U64(58)).astype(np.int64), minlength=GROUPS), FULL).astype("<u2")


def upper_counts(vectors: np.ndarray) -> np.ndarray:
    """Counts that bound from above: a full one stands for any number."""
    return np.where(vectors == FULL, np.iinfo(np.int32).max, vectors.astype(np.int32))


class CountTree:
    """R-tree over count vectors, packed bottom-up in order of set size; a box keeps its largest counts and the
    range of its sizes."""

    def __init__(self, vectors: np.ndarray, sizes: np.ndarray) -> None:
        self.order = np.lexsort((*vectors.T[:2], sizes))
        v, low, high = vectors[self.order], sizes[self.order], sizes[self.order]
        self.levels = [(v, low, high)]
        fan = LEAF
        while len(v) > FAN:
            cut = np.arange(0, len(v), fan)
            v, low, high = np.maximum.reduceat(v, cut), np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut)
            self.levels.append((v, low, high))
            fan = FAN

    def reachable(self, vector: np.ndarray, size: int, percent: int) -> np.ndarray:
        """Points whose bound admits a similarity of `percent` with the given one."""
        at = np.arange(len(self.levels[-1][0]))
        for depth in range(len(self.levels) - 1, -1, -1):
            v, low, high = self.levels[depth]
            near = (100 * low[at] <= (10000 * size) // percent + 100) & (100 * high[at] >= percent * size)
            at = at[near]
            bound = np.minimum(v[at], vector).sum(axis=1, dtype=np.int64)
            at = at[(100 + percent) * bound >= percent * (size + low[at])]
            if depth:
                fan = LEAF if depth == 1 else FAN
                at = (at[:, None] * fan + np.arange(fan)).ravel()
                at = at[at < len(self.levels[depth - 1][0])]
        return self.order[at]


def forest(size: np.ndarray, vectors: np.ndarray, percent: int, part: np.ndarray, link: Callable[[int, np.ndarray], np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the pairs of points that the bound admits and that `link` confirms: two arrays of places.

    Where `part` has two values, only pairs of different parts count. link(i, found): which of the points found are
    linked to i; it is asked only for points that are not joined to i yet.
    """
    n = len(size)
    cross = bool((part != part[0]).any())
    vectors = upper_counts(vectors)
    tree, label, ends = CountTree(vectors, size), np.arange(n), []
    for i in range(n):
        found = tree.reachable(vectors[i], int(size[i]), percent)
        found = found[label[found] != label[i]]
        if cross:
            found = found[part[found] != part[i]]
        if link is not None:
            found = found[found > i]
            found = found[link(i, found)] if len(found) else found
        if len(found) == 0:
            continue
        others, lead = np.unique(label[found], return_index=True)
        ends += [(i, j) for j in found[lead].tolist()]
        label[np.isin(label, others)] = label[i]
        if (label == label[0]).all():
            break
    ends = np.array(ends, np.int64).reshape(-1, 2)
    return ends[:, 0], ends[:, 1]


def linked_sets(sets: list[np.ndarray], part: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the pairs of sets with a Jaccard similarity of `percent` or more."""
    n, size = len(sets), np.array([len(x) for x in sets], np.int64)
    _, key, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(n), size)
    shared = count[key] > 1
    key, row = key[shared], row[shared]
    own = np.searchsorted(row, np.arange(n + 1))
    holders, first = row[np.argsort(key, kind="stable")], np.concatenate([[0], np.cumsum(np.where(count > 1, count, 0))])

    def link(i: int, found: np.ndarray) -> np.ndarray:
        mine = key[own[i] : own[i + 1]]
        overlap = np.bincount(holders[spread(first[mine], count[mine])], minlength=n)[found]
        return 100 * overlap >= percent * (size[i] + size[found] - overlap)

    return forest(size, np.stack([count_vector(x) for x in sets]), percent, part, link)


def by_group(rows: DataFrame, keys: list[str], work: Callable[[pa.Table], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """Pairs (a, b) of nodes that `work` finds among the rows of each group: rows with keys (longs) and node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0

        def groups(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, n
            table = pa.Table.from_batches(held).combine_chunks()
            new = np.zeros(table.num_rows, bool)
            for key in keys:
                new[1:] |= np.diff(table.column(key).to_numpy()) != 0
            edges = [0, *np.flatnonzero(new).tolist(), table.num_rows]
            done = len(edges) - 1 if last else len(edges) - 2
            for a, b in zip(edges[:done], edges[1 : done + 1], strict=True):
                if b - a > 1:
                    group = table.slice(a, b - a)
                    x, y = work(group)
                    if len(x):
                        node = group.column("node").to_numpy()
                        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(node[x], node[y])), pa.array(np.maximum(node[x], node[y]))], names=["a", "b"])
            held = [] if last else table.slice(edges[done]).to_batches()
            n = sum(x.num_rows for x in held)

        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= HOLD:
                yield from groups(False)
        if n:
            yield from groups(True)

    dealt = rows.repartition(*keys).sortWithinPartitions(*keys, "node")
    return dealt.mapInArrow(run, "a long, b long")


def over_blocks(rows: DataFrame) -> DataFrame:
    """Deal the rows of a key with `blocks` blocks over pairs of blocks (i, j); part tells the block of a row."""
    part = F.pmod(F.xxhash64("node"), F.col("blocks")).alias("part")
    partner = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("partner")
    return rows.select("*", part).select("*", partner).withColumns({"i": F.least("part", "partner"), "j": F.greatest("part", "partner")}).drop("partner", "blocks")


def admitted(rows: DataFrame, percent: int) -> DataFrame:
    """A spanning forest of the pairs that the bound admits among the nodes of each shingle."""

    def work(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        vectors = np.frombuffer(b"".join(group.column("vector").to_pylist()), "<u2").reshape(-1, GROUPS)
        return forest(group.column("n").to_numpy(), vectors, percent, group.column("part").to_numpy())

    return by_group(over_blocks(rows), ["token", "i", "j"], work).distinct()


def links(members: DataFrame, percent: int) -> DataFrame:
    """A spanning forest of the linked pairs of each family: rows (family, blocks, node, shingles)."""

    def work(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        sets = [np.frombuffer(x, "<u8") for x in group.column("shingles").to_pylist()]
        return linked_sets(sets, group.column("part").to_numpy(), percent)

    return by_group(over_blocks(members), ["family", "i", "j"], work)


def join(docs: DataFrame, size: int = 4, percent: int = 85) -> DataFrame:
    """Components of documents whose sets of `size`-word shingles have a Jaccard similarity of `percent` or more.

    docs: doc_id and text; other columns are ignored. A text of fewer words has its whole sequence as its one
    shingle; one without words (null, empty) has none and links to nothing. Rows that share a doc_id are texts of
    their own. Returns a row for each row: doc_id, n_shingles, component_id (smallest doc_id reachable).
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    may_link = spark.sparkContext.broadcast(linkable(docs, size, percent, *common.text_volume(docs)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for whole in batches for piece in slices(whole, "text")):
            h, first = shingle_sets(*text_bytes(batch.column("text")), size)
            n = np.diff(first)
            live = (n > 0) & may_link.value.holds(set_keys(h, first))
            sets = [h[first[i] : first[i + 1]].tobytes() if x else None for i, x in enumerate(live.tolist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), pa.array(sets, pa.binary())], names=["doc_id", "n", "shingles"])

    all_sets = docs.mapInArrow(read, "doc_id long, n long, shingles binary").withColumn("set", F.when(F.col("shingles").isNotNull(), F.sha2("shingles", 256)))
    all_sets = common.materialise(all_sets)
    held = all_sets.where("set IS NOT NULL")
    n_held = held.agg(F.sum("n")).first()[0] or 0
    bits = min(max(10, (2 * n_held).bit_length()), MAX_COUNTERS.bit_length() - 1)
    shared = spark.sparkContext.broadcast(Estimate(sketch(held.select(F.col("shingles").alias("text")), lambda raw, offsets: raw.view("<u8"), bits), bits))

    def enough(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for whole in batches for piece in slices(whole, "shingles")):
            raw, offsets = text_bytes(batch.column("shingles"))
            elsewhere, first = np.concatenate([[0], np.cumsum(shared.value.repeated(raw.view("<u8")))]), offsets // 8
            yield batch.filter(pa.array(100 * (elsewhere[first[1:]] - elsewhere[first[:-1]]) >= percent * np.diff(first)))

    held = held.select("doc_id", "n", "shingles", "set").mapInArrow(enough, "doc_id long, n long, shingles binary, set string")
    collapsed = held.groupBy("set").agg(F.min("doc_id").alias("least"), F.first("n").alias("n"), F.first("shingles").alias("shingles"))
    nodes = common.materialise(collapsed.withColumn("node", F.monotonically_increasing_id()))
    classes = spark.sparkContext.broadcast(frequency_classes(nodes))

    def prefix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, row, vectors = [], [], []
            for i, data in enumerate(batch.column("shingles").to_pylist()):
                h = np.frombuffer(data, "<u8")
                count = classes.value[class_of(h)]
                alone = ~shared.value.repeated(h) | (count == 1)
                order = np.lexsort((h, count, ~alone))[: len(h) - -(-percent * len(h) // 100) + 1]
                order = order[~alone[order]]
                tokens.append(h[order].view(np.int64))
                row.append(np.full(len(order), i))
                vectors.append(count_vector(h).tobytes())
            at = pa.array(np.concatenate([np.zeros(0, np.int64), *row]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *tokens])), batch.column("node").take(at), batch.column("n").take(at), pa.array(vectors, pa.binary()).take(at)], names=["token", "node", "n", "vector"])

    rows = common.materialise(nodes.select("node", "n", "shingles").mapInArrow(prefix, "token long, node long, n long, vector binary"))
    # Shingles with the same nodes, of which a group of copies has many, are one: the smallest stands for all.
    marks = [F.bit_xor(F.xxhash64("node", F.lit(k))).alias(f"mark{k}") for k in range(2)]
    met = rows.groupBy("token").agg(F.count(F.lit(1)).alias("m"), *marks).where("m > 1").groupBy("m", "mark0", "mark1").agg(F.min("token").alias("token")).select("token", F.ceil(F.col("m") / BLOCK).alias("blocks"))
    families = components(admitted(rows.join(met, "token"), percent)).withColumnRenamed("root", "family")
    common.drop_table(rows)
    members = common.materialise(nodes.select("node", "n", "shingles").join(families, "node"))
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / FAMILY, F.sum("n") / FAMILY_SHINGLES)).alias("blocks")
    together = components(links(members.join(members.groupBy("family").agg(blocks), "family"), percent))
    roots = nodes.select("set", "least", "node").join(together, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = roots.groupBy("root").agg(F.min("least").alias("component"))
    found = roots.join(least, "root").select("set", "component")
    columns = "doc_id", F.col("n").alias("n_shingles")
    live = all_sets.where("set IS NOT NULL").join(found, "set", "left").select(*columns, F.coalesce("component", "doc_id").alias("component_id"))
    return live.union(all_sets.where("set IS NULL").select(*columns, F.col("doc_id").alias("component_id")))


def brute_force(docs: pd.DataFrame, size: int = 4, percent: int = 85) -> pd.DataFrame:
    """The same result by comparing all pairs that share a shingle, for small tables."""
    import re

    sets, index, parent = [], {}, {}
    ids = docs.doc_id.tolist()
    for i, t in enumerate(docs.text):
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        s = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
        sets.append(s)
        parent[i] = i
        for x in s:
            index.setdefault(x, []).append(i)

    def find(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    for i, s in enumerate(sets):
        shared: dict[int, int] = {}
        for x in s:
            for j in index[x]:
                if j < i:
                    shared[j] = shared.get(j, 0) + 1
        for j, k in shared.items():
            if 100 * k >= percent * (len(s) + len(sets[j]) - k):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    least: dict[int, int] = {}
    for i in range(len(sets)):
        least[find(i)] = min(least.get(find(i), ids[i]), ids[i])
    return pd.DataFrame({"doc_id": ids, "n_shingles": [len(s) for s in sets], "component_id": [least[find(i)] for i in range(len(sets))]})


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(common.documents(spark, sf_dir))
