"""Operator 11: near-duplicate vectors by iterative quantisation and multi-index Hamming tables.

A sample fits the principal axes of the directions and a rotation of them that brings the signs of its coordinates
close to the coordinates themselves; each rotated coordinate is cut near its median, where few values lie, into
balanced bits. The bits of a code are split into blocks, each the key of a table. A vector stands in each table under its block, and looks there
under its block with some bits flipped. Which ones follows from its margins, the distances of its coordinates from
their cuts: two vectors whose codes differ in a bit are at least the sum of their two margins apart in it. So if the
squared distance is D at most, the squared margins of one of the two at the differing bits add up to D / 2 at most,
and of a vector that looks under the cheapest flips of each block, such that those that it leaves out in all blocks
cost more than D / 2 together, no partner within D is missed: the tables find all links, whatever the fit.

Pairs of a bucket pass a bound on their distance by the margins, kept as two bits a coordinate. A spanning forest of
those that pass leaves the bucket; its components are families, to which each vector goes once. There the cosines of
the original vectors decide, in blocks: each block emits numbers of links and a spanning forest of links.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import common
from quillspark.llm.kernels import spread
from quillspark.operators.components import components

#: The rotation is fitted on at most SAMPLE vectors in ROUNDS rounds and gives codes of at most BITS bits.
SAMPLE, ROUNDS, BITS = 20_000, 30, 64
#: Numbers of blocks to choose from, and what a row of a table costs in comparisons of two codes.
BLOCKS, ROW_COST = (16, 12, 10, 8, 6, 5, 4, 3, 2), 400
#: Rows of one side of a tile of a bucket, or of a family; pairs that are compared at once.
BUCKET, FAMILY, PAIRS = 8192, 4096, 1 << 20
#: Rows that a task holds before it works on the groups that are complete.
HOLD = 50_000
#: Copies of a vector from which on its rows are not gathered by their vector.
MANY = 10_000


class Codes:
    """Rotation, cuts and blocks."""

    def __init__(self, sample: np.ndarray, least_cosine: float, seed: int = 5) -> None:
        dim = sample.shape[1]
        self.bits = min(dim, BITS)
        self.distance = (2 - 2 * least_cosine) * (1 + 1e-9) + 1e-12  # of two directions, squared
        _, axes = np.linalg.eigh(sample.T @ sample)
        axes = axes[:, ::-1][:, : self.bits]
        rng = np.random.default_rng(seed)
        turn, _ = np.linalg.qr(rng.normal(size=(self.bits, self.bits)))
        flat = sample @ axes
        for _ in range(ROUNDS):
            spun = flat @ turn
            signs = np.where(spun >= np.median(spun, axis=0), 1.0, -1.0)
            u, _, v = np.linalg.svd(signs.T @ flat)
            turn = (u @ v).T
        self.matrix = axes @ turn
        self.cuts = np.array([sparse_cut(x, self.distance**0.5 / 8) for x in (sample @ self.matrix).T])
        self.split(1)

    def split(self, n_blocks: int) -> None:
        self.blocks = np.array_split(np.arange(self.bits), n_blocks)

    def coordinates(self, directions: np.ndarray) -> np.ndarray:
        """Coordinates less their cuts: signs are the bits of the code, sizes the margins."""
        return directions @ self.matrix - self.cuts

    def keys(self, at: np.ndarray) -> np.ndarray:
        """Block number and bits of each block of each vector."""
        return np.stack([((at[:, b] >= 0) @ (1 << np.arange(len(b)))).astype(np.int64) | (i << 40) for i, b in enumerate(self.blocks)], axis=1)

    def sketches(self, at: np.ndarray) -> np.ndarray:
        """Three integers a vector: the code, and the bits with a margin of a quarter, or half, of the distance."""
        weight = np.uint64(1) << np.arange(self.bits, dtype=np.uint64)
        unit = self.distance**0.5 / 4
        return np.stack([np.where(test, weight, np.uint64(0)).sum(axis=1, dtype=np.uint64) for test in (at >= 0, np.abs(at) >= unit, np.abs(at) >= 2 * unit)], axis=1)

    def flips(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What each vector looks under: vector, block and the bits of the block that are flipped."""
        n, cost = len(at), at * at
        budget = self.distance / 2
        tables = [cheapest(cost[:, b]) for b in self.blocks]
        width = max(t[0].shape[1] for t in tables)
        prices = np.stack([np.pad(t[0], ((0, 0), (0, width - t[0].shape[1])), mode="edge") for t in tables], axis=1)
        taken = spend(prices, budget)
        left_out = np.take_along_axis(prices, taken[..., None], axis=2)[..., 0].sum(axis=1)
        plain = np.flatnonzero(left_out > budget)
        rows, blocks, masks = [], [], []
        for i, (_, patterns) in enumerate(tables):
            k = taken[plain, i]
            row = np.repeat(plain, k)
            rows.append(row)
            masks.append(patterns[row, spread(np.zeros(len(k), np.int64), k)])
            blocks.append(np.full(len(row), i))
        hard = np.flatnonzero(left_out <= budget)  # margins so small that the few smallest do not suffice
        for i, b in enumerate(self.blocks if len(hard) else []):
            row, mask = within(cost[hard][:, b], budget * (1 + 1e-9) / len(self.blocks))
            rows.append(hard[row])
            masks.append(mask)
            blocks.append(np.full(len(row), i))
        return np.concatenate(rows), np.concatenate(blocks), np.concatenate(masks)


def sparse_cut(x: np.ndarray, width: float) -> float:
    """A cut that leaves 3 to 7 tenths on either side: the one with the fewest values within the width, so that a group
    of near copies around the median has no small margins; ties go to the one nearest to the median."""
    x = np.sort(x)
    share = np.linspace(0.3, 0.7, 81)
    cuts = np.quantile(x, share)
    within = np.searchsorted(x, cuts + width) - np.searchsorted(x, cuts - width)
    return float(cuts[np.lexsort((np.abs(share - 0.5), within))[0]])


def cheapest(cost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums and bits of the subsets of the smallest costs of each row, cheapest first. Sums end at the smallest cost that
    is left aside: subsets beyond hold it, or cost more."""
    n, w = cost.shape
    small = min(w, 6 if w <= 11 else 8)
    order = np.argsort(cost, axis=1)
    few = np.take_along_axis(cost, order[:, :small], 1)
    members = (np.arange(1 << small)[:, None] >> np.arange(small)) & 1
    sums = few @ members.T
    turn = np.argsort(sums, axis=1, kind="stable")
    bits = (np.int64(1) << order[:, :small]) @ members.T
    sums = np.take_along_axis(sums, turn, 1)
    aside = np.take_along_axis(cost, order[:, small : small + 1], 1) if w > small else np.full((n, 1), np.inf)
    return np.concatenate([np.minimum(sums, aside), aside], axis=1), np.take_along_axis(bits, turn, 1)


def spend(prices: np.ndarray, budget: float, ahead: int = 12) -> np.ndarray:
    """How many of the sorted prices of each block a vector takes, so that the first ones that it leaves exceed the
    budget together: takes what raises that sum most for each one taken, up to `ahead` at once."""
    n, m, width = prices.shape
    taken = np.zeros((n, m), np.int64)
    live = np.arange(n)
    finite = np.minimum(prices, 4 * budget)  # a price beyond the budget ends the search as well
    while len(live):
        now = np.take_along_axis(finite[live], taken[live][..., None], 2)[..., 0]
        best = np.full((len(live), m), -1.0)
        step = np.ones((len(live), m), np.int64)
        for k in range(1, ahead + 1):
            to = np.minimum(taken[live] + k, width - 1)
            rate = (np.take_along_axis(finite[live], to[..., None], 2)[..., 0] - now) / k
            better = rate > best
            best, step = np.where(better, rate, best), np.where(better, k, step)
        pick = np.argmax(best, axis=1)
        at = np.arange(len(live))
        useful = best[at, pick] > 0
        taken[live, pick] = np.minimum(taken[live, pick] + step[at, pick], width - 1)
        total = np.take_along_axis(finite[live], taken[live][..., None], 2)[..., 0].sum(axis=1)
        live = live[useful & (total <= budget)]
    return taken


def within(cost: np.ndarray, limit: float) -> tuple[np.ndarray, np.ndarray]:
    """All subsets of each row's costs whose sum is below the limit: row and bits."""
    order = np.argsort(cost, axis=1)
    ranked = np.take_along_axis(cost, order, 1)
    row, last, total, mask = np.arange(len(cost)), np.full(len(cost), -1), np.zeros(len(cost)), np.zeros(len(cost), np.int64)
    found = [(row, mask)]
    while len(row):
        grown = []
        for j in range(cost.shape[1]):
            ok = (last < j) & (total + ranked[row, j] < limit)
            grown.append((row[ok], np.full(int(ok.sum()), j), (total + ranked[row, j])[ok], mask[ok] | (np.int64(1) << order[row[ok], j])))
        row, last, total, mask = (np.concatenate(x) for x in zip(*grown, strict=True))
        found.append((row, mask))
    return np.concatenate([r for r, _ in found]), np.concatenate([m for _, m in found])


def may_be_near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the bound admits pairs of sketches: at a differing bit the margins, in quarters of the distance, add up,
    and the squares of these sums may come to 16."""
    flip = a[:, 0] ^ b[:, 0]
    p, q, r, s = flip & a[:, 1], flip & a[:, 2], flip & b[:, 1], flip & b[:, 2]
    count = lambda x: np.bitwise_count(x).astype(np.int32)
    return count(p) + 3 * count(q) + count(r) + 3 * count(s) + 2 * (count(p & r) + count(p & s) + count(q & r) + count(q & s)) <= 16


def forest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Places of pairs that join all that the given pairs of numbers join: one pair less than numbers in a component."""
    kept, names = [], np.unique(np.concatenate([a, b]))
    x, y, at = np.searchsorted(names, a), np.searchsorted(names, b), np.arange(len(a))
    label = np.arange(len(names))
    while True:
        u, v = label[x], label[y]
        live = u != v
        x, y, at, u, v = x[live], y[live], at[live], u[live], v[live]
        if not len(x):
            return np.concatenate([np.zeros(0, np.int64), *kept])
        high, low = np.maximum(u, v), np.minimum(u, v)
        roots, lead = np.unique(high, return_index=True)  # each label but the least of a component hangs on a smaller one
        kept.append(at[lead])
        up = np.arange(len(names))
        up[roots] = low[lead]
        while (up[up] != up).any():
            up = up[up]
        label = up[label]


def grouped(rows: DataFrame, keys: list[str], order: list[str], schema: str, work: Callable[[pa.Table, np.ndarray], Iterator[pa.RecordBatch]]) -> DataFrame:
    """What `work` makes of complete groups: a table of several of them, sorted, and the first row of each and the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def edges(table: pa.Table) -> np.ndarray:
            new = np.zeros(table.num_rows, bool)
            for key in keys:
                new[1:] |= np.diff(table.column(key).to_numpy()) != 0
            return np.concatenate([[0], np.flatnonzero(new), [table.num_rows]])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if sum(x.num_rows for x in held) >= HOLD:
                table = pa.Table.from_batches(held).combine_chunks()
                cut = edges(table)
                if len(cut) > 2:
                    yield from work(table.slice(0, cut[-2]), cut[:-1])
                held = table.slice(cut[-2]).to_batches()
        if held:
            table = pa.Table.from_batches(held).combine_chunks()
            yield from work(table, edges(table))

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def tiles(rows: DataFrame) -> DataFrame:
    """Deal the rows of a group with `blocks` blocks over the pairs of blocks (i, j); part is the block of a row."""
    part = F.pmod(F.xxhash64("node"), F.col("blocks")).alias("part")
    partner = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("partner")
    return rows.select("*", part).select("*", partner).withColumns({"i": F.least("part", "partner"), "j": F.greatest("part", "partner")}).drop("partner", "blocks")


def vectors(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def directions(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1)[:, None]  # no square overflows or vanishes
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def admitted(table: pa.Table, edges: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Candidate pairs of buckets: the rows of a bucket stand first, those that look into it after them."""
    node, looks, part = table.column("node").to_numpy(), table.column("looks").to_numpy(zero_copy_only=False), table.column("part").to_numpy()
    sketch = np.stack([table.column(f"s{i}").to_numpy().view(np.uint64) for i in range(3)], axis=1)
    cross = table.column("i").to_numpy() != table.column("j").to_numpy()
    end = np.repeat(edges[1:], np.diff(edges))
    own = np.flatnonzero(~looks)
    partners = end[own] - own - 1
    done, reached = 0, np.cumsum(partners)
    found: list[np.ndarray] = []
    while done < len(own):
        before = reached[done - 1] if done else 0
        last = max(int(np.searchsorted(reached, before + PAIRS, side="right")), done + 1)
        a, b = np.repeat(own[done:last], partners[done:last]), spread(own[done:last] + 1, partners[done:last])
        ok = (~cross[a] | (part[a] != part[b])) & (node[a] != node[b])
        a, b = a[ok], b[ok]
        near = may_be_near(sketch[a], sketch[b])
        found.append(np.stack([node[a[near]], node[b[near]]], axis=1))
        if sum(map(len, found)) > PAIRS or last == len(own):
            pairs = np.concatenate(found)
            found = [pairs[forest(pairs[:, 0], pairs[:, 1])]]
        done = last
    pairs = np.concatenate([np.zeros((0, 2), np.int64), *found])
    yield pa.RecordBatch.from_arrays([pa.array(pairs.min(axis=1)), pa.array(pairs.max(axis=1))], names=["a", "b"])


def near_duplicates(table: DataFrame, least_cosine: float = 0.98) -> DataFrame:
    """Groups of vectors of one label that are linked by a cosine of least_cosine or more, in double precision.

    table: vec_id, embedding (of float or double) and label; other columns are ignored. Vectors that are null, zero,
    of another length than most, or hold null or non-finite components, and rows with a null label or vec_id, link
    with nothing. Rows that share a vec_id are vectors of their own; equal rows are linked. Returns for each row
    vec_id, n_links (other rows linked directly), component_id (smallest vec_id reachable, itself included) and kept.
    """
    spark = table.sparkSession
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))) & F.exists("embedding", lambda v: v != 0)
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.col("label").cast("string").alias("label"))
    ok = F.coalesce(finite, F.lit(False)) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    size = rows.where(ok).groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    alone = lambda df: df.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    if size is None:
        return alone(rows)
    ok = ok & (F.size("embedding") == size["dim"])
    keyed = rows.where(ok).withColumns({"key": F.xxhash64("label", "embedding"), "key2": F.xxhash64(F.lit(1), "label", "embedding")})
    points = keyed.groupBy("key", "key2").agg(F.first("embedding").alias("embedding"), F.first("label").alias("label"), F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    points = common.materialise(points.withColumns({"node": F.monotonically_increasing_id(), "group": F.xxhash64("label")}))
    codes = fitted(points, least_cosine)
    shared = spark.sparkContext.broadcast(codes)

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["group", "key", "node", "looks", "s0", "s1", "s2"]
        for b in (whole.slice(i, 1000) for whole in batches for i in range(0, whole.num_rows, 1000)):
            codes = shared.value
            at = codes.coordinates(directions(vectors(b.column("embedding"))))
            keys, sketch = codes.keys(at), codes.sketches(at)
            row, block, mask = codes.flips(at)
            m = keys.shape[1]
            every = pa.array(np.concatenate([np.repeat(np.arange(len(at)), m), row]))
            key = np.concatenate([keys.ravel(), keys[row, block] ^ mask])
            looks = np.arange(len(key)) >= keys.size
            yield pa.RecordBatch.from_arrays([b.column("group").take(every), pa.array(key), b.column("node").take(every), pa.array(looks), *(pa.array(sketch[:, i].view(np.int64)).take(every) for i in range(3))], names=names)

    entries = points.select("group", "node", "embedding").mapInArrow(enter, "group long, key long, node long, looks boolean, s0 long, s1 long, s2 long")
    entries = common.materialise(entries)
    full = entries.groupBy("group", "key").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("looks")).alias("own")).where(f"own > 0 AND n > {BUCKET}").select("group", "key", F.ceil(F.col("n") / BUCKET).alias("blocks"))
    full = common.materialise(full)
    if full.isEmpty():
        dealt = entries.withColumn("blocks", F.lit(1).cast("long"))
    else:  # rows of full buckets are dealt without meeting by their bucket; there is one bucket in BUCKET rows at most
        dealt = entries.join(F.broadcast(full) if full.count() <= 1_000_000 else full, ["group", "key"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("long")))
    candidates = grouped(tiles(dealt), ["group", "key", "i", "j"], ["looks", "node"], "a long, b long", admitted)
    families = components(candidates).withColumnsRenamed({"root": "family"})
    members = common.materialise(points.select("node", "group", "label", "copies", "embedding").join(families, "node"))
    sizes = members.groupBy("family").agg(F.ceil(F.count(F.lit(1)) / FAMILY).alias("blocks"))

    def verify(table: pa.Table, edges: np.ndarray) -> Iterator[pa.RecordBatch]:
        column = lambda name: table.column(name).to_numpy()
        node, part, copies, cross = column("node"), column("part"), column("copies"), column("i") != column("j")
        _, label = np.unique(table.column("label").to_numpy(zero_copy_only=False).astype(str), return_inverse=True)
        x = directions(vectors(table.column("embedding")))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            n_links, found = np.zeros(b - a, np.int64), []
            for first in range(a, b, 512):
                some = slice(first, min(first + 512, b))
                near = (x[some] @ x[a:b].T >= least_cosine) & (label[some][:, None] == label[a:b])
                if cross[a]:
                    near &= part[some][:, None] != part[a:b]
                near[np.arange(some.stop - first), np.arange(first - a, some.stop - a)] = False
                n_links[first - a : some.stop - a] = near @ copies[a:b]
                u, v = np.nonzero(np.triu(near, first - a + 1))
                tree = forest(u + first - a, v)
                found.append(np.stack([u[tree] + first - a, v[tree]], axis=1))
            pairs = np.concatenate(found)
            pairs = node[a:b][pairs[forest(pairs[:, 0], pairs[:, 1])]]
            met = np.flatnonzero(n_links)
            none = np.full(len(met), -1, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([node[a:b][met], pairs[:, 0]])), pa.array(np.concatenate([none, pairs[:, 1]])), pa.array(np.concatenate([n_links[met], np.zeros(len(pairs), np.int64)]))], names=["a", "b", "n"])

    verified = common.materialise(grouped(tiles(members.join(sizes, "family")), ["family", "i", "j"], ["node"], "a long, b long, n long", verify))
    roots = components(verified.where("b >= 0").select("a", "b"))
    n_links = verified.where("b < 0").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    ruled = points.select("node", "key", "key2", "least", "copies").join(roots, "node", "left").join(n_links, "node", "left").withColumn("root", F.coalesce("root", "node"))
    ruled = ruled.join(ruled.groupBy("root").agg(F.min("least").alias("component_id")), "root")
    ruled = common.materialise(ruled.select("key", "key2", "copies", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id"))
    heavy = F.broadcast(ruled.where(f"copies >= {MANY}"))  # one in MANY rows at most
    keyed = keyed.select("vec_id", "key", "key2")
    met = keyed.join(heavy, ["key", "key2"]).unionByName(keyed.join(heavy, ["key", "key2"], "left_anti").join(ruled, ["key", "key2"]))
    return met.select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept")).union(alone(rows.where(~ok | ok.isNull())))


def fitted(points: DataFrame, least_cosine: float) -> Codes:
    """Codes fitted on a sample, with the number of blocks of least estimated cost: rows of the tables, and pairs
    of codes that meet in them at the table's size. Any number finds the same links."""
    sample = common.least_by_hash(points.select("key", "group", "embedding"), SAMPLE, "key").select("group", "embedding").toArrow()  # bounded
    x, group = directions(vectors(sample.column("embedding"))), sample.column("group").to_numpy()
    codes = Codes(x, least_cosine)
    at = codes.coordinates(x)
    n_asked, n = min(500, len(at)), points.count()
    lot = np.unique(group, return_inverse=True)[1] << 48  # sample rows have fewer labels than that leaves room for
    costs: list[tuple[float, int]] = []
    for m in [m for m in BLOCKS if m <= codes.bits and -(-codes.bits // m) <= 32] or [1]:
        codes.split(m)
        keys = codes.keys(at)
        row, block, mask = codes.flips(at[:n_asked])
        rows = ROW_COST * (m + len(row) / n_asked)
        if costs and rows > min(costs)[0]:
            break  # fewer blocks take more rows still
        held = np.sort((keys ^ lot[:, None]).ravel())
        looks = np.concatenate([(keys[row, block] ^ mask) ^ lot[row], (keys[:n_asked] ^ lot[:n_asked, None]).ravel()])
        met = np.searchsorted(held, looks, side="right") - np.searchsorted(held, looks)
        pairs = met[: len(row)].sum() + met[len(row) :].sum() / 2
        costs.append((rows + n / len(x) * pairs / n_asked, m))
    codes.split(min(costs)[1])
    return codes


def brute_force(table: pd.DataFrame, least_cosine: float = 0.98) -> pd.DataFrame:
    """The same result by comparing all pairs, for small tables."""
    n, ids = len(table), table.vec_id.tolist()
    vecs = [None if v is None or l is None or any(c is None or not np.isfinite(c) for c in v) or not any(v) else np.asarray(v, np.float64) for v, l in zip(table.embedding, table.label, strict=True)]
    parent, links = list(range(n)), [0] * n

    def find(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(n):
        for j in range(i):
            if vecs[i] is not None and vecs[j] is not None and table.label.iloc[i] == table.label.iloc[j] and len(vecs[i]) == len(vecs[j]):
                if vecs[i] @ vecs[j] >= least_cosine * np.linalg.norm(vecs[i]) * np.linalg.norm(vecs[j]):
                    links[i], links[j] = links[i] + 1, links[j] + 1
                    parent[max(find(i), find(j))] = min(find(i), find(j))
    least: dict[int, int] = {}
    for i in range(n):
        least[find(i)] = min(least.get(find(i), ids[i]), ids[i])
    return pd.DataFrame({"vec_id": ids, "n_links": links, "component_id": [least[find(i)] for i in range(n)], "kept": [least[find(i)] == ids[i] for i in range(n)]})


def op11_itq_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
