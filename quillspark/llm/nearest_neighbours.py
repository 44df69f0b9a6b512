"""Operator 5: approximate nearest neighbours by low-dimensional stable projections in a kd-tree.

A Gaussian matrix projects the directions of vectors to DIMENSIONS numbers, in which the squared distance of two
directions is their true squared distance times a chi-square variable; with the norms, that bounds an inner product.
Vectors fall into bands by norm. A kd-tree over the projections deals the vectors of each band over tasks, and goes
on in each task down to boxes of a few vectors. A query opens the boxes of its own task by their distance, takes the
vectors in order of projected distance and verifies each exactly, until the chi-square test says that the next one is
closer than the k-th best only with small probability. The score reached bounds its walk through the other tasks, and
boxes beyond the test are not opened.

Equal vectors are one point with the smallest ids among them, as many as an answer can hold, so that a vector that
a third of all rows share is neither a hot leaf nor a hot query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.llm import common
from quillspark.llm.kernels import spread

#: Dimensions of the projections; confidence of the stopping test, as the normal quantile of 0.885. With them 0.9 or
#: more of the true neighbours are found (README has the share that is verified).
DIMENSIONS, QUANTILE = 24, 1.2
#: The tree is fitted on at most SAMPLE vectors and has at most MAX_LEAVES leaves of about LEAF vectors; a leaf that
#: holds more bytes of vectors than POINT_BYTES is dealt over several tasks, and so are more queries than QUERY_BYTES.
SAMPLE, LEAF, MAX_LEAVES = 20_000, 8192, 2048
POINT_BYTES, QUERY_BYTES = 1 << 24, 1 << 26
#: Norms of a band lie within this factor; all smaller ones are in the last band.
BAND, BANDS = 0.8, 16
#: Nearest projections that are verified first; each further step takes twice as many.
STEP = 64
#: Points of a box of the tree that a query walks.
POINTS = 64


def chi_square(m: int, z: float) -> float:
    """Quantile of the chi-square distribution (Wilson and Hilferty)."""
    return m * (1 - 2 / (9 * m) + z * (2 / (9 * m)) ** 0.5) ** 3


class Splits:
    """A kd-tree of depth `depth` over projections: cuts at medians along the widest dimension."""

    def __init__(self, sample: np.ndarray, depth: int) -> None:
        self.depth = depth
        self.dim = np.zeros(1 << depth, np.int64)
        self.cut = np.zeros(1 << depth)
        self.boxes: list[tuple[np.ndarray, np.ndarray]] = []
        m = sample.shape[1]
        self._grow(sample, 1, np.full(m, -np.inf), np.full(m, np.inf), 0)
        self.low, self.high = (np.array(x) for x in zip(*self.boxes, strict=True))

    def _grow(self, points: np.ndarray, node: int, low: np.ndarray, high: np.ndarray, level: int) -> None:
        if level == self.depth:
            self.boxes.append((low, high))
            return
        d = int(np.argmax(points.std(axis=0))) if len(points) else 0
        cut = float(np.median(points[:, d])) if len(points) else 0.0
        self.dim[node], self.cut[node] = d, cut
        left, right = high.copy(), low.copy()
        left[d], right[d] = min(cut, high[d]), max(cut, low[d])
        self._grow(points[points[:, d] < cut], 2 * node, low, left, level + 1)
        self._grow(points[points[:, d] >= cut], 2 * node + 1, right, high, level + 1)

    def leaf(self, points: np.ndarray) -> np.ndarray:
        node = np.ones(len(points), np.int64)
        for _ in range(self.depth):
            node = 2 * node + (points[np.arange(len(points)), self.dim[node]] >= self.cut[node])
        return node - (1 << self.depth)


def box_distance(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distance of each point to each box."""
    out = np.zeros((len(points), len(low)))
    for d in range(points.shape[1]):
        x = points[:, d][:, None]
        gap = np.maximum(np.maximum(low[:, d][None] - x, x - high[:, d][None]), 0)
        out += gap * gap
    return out


def vectors(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


class Space:
    """Projection of directions, bands of norms, and the tree's leaves."""

    def __init__(self, dim: int, norm2: float, seed: int = 11) -> None:
        self.tops = norm2**0.5 * BAND ** np.arange(BANDS)  # the largest norm of each band
        self.matrix = np.random.default_rng(seed).normal(size=(dim, DIMENSIONS))
        self.limit = chi_square(DIMENSIONS, QUANTILE)
        self.splits: Splits | None = None

    def bands(self, x: np.ndarray) -> np.ndarray:
        return np.minimum(np.searchsorted(-self.tops, -np.linalg.norm(x, axis=1), side="right") - 1, BANDS - 1).clip(0)

    def points(self, x: np.ndarray) -> np.ndarray:
        return x @ self.matrix / np.linalg.norm(x, axis=1)[:, None]

    def reach(self, kth: np.ndarray | float, norms: np.ndarray | float) -> np.ndarray:
        """Squared projected distance beyond which vectors score better than kth with small probability only. norms:
        norm of the query times that of the vectors. The squared distance of two directions is 2 - 2 * cosine."""
        return self.limit * 2 * np.maximum(1 - kth / norms, 0)


class Walk:
    """A kd-tree of the projections in one leaf of Splits: boxes around POINTS points or fewer, whatever their number."""

    def __init__(self, points: np.ndarray) -> None:
        self.order, cuts, todo = np.arange(len(points)), [0], [(0, len(points))]
        while todo:
            a, b = todo.pop()
            if b - a <= POINTS:
                cuts.append(b)
                continue
            own = points[self.order[a:b]]
            middle = (b - a) // 2
            self.order[a:b] = self.order[a:b][np.argpartition(own[:, np.argmax(own.max(axis=0) - own.min(axis=0))], middle)]
            todo += [(a + middle, b), (a, a + middle)]  # the left part is cut first, so that cuts ascend
        self.first, self.count = np.array(cuts[:-1]), np.diff(cuts)
        ordered = points[self.order]
        self.low, self.high = np.minimum.reduceat(ordered, self.first), np.maximum.reduceat(ordered, self.first)


def search_leaf(space: Space, x: np.ndarray, least: np.ndarray, q: np.ndarray, kth: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The k best points of a leaf for each query: query, point and exact score, and for the first of each query the
    number of points verified for it, else 0.
    kth: a score that k points elsewhere reach (-inf: none known).

    A query opens boxes by their distance. A point of an open box is verified once no closed box is nearer, in order of
    projected distance, unless the chi-square test at the k-th score so far rules it out; boxes that the test rules out
    stay closed."""
    projected, pq = space.points(x), space.points(q)
    tree = Walk(projected)
    p, x, least = projected[tree.order], x[tree.order], least[tree.order]
    near, norms, own = (p * p).sum(axis=1), np.linalg.norm(x, axis=1), np.linalg.norm(q, axis=1)
    rows, points, scores, verified = [], [], [], []
    for first in range(0, len(q), 256):
        for i, gaps in enumerate(box_distance(pq[first : first + 256], tree.low, tree.high), first):
            size, least_score, turn, length = own[i] * norms, kth[i], np.argsort(gaps, kind="stable"), (pq[i] ** 2).sum()
            top, opened, wide = size.max(), 0, 1
            wait, distance = np.zeros(0, np.int64), np.zeros(0)
            at, score, seen = np.zeros(0, np.int64), np.zeros(0), 0
            while True:
                boxes = turn[opened : opened + wide]
                boxes = boxes[gaps[boxes] <= space.reach(least_score, top)]
                new = spread(tree.first[boxes], tree.count[boxes])
                wait, distance = np.concatenate([wait, new]), np.concatenate([distance, near[new] + length - 2 * p[new] @ pq[i]])
                ends = len(boxes) < wide or opened + wide >= len(turn)
                opened, wide = opened + wide, 2 * wide
                ready = np.ones(len(wait), bool) if ends else distance <= gaps[turn[opened]]
                ready &= distance <= space.reach(least_score, size[wait])
                go = wait[ready][np.argsort(distance[ready], kind="stable")]
                far = np.sort(distance[ready])
                wait, distance = wait[~ready], distance[~ready]
                done, step = 0, STEP
                while done < len(go):
                    some = slice(done, done + step)
                    new = go[some][far[some] <= space.reach(least_score, size[go[some]])]
                    done, step, seen = done + step, 2 * step, seen + len(new)
                    at = np.concatenate([at, new])
                    score = np.concatenate([score, (q[i] * x[new]).sum(axis=1)])  # the same sum wherever a vector stands
                    best = np.lexsort((least[at], -score))[:k]
                    at, score = at[best], score[best]
                    if len(at) == k and score[-1] > least_score:
                        least_score = score[-1]
                if ends:
                    break
            rows.append(np.full(len(at), i))
            points.append(tree.order[at])
            scores.append(score)
            verified.append(np.where(np.arange(len(at)) == 0, seen, 0))
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *rows]), np.concatenate([none, *points]), np.concatenate([np.zeros(0), *scores]), np.concatenate([none, *verified])


def neighbours(table: DataFrame, every: int = 20, k: int = 20) -> DataFrame:
    """The k nearest rows, by inner product, of each row whose vec_id is divisible by `every`.

    table: vec_id and embedding; other columns are ignored. Vectors that are null, zero, of another length than
    most, or hold null or non-finite components take no part, nor does a null vec_id. Ties go to the smaller
    vec_id. Rows that repeat a vec_id with another vector are queries and candidates of their own, each query with k
    answers; equal rows are one. Returns query_id, rank, vec_id, score and n_verified, the number of vectors whose
    score the query computed.
    """
    spark = table.sparkSession
    empty = "query_id long, rank int, vec_id long, score double, n_verified long"
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))) & F.exists("embedding", lambda v: v != 0)
    kind = table.schema["embedding"].dataType.simpleString()  # of float or double
    good = table.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(F.col("vec_id").isNotNull() & F.coalesce(finite, F.lit(False)))
    sizes = good.groupBy(F.size("embedding").alias("dim")).agg(F.count(F.lit(1)).alias("n"), F.max(F.aggregate("embedding", F.lit(0.0), lambda a, v: a + v.cast("double") * v)).alias("norm2")).orderBy(F.desc("n"), "dim").first()
    if sizes is None:
        return spark.createDataFrame([], empty)
    dim = sizes["dim"]
    good = good.where(F.size("embedding") == dim).withColumn("key", F.concat_ws(":", F.xxhash64("embedding"), F.xxhash64(F.lit(1), "embedding")))
    by_id = F.dense_rank().over(Window.partitionBy("key").orderBy("vec_id"))
    some = good.withColumn("nth", by_id).where(F.col("nth") <= k + 1)
    points = some.groupBy("key").agg(F.first("embedding").alias("embedding"), F.min("vec_id").alias("least"), F.array_sort(F.collect_set("vec_id")).alias("ids"))
    asked = good.where(F.col("vec_id") % every == 0).select("key", F.col("vec_id").alias("query_id")).distinct()
    points = common.materialise(points.join(asked.select("key", F.lit(True).alias("asks")).distinct(), "key", "left"))
    n_points, n_asked = points.agg(F.count(F.lit(1)), F.count("asks")).first()
    space = Space(dim, sizes["norm2"])
    depth = int(np.log2(min(MAX_LEAVES, max(1, n_points // LEAF))))
    sample = common.least_by_hash(points, SAMPLE, "key").select("embedding").toArrow()  # bounded
    space.splits = Splits(space.points(vectors(sample.column(0).combine_chunks())), depth)
    shared = spark.sparkContext.broadcast(space)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = vectors(b.column("embedding")) if b.num_rows else np.zeros((0, dim))
            space = shared.value
            home = space.splits.leaf(space.points(x))
            leaf = home + (space.bands(x) << depth)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(leaf), pa.array(home)], names=[*b.schema.names, "leaf", "home"])

    placed = common.materialise(points.mapInArrow(assign, f"key string, embedding {kind}, least long, ids array<long>, asks boolean, leaf long, home long"))
    # A leaf has so many tasks as its vectors need: `share` numbers them. A row per leaf, BANDS * MAX_LEAVES at most.
    sizes_of = dict(placed.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) * 8 * dim / POINT_BYTES)).collect())
    tasks = spark.sparkContext.broadcast(sizes_of)
    turns = -(-n_asked * 8 * dim // QUERY_BYTES)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows == 0 or right.num_rows == 0:
            return pa.table({"key": pa.array([], pa.string()), "own": pa.array([], pa.bool_()), "score": pa.array([], pa.float64()), "ids": pa.array([], pa.list_(pa.int64())), "verified": pa.array([], pa.int64())})
        get = lambda t, c: t.column(c).combine_chunks()
        at, point, score, verified = search_leaf(shared.value, vectors(get(left, "embedding")), get(left, "least").to_numpy(), vectors(get(right, "embedding")), get(right, "kth").to_numpy(), k + 1)
        key, point_key = get(right, "key").take(pa.array(at)), get(left, "point").take(pa.array(point))
        return pa.table({"key": key, "own": pc.equal(key, point_key), "score": pa.array(score), "ids": get(left, "ids").take(pa.array(point)), "verified": pa.array(verified)})

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space = shared.value
        leaves = np.array([(leaf, part) for leaf, n in sorted(tasks.value.items()) for part in range(n)], np.int64).reshape(-1, 2)
        inner, tops = leaves[:, 0] & ((1 << depth) - 1), space.tops[leaves[:, 0] >> depth]
        for b in (whole.slice(i, 512) for whole in batches for i in range(0, whole.num_rows, 512)):
            q, home, kth = vectors(b.column("embedding")), b.column("home").to_numpy(), b.column("kth").to_numpy()
            norms = np.linalg.norm(q, axis=1)[:, None] * tops
            box = box_distance(space.points(q), space.splits.low, space.splits.high)[:, inner]
            near = (box <= space.reach(np.maximum(kth, -1e300)[:, None], norms)) & (kth[:, None] <= norms * (1 + 1e-9))  # no vector of a smaller norm scores so high
            near &= ~((leaves[:, 0] == home[:, None]) & (leaves[:, 1] == 0))
            row, to = np.nonzero(near)
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(leaves[to, 0]), pa.array(leaves[to, 1]), b.column("key").take(at), b.column("embedding").take(at), pa.array(kth[row])], names=["leaf", "share", "key", "embedding", "kth"])

    share = F.create_map(*(F.lit(x) for item in sizes_of.items() if item[1] > 1 for x in item)) if any(n > 1 for n in sizes_of.values()) else None
    count = F.lit(1) if share is None else F.coalesce(F.try_element_at(share, F.col("leaf")), F.lit(1))
    turn = F.explode(F.sequence(F.lit(0), F.lit(turns - 1))).alias("turn") if turns > 1 else F.lit(0).alias("turn")
    stock = placed.select("leaf", F.pmod(F.xxhash64("key"), count).cast("long").alias("share"), turn, F.col("key").alias("point"), "embedding", "least", "ids")
    own_turn = F.pmod(F.xxhash64("key", F.lit(1)), F.lit(max(1, turns))).cast("int").alias("turn")
    found_schema = "key string, own boolean, score double, ids array<long>, verified long"

    def searched(queries: DataFrame) -> DataFrame:
        by = ["leaf", "share", "turn"]
        return common.materialise(stock.groupBy(*by).cogroup(queries.withColumn("turn", own_turn).groupBy(*by)).applyInArrow(run, found_schema))

    at_home = placed.where("asks").select(F.col("home").alias("leaf"), F.lit(0).cast("long").alias("share"), "key", "embedding", F.lit(float("-inf")).alias("kth"))
    first = searched(at_home)
    kth = first.groupBy("key").agg(F.when(F.count(F.lit(1)) > k, F.min("score")).alias("kth"))
    travel = placed.where("asks").join(kth, "key", "left").select("key", "embedding", "home", F.coalesce("kth", F.lit(float("-inf"))).alias("kth"))
    second = searched(travel.mapInArrow(route, f"leaf long, share long, key string, embedding {kind}, kth double"))
    found = first.union(second)
    work = found.groupBy("key").agg(F.sum("verified").alias("n_verified"))
    ranked = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"), "vec_id"))
    best = found.select("key", "own", "score", F.explode("ids").alias("vec_id")).withColumn("nth", ranked).where(F.col("nth") <= k + 1)
    # A query's own vector is its own row where the ids agree too: of the k + 1 best of its vector, that one goes.
    itself = F.col("own") & (F.col("query_id") == F.col("vec_id"))
    order = F.row_number().over(Window.partitionBy("query_id", "key").orderBy(F.desc("score"), "vec_id"))
    met = asked.join(best, "key").where(~itself).withColumn("rank", order).where(F.col("rank") <= k)
    return met.join(work, "key").select("query_id", "rank", "vec_id", "score", "n_verified")


def brute_force(table: pd.DataFrame, every: int = 20, k: int = 20) -> pd.DataFrame:
    """Exact neighbours of all queries, for small tables of distinct rows."""
    ok = [v is not None and len(v) and all(c is not None and np.isfinite(c) for c in v) and any(c != 0 for c in v) for v in table.embedding]
    table = table[ok]
    x, ids = np.array([np.asarray(v, np.float64) for v in table.embedding]), table.vec_id.to_numpy()
    rows = []
    for i in np.flatnonzero(ids % every == 0):
        s = (x * x[i]).sum(axis=1)
        order = [j for j in np.lexsort((ids, -s)) if j != i][:k]
        rows += [(int(ids[i]), r + 1, int(ids[j]), float(s[j])) for r, j in enumerate(order)]
    return pd.DataFrame(rows, columns=["query_id", "rank", "vec_id", "score"])


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
