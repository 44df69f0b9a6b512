"""Operator 9: language identification by a byte convolutional network trained in numpy.

Filters of several widths slide over the bytes of fixed-length windows; each filter keeps its largest response in
a window, and a softmax over these gives the language. A filter on one-hot bytes is a sum of table rows, one per
byte, so that the network runs as table look-ups. The whole text is read, window by window.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import common
from quillspark.llm.kernels import slices, spread, text_bytes

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
#: The network is fitted on at most this many labelled documents, those of least hash, and on two windows of each.
TRAIN_DOCS = 5000
#: Windows that a task scores together: a row of responses of each takes WINDOW * FILTERS floats.
BLOCK = 128


@dataclass
class Network:
    labels: list[str]
    tables: dict[int, np.ndarray]  # width: (width, 256, FILTERS)
    bias: np.ndarray
    dense: np.ndarray
    base: np.ndarray

    def responses(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Largest response of each filter in each window, and where."""
        best, where = [], []
        for w, table in self.tables.items():
            n = x.shape[1] - w + 1
            r = table[0][x[:, :n]]
            for j in range(1, w):
                r += table[j][x[:, j : j + n]]
            at = r.argmax(axis=1)
            where.append(at)
            best.append(np.take_along_axis(r, at[:, None, :], axis=1)[:, 0])
        return np.concatenate(best, axis=1) + self.bias, np.concatenate(where, axis=1)

    def paired(self) -> list[tuple[int, list[tuple[int, np.ndarray]]]]:
        """For each width the tables of two bytes (and one) whose rows add up to a response."""
        out = []
        for w, t in self.tables.items():
            parts = [(j, (t[j][:, None] + t[j + 1][None]).reshape(-1, FILTERS)) for j in range(0, w - 1, 2)]
            out.append((w, parts + ([(w - 1, t[w - 1])] if w % 2 else [])))
        return out


def softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def fit(x: np.ndarray, y: np.ndarray, labels: list[str], epochs: int = 12, size: int = 64, seed: int = 7) -> Network:
    """Adam on the cross entropy; gradients reach a filter at the place of its largest response."""
    rng = np.random.default_rng(seed)
    net = Network(labels, {w: rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS}, np.zeros(FILTERS * len(WIDTHS), np.float32), rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(labels))).astype(np.float32), np.zeros(len(labels), np.float32))
    params = [*net.tables.values(), net.bias, net.dense, net.base]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step = 0
    for epoch in range(epochs):
        rate = 0.01 * 0.5 ** (epoch // 3)
        order = rng.permutation(len(x))
        for i in range(0, len(x), size):
            at = order[i : i + size]
            r, where = net.responses(x[at])
            hidden = np.maximum(r, 0)
            g = softmax(hidden @ net.dense + net.base)
            g[np.arange(len(at)), y[at]] -= 1
            g /= len(at)
            back = (g @ net.dense.T) * (r > 0)
            grads = []
            for k, (w, table) in enumerate(net.tables.items()):
                grad, cols = np.zeros_like(table), slice(k * FILTERS, (k + 1) * FILTERS)
                for j in range(w):
                    np.add.at(grad[j], (np.take_along_axis(x[at], where[:, cols] + j, axis=1), np.arange(FILTERS)), back[:, cols])
                grads.append(grad)
            grads += [back.sum(axis=0), hidden.T @ g, g.sum(axis=0)]
            step += 1
            for p, d, m, v in zip(params, grads, first, second, strict=True):
                m += 0.1 * (d - m)
                v += 0.001 * (d * d - v)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves remainder 0 by 5 (a null id: true)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def train(docs: DataFrame, limit: int = TRAIN_DOCS) -> Network | None:
    """Fit on documents with text and lang that are not held out. None: there are none."""
    labelled = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & (F.octet_length("text") > 0))
    at = lambda k: F.substring(F.encode("text", "UTF-8"), (F.pmod(F.xxhash64("doc_id", F.lit(k)), F.greatest(F.octet_length("text") - WINDOW, F.lit(1))) + 1).cast("int"), F.lit(WINDOW)).alias(f"w{k}")
    chosen = common.least_by_hash(labelled, limit, "doc_id")
    rows = chosen.select("lang", "doc_id", at(0), at(1)).toPandas()  # 2 * limit windows; no text reaches the driver
    if rows.empty:
        return None
    labels = sorted(rows["lang"].unique())
    y = np.tile(np.array([labels.index(v) for v in rows["lang"]]), 3)
    short = [bytes(v)[: 24 + 8 * (i % 12)] for i, v in enumerate(rows["w1"])]  # so that short texts are known too
    x = np.zeros((len(y), WINDOW), np.uint8)
    for i, v in enumerate([*rows["w0"], *rows["w1"], *short]):
        x[i, : len(v)] = np.frombuffer(bytes(v), np.uint8)
    return fit(x, y, labels)


def window_scores(raw: np.ndarray, offsets: np.ndarray, net: Network, tables: list) -> np.ndarray:
    """Sum over the windows of each text of their log probabilities, by length of window."""
    n = len(offsets) - 1
    length = np.diff(offsets)
    count = np.maximum(1, -(-length // WINDOW))
    row = np.repeat(np.arange(n), count)
    start = spread(np.zeros(n, np.int64), count) * WINDOW
    own = np.minimum(length[row] - start, WINDOW)
    total = np.zeros((n, len(net.labels)))
    for a in range(0, len(row), BLOCK):
        b = min(a + BLOCK, len(row))
        x = np.zeros((b - a, WINDOW), np.uint8)
        lens = np.maximum(own[a:b], 0)
        x.reshape(-1)[spread(np.arange(b - a) * WINDOW, lens)] = raw[spread(offsets[row[a:b]] + start[a:b], lens)]
        pair = (x[:, :-1].astype(np.int32) << 8) | x[:, 1:]
        best = []
        for w, parts in tables:
            m = WINDOW - w + 1
            r = None
            for j, t in parts:
                add = t[(pair if len(t) > 256 else x)[:, j : j + m]]
                r = add if r is None else np.add(r, add, out=r)
            best.append(r.max(axis=1))
        hidden = np.maximum(np.concatenate(best, axis=1) + net.bias, 0)
        log = np.log(softmax(hidden @ net.dense + net.base) + 1e-9)
        np.add.at(total, row[a:b], log * (np.maximum(lens, 1) / WINDOW)[:, None])
    return total


def identify(docs: DataFrame, net: Network | None, language: str = "lang_pred", score: str = "score") -> DataFrame:
    """Add the columns `language` and `score` to documents; all columns stay (columns of these names are replaced).

    A null text, and one without a letter, is `und` with score 0; so is every text without a network. The text
    alone decides.
    """
    kept = docs.drop(*(c for c in (language, score) if c in docs.columns))
    if net is None:
        return kept.withColumns({language: F.lit("und"), score: F.lit(0.0)})
    shared = docs.sparkSession.sparkContext.broadcast(net)
    # mapInArrow looks columns up by name, dots and all: they go in under plain names.
    names_in = [f"c{i}" for i in range(len(kept.columns))]
    text = names_in[kept.columns.index("text")]
    known = kept.toDF(*names_in).withColumn("letters", F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        tables, names = net.paired(), np.array([*net.labels, "und"])
        for batch in (piece for whole in batches for piece in slices(whole, text)):
            logs = window_scores(*text_bytes(batch.column(text)), net, tables)
            p = softmax(logs)
            some = batch.column("letters").to_numpy(zero_copy_only=False)
            best = np.where(some, p.argmax(axis=1), len(net.labels))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names_in), pa.array(names[best].tolist(), pa.string()), pa.array(np.where(some, p.max(axis=1), 0.0))], names=[*names_in, "language", "score"])

    schema = ", ".join(f"{c} {f.dataType.simpleString()}" for c, f in zip(names_in, kept.schema, strict=True)) + ", language string, score double"
    return known.mapInArrow(predict, schema).toDF(*kept.columns, language, score)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    found = identify(docs.select("doc_id", "text"), train(docs.select("doc_id", "text", "lang")))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
