"""Quality classifier: random-indexing word vectors, pooled, then a two-layer network.

1. Every token (run of letters and digits, or of other signs) hashes to one of
   ``SLOTS`` slots. A slot's index vector is sparse and fixed; its word vector is the
   sum of the index vectors of the tokens within ``WINDOW`` places, over the whole
   table. Sums travel in ``BLOCKS`` blocks of slots and are added as they stream, so
   the driver gets a table of fixed size.
2. A document is the mean and the spread of its tokens' vectors and the mean product
   of neighbouring vectors, which shows repetition, besides the log of its length.
3. A network of one hidden layer is trained in numpy on at most ``TRAIN_ROWS``
   labelled rows of the learning fold; a temperature fitted on a part of them that the
   weights did not see calibrates its probabilities.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SLOTS = 1 << 14
DIM = 32
NONZERO = 2
WINDOW = 2
BLOCKS = 64
HIDDEN = 32
EPOCHS = 60
#: Labelled rows that train the network, at most; they are those of smallest hash.
TRAIN_ROWS = 12_000
TABLE_ENTRIES = 150_000
#: Tokens pooled at once; bounds a worker's memory (a longer document is pooled alone).
POOL_TOKENS = 1 << 15
FEATURES = 3 * DIM + 1

_find = re.compile(r"\w+|[^\w\s]+").findall
_draw = np.random.default_rng(20240229)
_INDEX = np.argsort(_draw.random((SLOTS, DIM)), axis=1)[:, :NONZERO].astype(np.int64)
_SIGN = _draw.choice([-1.0, 1.0], (SLOTS, NONZERO))


class _Slots(dict):
    """Chunk of text between spaces to its tokens' slots, packed."""

    def __missing__(self, chunk: bytes) -> bytes:
        tokens = _find(chunk.decode("utf-8", "replace"))
        found = self[chunk] = np.array([zlib.crc32(t.encode()) & (SLOTS - 1) for t in tokens], np.uint16).tobytes()
        return found


_slots = common.cache(__name__, _Slots())


def slots_of(text: bytes) -> np.ndarray:
    if len(_slots) > TABLE_ENTRIES:
        _slots.clear()
    return np.frombuffer(b"".join(map(_slots.__getitem__, text.split())), np.uint16).astype(np.int64)


def context_sums(documents: list[np.ndarray]) -> np.ndarray:
    """Sums of index vectors by slot; no context goes across documents."""
    total = np.zeros(SLOTS * DIM)
    s = np.concatenate(documents)
    of = np.repeat(np.arange(len(documents)), [len(d) for d in documents])
    for step in range(1, WINDOW + 1):
        same = of[step:] == of[:-step]
        left, right = s[:-step][same], s[step:][same]
        for a, b in ((left, right), (right, left)):
            for k in range(NONZERO):
                total += np.bincount(a * DIM + _INDEX[b, k], _SIGN[b, k], SLOTS * DIM)
    return total.reshape(SLOTS, DIM)


def _partial_sums(batches):
    common.only(__name__)
    total = np.zeros((SLOTS, DIM))
    for b in batches:
        own, n = [], 0
        for t in common.byte_texts(b.column(0)):
            own.append(slots_of(t))
            n += len(own[-1])
            if n > 40 * POOL_TOKENS:
                total += context_sums(own)
                own, n = [], 0
        if n:
            total += context_sums(own)
    parts = total.astype(np.int32).reshape(BLOCKS, -1)
    keep = np.flatnonzero(parts.any(1))
    yield pa.RecordBatch.from_arrays([pa.array(keep.astype(np.int32)), pa.array([parts[k].tobytes() for k in keep], pa.binary())], ["block", "sums"])


def _added(batches):
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for k, sums in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            total[k] = total.get(k, 0) + np.frombuffer(sums, np.int32).astype(np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], ["block", "sums"])


def word_vectors(docs: DataFrame) -> np.ndarray:
    """A unit vector for each slot, of what its contexts have beyond the mean; zeros for unused slots."""
    sums = docs.select("text").mapInArrow(_partial_sums, "block int, sums binary").repartition(BLOCKS, "block").mapInArrow(_added, "block int, sums binary").collect()
    total = np.zeros((BLOCKS, SLOTS * DIM // BLOCKS))
    for r in sums:  # one row per block
        total[r.block] = np.frombuffer(r.sums, np.int64)
    total = total.reshape(SLOTS, DIM)
    norm = np.linalg.norm(total, axis=1, keepdims=True)
    unit = np.divide(total, norm, out=np.zeros_like(total), where=norm > 0)
    used = norm[:, 0] > 0
    if used.any():
        unit[used] -= unit[used].mean(0)
        norm = np.linalg.norm(unit, axis=1, keepdims=True)
        unit = np.divide(unit, norm, out=np.zeros_like(unit), where=norm > 0)
    return unit.astype(np.float32)


def pooled(documents: list[np.ndarray], vectors: np.ndarray) -> np.ndarray:
    """Features of documents; those without tokens have zeros."""
    out = np.zeros((len(documents), FEATURES), np.float32)
    size = np.array([len(d) for d in documents], np.int64)
    out[:, -1] = np.log1p(size)
    at, i = np.flatnonzero(size), 0
    while i < len(at):
        j, n = i, 0
        while j < len(at) and (n == 0 or n + size[at[j]] <= POOL_TOKENS):
            n += size[at[j]]
            j += 1
        own, count = at[i:j], size[at[i:j]][:, None].astype(np.float32)
        x = vectors[np.concatenate([documents[k] for k in own])]
        start = np.concatenate([[0], np.cumsum(count[:-1, 0])]).astype(np.int64)
        mean = np.add.reduceat(x, start) / count
        spread = np.sqrt(np.maximum(np.add.reduceat(x * x, start) / count - mean * mean, 0))
        near = np.zeros_like(x)
        near[:-1] = x[:-1] * x[1:]
        near[start[1:] - 1] = 0
        out[own, :-1] = np.concatenate([mean, spread, np.add.reduceat(near, start) / count], 1)
        i = j
    return out


class Network:
    """Two layers in numpy, with standardised inputs and a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-6
        z = (x - self.mean) / self.scale
        held = rng.permutation(len(z)) < len(z) // 5
        rows, calibrate = np.flatnonzero(~held), np.flatnonzero(held)
        self.p = [rng.normal(0, 1 / np.sqrt(z.shape[1]), (z.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
        self.temperature = 1.0
        m, v, t = [np.zeros_like(p) for p in self.p], [np.zeros_like(p) for p in self.p], 0
        for _ in range(EPOCHS):
            order = rng.permutation(rows)
            for k in range(0, len(order), 128):
                b = order[k : k + 128]
                h = np.tanh(z[b] @ self.p[0] + self.p[1])
                d = (1 / (1 + np.exp(-(h @ self.p[2] + self.p[3]))) - y[b]) / len(b)
                dh = d[:, None] * self.p[2] * (1 - h * h)
                t += 1
                for i, g in enumerate((z[b].T @ dh + 1e-4 * self.p[0], dh.sum(0), h.T @ d + 1e-4 * self.p[2], d.sum(keepdims=True))):
                    m[i] = 0.9 * m[i] + 0.1 * g
                    v[i] = 0.999 * v[i] + 0.001 * g * g
                    self.p[i] -= 3e-3 * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
        if len(calibrate):
            s, own = self._logits(z[calibrate]), y[calibrate]
            loss = lambda temp: np.logaddexp(0, np.where(own == 1, -s, s) / temp).mean()
            self.temperature = min(np.exp(np.linspace(-1, 3, 81)), key=loss)

    def _logits(self, z):
        return np.tanh(z @ self.p[0] + self.p[1]) @ self.p[2] + self.p[3][0]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self._logits((x - self.mean) / self.scale) / self.temperature, -30, 30)))


def _pool(vectors):
    def run(batches):
        common.only(__name__)
        for b in batches:
            found = pooled([slots_of(t) for t in common.byte_texts(b.column(1))], vectors.value)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32) * FEATURES), pa.array(found.ravel()))], ["label", "x"])

    return run


def fit(docs: DataFrame, labels: DataFrame):
    """(broadcast word vectors, network or the constant that stands for one)."""
    spark = docs.sparkSession
    common.prepare(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    vectors = spark.sparkContext.broadcast(word_vectors(docs))  # fixed size
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label")).filter("label IN (0, 1) AND doc_id IS NOT NULL").filter(common.learn_fold()).groupBy("doc_id").agg(F.max("label").alias("label"))
    sample = F.broadcast(common.smallest(common.materialise(known, "labels"), TRAIN_ROWS))
    got = docs.join(sample, "doc_id").select("label", "text", "doc_id").mapInArrow(_pool(vectors), "label int, x array<float>").toArrow()
    y = got["label"].to_numpy().astype(np.float64)
    if len(y) == 0 or y.min() == y.max():
        return vectors, float(y.mean()) if len(y) else 0.5
    x = got["x"].combine_chunks().flatten().to_numpy().reshape(-1, FEATURES).astype(np.float64)
    order = np.lexsort((*x.T[4:], *x.T[:4], y))  # rows come in any order; training needs one
    return vectors, Network(x[order], y[order])


def _scorer(docs: DataFrame, labels: DataFrame):
    vectors, model = fit(docs, labels)
    model = docs.sparkSession.sparkContext.broadcast(model)

    def probability(column: pa.Array) -> np.ndarray:
        x = pooled([slots_of(t) for t in common.byte_texts(column)], vectors.value)
        return model.value(x) if callable(model.value) else np.full(len(x), model.value)

    return probability


def accept(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``, all columns kept."""
    probability = _scorer(docs, labels)
    return common.filter_rows(docs, __name__, lambda text: probability(text) >= threshold, "text")


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted for each row.

    Null and empty texts have zero features and the score the network gives to them.
    Without labels of both classes the score is the share of label 1, or 0.5. A doc_id
    labelled twice counts as good if one label says so; null labels are no labels.
    """
    probability = _scorer(docs, labels)

    def run(batches):
        common.only(__name__)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(probability(b.column(1)))], ["doc_id", "score"])

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", common.held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
