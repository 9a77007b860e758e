"""Toxicity by class-conditional Kneser-Ney models.

Expressions are words, modelled by their letters: ``ORDER``-grams inside a padded,
lower-case word, counted apart in toxic and in ordinary labelled documents. Both
models back off to one Kneser-Ney model whose counts they share (continuation counts
of both classes together), with the discount's mass and ``SHARED`` more counts of it,
so a rare expression has nearly the same likelihood in either.

A toxic document is mostly ordinary words: its model draws a share of words from the
toxic letters' model and the others from the ordinary one. A document's figure is the
difference of its two log-likelihoods, by length: the mean over its words of
log(1 - share + share * P(word | toxic) / P(word | ordinary)). A logistic scale over the
logarithm of that figure (above its least value) turns it into a score. The scale, the
share (one of ``SHARES``) and the share of wrong labels (one of ``NOISES``) are those
under which the labels are likeliest of the rows of the learning fold that are left out
of the counts; held-out rows take no part in any choice.

Counts cover all other labelled rows of the learning fold and grow with them. The table
of ratios is broadcast only while its counted rows are within ``TABLE_ROWS``; beyond it
distinct words are scored by joins and so are documents.
"""

from __future__ import annotations

import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

ORDER = 6
DISCOUNT = 0.75
SHARED = 30.0
#: Shares of a toxic document's words, drawn from the toxic letters' model, that are tried.
SHARES = tuple(10 ** (-k / 2) for k in range(1, 8))
#: Shares of wrong labels, either way, that are tried.
NOISES = (0.002, 0.01, 0.02, 0.05, 0.1)
#: Grams (12 bytes each in the driver and in a worker) up to which the table is broadcast.
TABLE_ROWS = 4_000_000
#: One labelled row of so many is left out of the counts, for the scale.
SCALE_PART = 8
#: Labelled rows up to which the labels are broadcast; beyond it the join shuffles.
BROADCAST_LABELS = 1_000_000
#: Labelled rows that fit the scale, at most; they are those of smallest hash.
SCALE_ROWS = 20_000
TABLE_ENTRIES = 150_000

PAD, END = "\x02", "\x03"
_find = re.compile(r"[^\W_]+").findall
_P = common.mix(np.arange(1, ORDER + 1, dtype=np.uint64) * common.M1) | np.uint64(1)


def words_of(chunk: bytes) -> list[str]:
    return _find(chunk.decode("utf-8", "replace").lower())


# -------------------------------------------------------------------- counts

def _class_words(batches):
    """(word, toxic, ordinary) counts; equal words of one task come together up to a bound."""
    counts: dict[str, list[int]] = {}

    def out():
        rows = list(counts.items())
        counts.clear()
        return pa.RecordBatch.from_arrays([pa.array([w for w, _ in rows], pa.string()), pa.array([c[1] for _, c in rows], pa.int64()), pa.array([c[0] for _, c in rows], pa.int64())], ["word", "toxic", "ordinary"])

    for b in batches:
        for text, toxic in zip(common.byte_texts(b.column(0)), b.column(1).to_pylist(), strict=True):
            for w in _find(text.decode("utf-8", "replace").lower()):
                c = counts.get(w)
                if c is None:
                    c = counts[w] = [0, 0]
                c[toxic] += 1
        if len(counts) > TABLE_ENTRIES:
            yield out()
    yield out()


def gram_counts(learned: DataFrame) -> DataFrame:
    """gram, toxic, ordinary from (text, label) rows."""
    words = learned.select("text", F.col("label").cast("int").alias("label")).mapInArrow(_class_words, "word string, toxic long, ordinary long")
    words = words.groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))
    padded = F.concat(F.lit(PAD * (ORDER - 1)), "word", F.lit(END))
    grams = words.select("toxic", "ordinary", padded.alias("s")).select("toxic", "ordinary", "s", F.explode(F.sequence(F.lit(1), F.length("s") - (ORDER - 1))).alias("i"))
    return grams.select(F.substring("s", F.col("i"), F.lit(ORDER)).alias("gram"), "toxic", "ordinary").groupBy("gram").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))


def ratios(grams: DataFrame) -> DataFrame:
    """(gram, ratio): log-likelihood ratios of grams, and of a context's unseen grams,
    whose key is the context alone."""
    d = DISCOUNT
    # shared lower orders, from continuation counts
    levels, level = {}, grams.select("gram")
    for n in range(ORDER - 1, 0, -1):
        level = common.materialise(level.groupBy(F.substring("gram", 2, n).alias("gram")).agg(F.count("*").alias("k")), f"continuations-{n}")
        levels[n] = level
    total = levels[1].agg(F.sum("k")).first()[0] or 1
    lower = levels[1].select("gram", (F.col("k") / total).alias("p"))
    for n in range(2, ORDER):
        own = levels[n].select("gram", "k", F.substring("gram", 1, n - 1).alias("h"), F.substring("gram", 2, n - 1).alias("s"))
        context = own.groupBy("h").agg(F.sum("k").alias("hk"), F.count("*").alias("ht"))
        own = own.join(context, "h").join(lower.withColumnRenamed("gram", "s"), "s")
        p = (F.greatest(F.col("k") - d, F.lit(0.0)) + d * F.col("ht") * F.col("p")) / F.col("hk")
        lower = common.materialise(own.select("gram", p.alias("p")), f"lower-{n}")
    own = grams.select("*", F.substring("gram", 1, ORDER - 1).alias("h"), F.substring("gram", 2, ORDER - 1).alias("s"))
    some = lambda c: F.sum(F.when(F.col(c) > 0, 1).otherwise(0))
    context = own.groupBy("h").agg(F.sum("toxic").alias("ht"), F.sum("ordinary").alias("ho"), some("toxic").alias("nt"), some("ordinary").alias("no"), F.count("*").alias("n"))
    context = common.materialise(context, "contexts")
    own = own.join(context, "h").join(lower.withColumnRenamed("gram", "s"), "s")
    c, h = F.col("toxic") + F.col("ordinary"), F.col("ht") + F.col("ho")
    shared = (F.greatest(c - d, F.lit(0.0)) + d * F.col("n") * F.col("p")) / h
    own = own.withColumn("shared", shared)
    seen = lambda c, h, n: (F.greatest(F.col(c) - d, F.lit(0.0)) + (d * F.col(n) + SHARED) * F.col("shared")) / (F.col(h) + SHARED)
    unseen = lambda h, n: (d * F.col(n) + SHARED) / (F.col(h) + SHARED)
    found = own.select("gram", F.log(seen("toxic", "ht", "nt") / seen("ordinary", "ho", "no")).cast("float").alias("ratio"))
    return common.materialise(found.unionByName(context.select(F.col("h").alias("gram"), F.log(unseen("ht", "nt") / unseen("ho", "no")).cast("float").alias("ratio"))), "ratios")


# ------------------------------------------------------------ scoring by table

def _keys(points: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the ``width`` code points from each place on."""
    n = len(points) - width + 1
    total = np.full(max(n, 0), width, np.uint64)
    for k in range(width):
        total = total + points[k : k + n] * _P[k]
    return common.mix(total)


def _points(s: str) -> np.ndarray:
    return np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def _hashed(batches):
    for b in batches:
        grams = b.column(0).to_pylist()
        keys = np.zeros(len(grams), np.uint64)
        for width in (ORDER, ORDER - 1):
            at = np.array([i for i, g in enumerate(grams) if len(g) == width], np.int64)
            if len(at):
                keys[at] = _keys(_points("".join(grams[i] for i in at)), width)[::width]
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), b.column(1)], ["key", "ratio"])


def ratio_table(ratios: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of grams and their ratios; grams are hashed on executors."""
    got = ratios.select("gram", "ratio").mapInArrow(_hashed, "key long, ratio float").toArrow()
    keys, value = got["key"].to_numpy().view(np.uint64), got["ratio"].to_numpy().astype(np.float32)
    order = np.argsort(keys)
    return keys[order], value[order]


def word_ratios(words: list[str], table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Toxic less ordinary log-likelihood of each word."""
    if not words or not len(table[0]):
        return np.zeros(len(words))
    keys, value = table
    pad = PAD * (ORDER - 1)
    points = _points("".join(pad + w + END for w in words))
    grams = _keys(points, ORDER)
    real = np.flatnonzero(points[ORDER - 1 :] != ord(PAD))
    contexts = _keys(points, ORDER - 1)[real]
    grams = grams[real]

    def look(k):
        at = np.minimum(np.searchsorted(keys, k), len(keys) - 1)
        return keys[at] == k, value[at]

    hit, got = look(grams)
    miss = np.flatnonzero(~hit)
    if len(miss):
        hit2, got2 = look(contexts[miss])
        got = got.copy()
        got[miss] = np.where(hit2, got2, 0)
    start = np.concatenate([[0], np.cumsum([len(w) + 1 for w in words])[:-1]])
    return np.add.reduceat(got.astype(np.float64), start)


def mixture(ratio: np.ndarray, share: float) -> np.ndarray:
    """Log of a word's likelihood in a toxic document over that in an ordinary one."""
    return np.log(1 - share + share * np.exp(ratio))


class _Chunks(dict):
    """Chunk of text to a row of an array: its words, their plain ratios, and their mixture for each share."""

    def __init__(self, table, shares):
        self.table, self.shares = table, shares
        self.sums = np.zeros((0, 2 + len(shares)))

    def learn(self, chunks) -> None:
        if len(self) > TABLE_ENTRIES:
            self.clear()
        known = 0 if not len(self) else len(self.sums)
        new = [c for c in chunks if c not in self]
        lists = [words_of(c) for c in new]
        flat = [w for own in lists for w in own]
        n = np.array([len(x) for x in lists], np.int64)
        ratio = word_ratios(flat, self.table)
        of = np.repeat(np.arange(len(new)), n)
        columns = [n, np.bincount(of, ratio, len(new))] + [np.bincount(of, mixture(ratio, s), len(new)) for s in self.shares]
        self.update(zip(new, range(known, known + len(new)), strict=True))
        self.sums = np.concatenate([self.sums[:known], np.column_stack(columns)])


_chunks: dict[str, _Chunks] = common.cache(__name__, {})


def _features(table_of, shares):
    """Of (doc_id, text) rows: words, log-likelihood difference of the letters' models alone, and
    those of the document models with each of ``shares``."""

    name = uuid.uuid4().hex

    def run(batches):
        common.only(__name__)
        if name not in _chunks:
            _chunks.clear()
            _chunks[name] = _Chunks(table_of.value, shares)
        known = _chunks[name]
        for b in batches:
            split = [t.split() for t in common.byte_texts(b.column(1))]
            known.learn({c for own in split for c in own})
            out = np.zeros((len(split), 2 + len(shares)))
            for i, own in enumerate(split):
                out[i] = known.sums[np.fromiter(map(known.__getitem__, own), np.int64, len(own))].sum(0)
            ends = np.arange(len(split) + 1, dtype=np.int32) * len(shares)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out[:, 0].astype(np.int64)), pa.array(out[:, 1]), pa.ListArray.from_arrays(pa.array(ends), pa.array(out[:, 2:].ravel()))], ["doc_id", "n_words", "log_ratio", "gains"])

    return run


FEATURES = "doc_id long, n_words long, log_ratio double, gains array<double>"


# ------------------------------------------------------------ scoring by joins

def _doc_chunks(batches):
    for b in batches:
        ids, chunks, n = [], [], []
        for doc, text in zip(b.column(0).to_pylist(), common.byte_texts(b.column(1)), strict=True):
            own: dict[bytes, int] = {}
            for c in text.split():
                own[c] = own.get(c, 0) + 1
            ids += [doc] * len(own)
            chunks += own.keys()
            n += own.values()
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(chunks, pa.binary()), pa.array(n, pa.int64())], ["row", "chunk", "n"])


def _chunk_words(batches):
    for b in batches:
        chunk, word, place = [], [], []
        for c in b.column(0).to_pylist():
            for k, w in enumerate(words_of(c)):
                chunk.append(c)
                word.append(w)
                place.append(k)
        yield pa.RecordBatch.from_arrays([pa.array(chunk, pa.binary()), pa.array(word, pa.string()), pa.array(place, pa.int32())], ["chunk", "word", "place"])


def features_by_joins(docs: DataFrame, ratios: DataFrame, shares) -> DataFrame:
    """The same features without a table in memory: distinct words join the ratios of
    their grams, documents' distinct chunks join those of their words. Figures of words and
    of chunks are written first, so that a join can be split where a word is in many rows."""
    keyed = common.materialise(docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row")), "rows")
    own = common.materialise(keyed.select("row", "text").mapInArrow(_doc_chunks, "row long, chunk binary, n long"), "document-chunks")
    words = own.select("chunk").distinct().mapInArrow(_chunk_words, "chunk binary, word string, place int")
    padded = F.concat(F.lit(PAD * (ORDER - 1)), "word", F.lit(END))
    grams = words.select("word").distinct().select("word", padded.alias("s")).select("word", "s", F.explode(F.sequence(F.lit(1), F.length("s") - (ORDER - 1))).alias("i"))
    grams = grams.select("word", F.substring("s", F.col("i"), F.lit(ORDER)).alias("g"), F.substring("s", F.col("i"), F.lit(ORDER - 1)).alias("h"))
    seen = ratios.select(F.col("gram").alias("g"), F.col("ratio").alias("r1"))
    other = ratios.select(F.col("gram").alias("h"), F.col("ratio").alias("r2"))
    scored = grams.join(seen, "g", "left").join(other, "h", "left").groupBy("word").agg(F.sum(F.coalesce("r1", "r2", F.lit(0.0)).cast("double")).alias("r"))
    scored = common.materialise(scored, "word-figures")
    gains = [F.sum(F.log(1 - s + s * F.exp("r"))).alias(f"g{k}") for k, s in enumerate(shares)]
    chunks = common.materialise(words.join(scored, "word").groupBy("chunk").agg(F.count("*").alias("w"), F.sum("r").alias("r"), *gains), "chunk-figures")
    times = lambda c: F.sum(F.col("n") * F.col(c))
    sums = own.join(chunks, "chunk").groupBy("row").agg(times("w").alias("w"), times("r").alias("r"), *(times(f"g{k}").alias(f"g{k}") for k in range(len(shares))))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    found = keyed.select("row", "doc_id").join(sums, "row", "left")  # a row without words has no sums
    return found.select("doc_id", F.coalesce("w", F.lit(0)).alias("n_words"), zero("r").alias("log_ratio"), F.array(*(zero(f"g{k}") for k in range(len(shares)))).alias("gains"))


# ---------------------------------------------------------------------- score

#: What keeps the logarithm of a figure at its least value finite.
TINY = 1e-6


def figure(gain: np.ndarray, n_words: np.ndarray, share: float) -> np.ndarray:
    """Logarithm of the length-normalised difference, above its least value."""
    return np.log(np.maximum(gain / np.maximum(n_words, 1) - np.log(1 - share), 0) + TINY)


def fit_scale(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float, float]:
    """(log-likelihood, slope, middle, share of wrong labels) of the logistic curve that makes
    the labels likeliest: the best of a grid, and of a finer one around it."""
    order = np.argsort(x)
    x, y = x[order], y[order]
    noise = np.array(NOISES)[:, None]

    def best(slopes, middles):
        found = (-np.inf, 0.0, 0.0, 0.0)
        for k in slopes:
            for m in middles:
                p = noise + (1 - 2 * noise) / (1 + np.exp(-np.clip(k * (x - m), -30, 30)))
                like = np.log(np.where(y == 1, p, 1 - p)).sum(1)
                at = int(like.argmax())
                found = max(found, (float(like[at]), float(k), float(m), NOISES[at]))
        return found

    _, k, m, _ = best(np.exp(np.linspace(-1, 4, 16)), np.linspace(x[0], x[-1], 41))
    step = (x[-1] - x[0]) / 40
    return best(k * np.exp(np.linspace(-0.33, 0.33, 9)), np.linspace(m - step, m + step, 21))


def fit_model(gains: np.ndarray, n_words: np.ndarray, y: np.ndarray) -> tuple[float, float, float, float]:
    """(share, slope, middle, share of wrong labels) under which the labels are likeliest; ``gains``
    has a column for each of ``SHARES``. Of shares as good as each other the largest is taken."""
    found = [fit_scale(figure(g, n_words, s), y) for s, g in zip(SHARES, gains.T, strict=True)]
    at = int(np.argmax([round(f[0], 6) for f in found]))
    return SHARES[at], *found[at][1:]


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, table_rows: int = TABLE_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted, n_words, gain_per_word (the figure behind the
    score) and log_ratio_per_word (of the letters' models alone) for each row.

    A null or empty text has the score of the figure 0, that of words which are equally
    likely in both. Where the labelled rows left out of the counts are of one class all of
    them fit the scale; without labels of both classes every score is 0. A doc_id labelled twice counts as toxic if one label says so; null labels
    are no labels. Without a scale the share is the first of ``SHARES``.
    """
    spark = docs.sparkSession
    common.prepare(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("label")).filter("label IN (0, 1) AND doc_id IS NOT NULL").filter(common.learn_fold()).groupBy("doc_id").agg(F.max("label").alias("label"))
    known = common.materialise(known, "labels")
    for_scale = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(SCALE_PART)) == 0
    learned = docs.join(common.broadcast_if_small(known.filter(~for_scale), BROADCAST_LABELS), "doc_id")
    table = ratios(common.materialise(gram_counts(learned), "grams"))
    if table.count() <= table_rows:
        shared = spark.sparkContext.broadcast(ratio_table(table))
        features = lambda d, shares: d.select("doc_id", "text").mapInArrow(_features(shared, shares), FEATURES)
    else:
        features = lambda d, shares: features_by_joins(d, table, shares)
    for rows in (known.filter(for_scale), known):  # all of them only where those left out are of one class
        sample = F.broadcast(common.smallest(rows, SCALE_ROWS))
        sample = features(docs.join(sample, "doc_id"), SHARES).join(sample, "doc_id").select("gains", "n_words", "label").toArrow()
        y = sample["label"].to_numpy()
        if len(y) and y.min() != y.max():
            break
    if len(y) == 0 or y.min() == y.max():
        share, slope, middle = SHARES[0], 0.0, None
    else:
        gains = sample["gains"].combine_chunks().flatten().to_numpy().reshape(-1, len(SHARES))
        share, slope, middle, _ = fit_model(gains, sample["n_words"].to_numpy(), y)
    n = F.greatest(F.col("n_words"), F.lit(1))
    per_word = F.col("gains")[0] / n
    x = F.log(F.greatest(per_word - float(np.log(1 - share)), F.lit(0.0)) + TINY)
    z = F.lit(-30.0) if middle is None else slope * (x - middle)
    out = features(docs, (share,)).withColumn("score", 1 / (1 + F.exp(-z)))
    return out.select("doc_id", common.held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_words", per_word.alias("gain_per_word"), (F.col("log_ratio") / n).alias("log_ratio_per_word"))
