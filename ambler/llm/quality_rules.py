"""Quality rules: counted base rules, then a hashed n-gram likelihood ratio.

Tokens (runs of letters and digits, runs of other signs) give unigrams and bigrams,
hashed into ``BUCKETS`` buckets. Two multinomials over the buckets are counted over
whole tables: one of trusted documents (labelled good, learning fold), one of all
documents. A document's score is the mean log ratio of its n-grams; every document at
or above a threshold passes. The threshold is the one that tells good from bad labelled
documents of the learning fold best, each trusted one scored without its own counts; all of
them fit it, put in order by ranges. So the verdict is a function of the text, the two models
and the threshold. The driver gets one row per bucket.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

BUCKETS = 1 << 16
SMOOTH = 1.0
#: Mean ratio from which a document passes where no labels fit one: half a document of
#: n-grams that trusted text never holds falls below it, rare words by themselves do not.
THRESHOLD = -0.6
MIN_WORDS = 50
REPEAT_PERCENT = 50
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
#: Labelled rows up to which the labels are broadcast; beyond it the join shuffles.
BROADCAST_LABELS = 1_000_000
TABLE_ENTRIES = 150_000

_find = re.compile(r"\w+|[^\w\s]+").findall
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class _Tokens(dict):
    """Chunk of text between spaces to the packed 32-bit hashes of its tokens."""

    def __missing__(self, chunk: bytes) -> bytes:
        found = self[chunk] = np.array([zlib.crc32(t.encode()) for t in _find(chunk.decode("utf-8", "replace"))], np.uint32).tobytes()
        return found


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


_tokens, _words = common.cache(__name__, _Tokens()), common.cache(__name__, _Words())


def buckets_of(words: list[bytes]) -> np.ndarray:
    """Buckets of a document's unigrams and bigrams."""
    if len(_tokens) > TABLE_ENTRIES:
        _tokens.clear()
    h = np.frombuffer(b"".join(map(_tokens.__getitem__, words)), np.uint32).astype(np.uint64)
    grams = np.concatenate([h * _A, h[:-1] * _A + h[1:] * _B + _B])
    return (grams >> np.uint64(48)).astype(np.int64) & (BUCKETS - 1)


def base_rules(text: str, words: list[bytes]) -> tuple[int, int, int, int]:
    """word_chars, n_symbols, n_dup_lines, n_repeat_words of a text and its words."""
    chars = len(text) - sum(map(text.count, SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    dup, seen = 0, set()
    for line in text.split("\n"):
        if line in seen:
            dup += 1
        elif line.strip(SPACES):
            seen.add(line)
    n = len(words)
    if n < 4:  # two equal windows need four words at least
        return chars, symbols, dup, 0
    if len(_words) > TABLE_ENTRIES:
        _words.clear()
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, n)
    window = common.mix(h[:-2] * _A + h[1:-1] * _B + h[2:])
    order = np.argsort(window, kind="stable")
    same = window[order[1:]] == window[order[:-1]]
    twice = np.zeros(n - 2, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : n - 2 + k] |= twice
    return chars, symbols, dup, int(covered.sum())


def _counts(batches):
    common.only(__name__)
    raw, trusted = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for b in batches:
        for text, good in zip(common.byte_texts(b.column(0)), b.column(1).to_pylist(), strict=True):
            found = buckets_of(text.split())
            np.add.at(raw, found, 1)
            if good:
                np.add.at(trusted, found, 1)
    at = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(raw[at]), pa.array(trusted[at])], ["bucket", "raw", "trusted"])


def counted(docs: DataFrame, trusted: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """How often each bucket occurs in all documents and in the trusted ones, of which
    ``trusted`` has the doc_ids."""
    flagged = docs.join(common.broadcast_if_small(trusted.withColumn("good", F.lit(True)), BROADCAST_LABELS), "doc_id", "left")
    got = flagged.select("text", "good").mapInArrow(_counts, "bucket int, raw long, trusted long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("trusted").alias("trusted")).toArrow()
    raw, good = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    raw[got["bucket"].to_numpy()] = got["raw"].to_numpy()
    good[got["bucket"].to_numpy()] = got["trusted"].to_numpy()
    return raw, good


def log_ratios(raw: np.ndarray, trusted: np.ndarray) -> np.ndarray:
    """Log of trusted over raw probability for each bucket, smoothed; zeros without trusted text."""
    if trusted.sum() == 0:
        return np.zeros(BUCKETS)
    p = lambda c: (c + SMOOTH) / (c.sum() + SMOOTH * BUCKETS)
    return np.log(p(trusted)) - np.log(p(raw))


def ratio_without(found: np.ndarray, raw: np.ndarray, trusted: np.ndarray) -> float | None:
    """Mean log ratio of a trusted document if it weren't trusted; None if no other is."""
    at, own = np.unique(found, return_counts=True)
    rest = trusted.sum() - len(found)
    if rest <= 0 or not len(found):
        return None
    p = (trusted[at] - own + SMOOTH) / (rest + SMOOTH * BUCKETS)
    q = (raw[at] + SMOOTH) / (raw.sum() + SMOOTH * BUCKETS)
    return float((own * (np.log(p) - np.log(q))).sum() / len(found))


def best_cut(ratio: np.ndarray, label: np.ndarray) -> float | None:
    """The middle of the widest gap between ratios among those by which the misjudged shares
    of both classes add up to the least. None where a class is missing or no gap tells them
    apart better than keeping all."""
    order = np.lexsort((label, ratio))
    x, y = ratio[order], label[order]
    good, bad = int(y.sum()), int(len(y) - y.sum())
    if not good or not bad:
        return None
    wrong = np.cumsum(y)[:-1] * bad + (bad - np.cumsum(1 - y)[:-1]) * good  # over good * bad
    gap = np.diff(x)
    wrong[gap <= 0] = good * bad
    if not len(wrong) or wrong.min() >= good * bad:
        return None
    k = np.flatnonzero(wrong == wrong.min())
    k = k[gap[k].argmax()]
    return float((x[k] + x[k + 1]) / 2)


def best_cut_of(scored: DataFrame, parts: int) -> float | None:
    """``best_cut`` of all (label, ratio) rows. Ratios are dealt to ``parts`` tasks by ranges, and sums go
    over a range, then over the ranges, one row each."""
    rows = scored.groupBy("ratio").agg(F.sum("label").cast("long").alias("good"), F.sum(1 - F.col("label")).cast("long").alias("bad"))
    rows = common.materialise(rows.repartitionByRange(parts, "ratio").withColumn("part", F.spark_partition_id()), "ratios")
    spark = scored.sparkSession
    ranges = rows.groupBy("part").agg(F.sum("good").alias("g"), F.sum("bad").alias("b"), F.min("ratio").alias("least"))
    over, before = Window.orderBy("part"), Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("part", F.coalesce(F.sum("g").over(before), F.lit(0)).alias("g"), F.coalesce(F.sum("b").over(before), F.lit(0)).alias("b"), F.lead("least").over(over).alias("follows"))
    good, bad = rows.agg(F.sum("good"), F.sum("bad")).first()
    found = None
    if good and bad:
        inside = Window.partitionBy("part").orderBy("ratio")
        upto = inside.rowsBetween(Window.unboundedPreceding, 0)
        rows_ = rows.withColumns({"good": F.sum("good").over(upto), "bad": F.sum("bad").over(upto), "next": F.lead("ratio").over(inside)}).join(F.broadcast(ranges), "part")
        wrong = (F.col("good") + F.col("g")) * bad + (bad - F.col("bad") - F.col("b")) * good  # over good * bad
        cuts = rows_.select(wrong.alias("wrong"), "ratio", F.coalesce("next", "follows").alias("next")).filter("next IS NOT NULL").filter(F.col("wrong") < good * bad)
        best = cuts.agg(F.min(F.struct("wrong", (F.col("ratio") - F.col("next")).alias("gap"), "ratio", "next")).alias("c")).first().c
        found = None if best is None else (best.ratio + best.next) / 2
    common.drop(spark, rows)
    return found


def fitted_threshold(docs: DataFrame, known: DataFrame, raw: np.ndarray, trusted: np.ndarray) -> float:
    """The cut between good and bad of the (doc_id, label) rows, of documents that pass the base rules."""
    spark = docs.sparkSession
    counts = spark.sparkContext.broadcast((raw, trusted, log_ratios(raw, trusted)))  # one value per bucket

    def run(batches):
        common.only(__name__)
        raw, trusted, table = counts.value
        for b in batches:
            rows = []
            for doc, label, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), common.byte_texts(b.column(2)), strict=True):
                words = text.split()
                found = buckets_of(words)
                if len(found) and not failed(len(words), base_rules(text.decode("utf-8", "replace"), words)[3]):
                    mean = ratio_without(found, raw, trusted) if label else float(table[found].mean())
                    if mean is not None:
                        rows.append((doc, label, mean))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.float64()), strict=True)], ["doc_id", "label", "ratio"])

    scored = docs.select("doc_id", "text").join(common.broadcast_if_small(known, BROADCAST_LABELS), "doc_id").select("doc_id", "label", "text").mapInArrow(run, "doc_id long, label int, ratio double")
    found = best_cut_of(scored.groupBy("doc_id", "label").agg(F.min("ratio").alias("ratio")), common.tasks_for(known))
    return THRESHOLD if found is None else found


def failed(n_words, n_repeat_words):
    """The base rules, of numbers or of arrays."""
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > REPEAT_PERCENT * n_words)


def judge(docs: DataFrame, labels: DataFrame, threshold: float | None = None) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    kept, log_ratio for each row.

    A null or empty text has no words and fails the base rules. A document without
    n-grams has ratio 0. Without trusted documents every ratio is 0 and only the base
    rules judge. Null labels are no labels; a doc_id labelled twice counts as good if one
    label says so. Without a ``threshold`` it is fitted, or ``THRESHOLD`` where the learning
    fold doesn't have documents of both labels that pass the base rules.
    """
    spark = docs.sparkSession
    common.prepare(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label")).filter("label IN (0, 1) AND doc_id IS NOT NULL").filter(common.learn_fold())
    known = common.materialise(known.groupBy("doc_id").agg(F.max("label").alias("label")), "labels")
    raw, trusted = counted(docs, known.filter("label = 1").select("doc_id"))
    least = fitted_threshold(docs, known, raw, trusted) if threshold is None else threshold
    ratio = spark.sparkContext.broadcast(log_ratios(raw, trusted))  # one value per bucket

    def run(batches):
        common.only(__name__)
        table = ratio.value
        for b in batches:
            rows = []
            for raw in common.byte_texts(b.column(1)):
                words = raw.split()
                found = buckets_of(words)
                rows.append((len(words), *base_rules(raw.decode("utf-8", "replace"), words), float(table[found].mean()) if len(found) else 0.0))
            n, chars, symbols, dup, repeat, mean = (np.array(c) for c in zip(*rows, strict=True)) if rows else (np.zeros(0, np.int64),) * 6
            fails = failed(n, repeat)
            cols = [pa.array(c.astype(np.int64)) for c in (n, chars, symbols, dup, repeat)]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols, pa.array(fails), pa.array(~fails & (mean >= least)), pa.array(mean.astype(np.float64))], names)

    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, log_ratio double"
    names = [f.split()[0] for f in schema.split(", ")]
    return docs.mapInArrow(run, schema)
