"""Periodic runs of words: stretches that repeat themselves four times or more.

A run is a stretch of consecutive words with smallest period q, of length at least
``max(6, 4 q)``, that no word beside it continues. Runs are found with a suffix automaton of
the words. The end positions of its states are ordered sets, merged up the suffix links,
the smaller into the larger. Two ends that become neighbours in a state of length L, d
apart and d <= L, end a square of period d; it begins where the state's string does, since
the two ends have no longer string in common. A run's last square is always such a pair: its
strings overlap by more than two periods, so no end lies between them. Squares with one
beginning and period are one run, extended to its end; of several periods of one stretch
the smallest is its own.

Four words in a row inside a run come again within a period. So words that no such group
covers can't be in a run, and the automaton is built only of the stretches between them.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WORD = r"[^\x20\x09-\x0D]+"
LEAST, TIMES = 6, 4
#: Words in the groups that must come again.
GROUP = 4
#: Elements of a part of an ordered set.
PART = 2048
SCHEMA = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


class Ends:
    """An ordered set in parts, so that an insertion moves few elements."""

    def __init__(self, ends: list[int]):
        self.parts = [ends[k : k + PART] for k in range(0, len(ends), PART)]
        self.tops = [p[-1] for p in self.parts]
        self.n = len(ends)

    def __len__(self):
        return self.n

    def __iter__(self):
        for p in self.parts:
            yield from p

    def insert(self, x: int) -> tuple[int | None, int | None]:
        """Puts in ``x`` and gives its neighbours."""
        at = min(bisect_left(self.tops, x), len(self.parts) - 1)
        part = self.parts[at]
        k = bisect_left(part, x)
        below = part[k - 1] if k else self.tops[at - 1] if at else None
        above = part[k] if k < len(part) else self.parts[at + 1][0] if at + 1 < len(self.parts) else None
        part.insert(k, x)
        self.n += 1
        if len(part) > 2 * PART:
            self.parts[at : at + 1] = [part[:PART], part[PART:]]
            self.tops[at : at + 1] = [part[PART - 1], part[-1]]
        else:
            self.tops[at] = part[-1]
        return below, above


def automaton(words: list[int]) -> tuple[list[int], list[int], list[int]]:
    """The suffix automaton's states: length, suffix link, and own end position (-1 for clones)."""
    step, length, link, end = [{}], [0], [-1], [-1]
    last = 0
    for i, c in enumerate(words):
        new = len(step)
        step.append({})
        length.append(i + 1)
        link.append(0)
        end.append(i)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                clone = len(step)
                step.append(dict(step[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                end.append(-1)
                link[q] = link[new] = clone
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = clone
                    p = link[p]
        last = new
    return length, link, end


def squares(words: list[int]) -> dict[tuple[int, int], int]:
    """(beginning, period) to the last end seen of squares."""
    length, link, end = automaton(words)
    ends: list = [None if e < 0 else [e] for e in end]
    found: dict[tuple[int, int], int] = {}
    for v in sorted(range(1, len(length)), key=length.__getitem__, reverse=True):
        up, own = link[v], ends[v]
        ends[v] = None
        if up <= 0:
            continue  # the empty string's ends are all positions
        held = ends[up]
        if held is None:
            ends[up] = own
            continue
        small, large = (own, held) if len(own) < len(held) else (held, own)
        most, before = length[up], None
        for x in small:
            if isinstance(large, Ends):
                below, above = large.insert(x)
            else:
                k = bisect_left(large, x)
                below, above = large[k - 1] if k else None, large[k] if k < len(large) else None
                large.insert(k, x)
            # neighbours from the same set have met before, in a longer string
            for low, high in ((below, x), (x, above)):
                if low is not None and high is not None and low != before and high - low <= most:
                    key = (low - most + 1, high - low)
                    if found.get(key, -1) < high:
                        found[key] = high
            before = x
        ends[up] = Ends(large) if isinstance(large, list) and len(large) > 2 * PART else large
    return found


def runs_of(words: list[int]) -> list[tuple[int, int, int]]:
    """(start, length, period) of a stretch's runs, by the automaton."""
    best: dict[tuple[int, int], int] = {}
    for (start, period), high in squares(words).items():
        while high + 1 < len(words) and words[high + 1] == words[high + 1 - period]:
            high += 1
        size = high - start + 1
        if size >= max(LEAST, TIMES * period):
            best[start, size] = min(period, best.get((start, size), period))
    return [(start, size, period) for (start, size), period in best.items()]


def stretches(ids: np.ndarray) -> list[tuple[int, int]]:
    """(from, to) of the stretches that may hold runs: every word is in a group of four that
    comes again within a quarter of the stretch."""
    open_, done = [(0, len(ids))], []
    while open_:
        a, b = open_.pop()
        m = b - a
        if m < LEAST:
            continue
        own = ids[a:b].astype(np.uint64)
        key = np.zeros(m - GROUP + 1, np.uint64)
        for k in range(GROUP):
            key = common.mix(key * np.uint64(3) + own[k : m - GROUP + 1 + k] + np.uint64(1))
        order = np.argsort(key, kind="stable")
        near = (key[order][1:] == key[order][:-1]) & (TIMES * np.diff(order) <= m)
        if not near.any():
            continue
        depth = np.zeros(m + 1, np.int64)
        begins = np.union1d(order[:-1][near], order[1:][near])
        depth[begins] += 1
        depth[begins + GROUP] -= 1
        covered = np.concatenate([[0], (np.cumsum(depth[:m]) > 0).astype(np.int8), [0]])
        edges = np.flatnonzero(np.diff(covered))
        parts = [(a + int(s), a + int(e)) for s, e in zip(edges[::2], edges[1::2], strict=True)]
        if parts == [(a, b)]:
            done.append((a, b))
        else:
            open_ += parts
    return done


def find_runs(words: list) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a list of words, by start, then period."""
    number: dict = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    found = [(a + s, size, q) for a, b in stretches(ids) for s, size, q in runs_of(ids[a:b].tolist())]
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapse(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words without those that a run holds after its first period."""
    gone = np.zeros(len(words) + 1, np.int64)
    for start, size, q in runs:
        gone[start + q] += 1
        gone[start + size] -= 1
    return [w for w, g in zip(words, np.cumsum(gone).tolist(), strict=False) if not g]


def _rows(batches):
    common.only("repeats")
    for b in batches:
        texts = [t.split() for t in common.byte_texts(b.column(1))]  # bytes split at ASCII white space only
        runs = [find_runs(t) for t in texts]
        kept = [b" ".join(collapse(t, r)).decode("utf-8", "replace") for t, r in zip(texts, runs, strict=True)]
        arrays = pa.array([[dict(zip(("start", "length", "period"), r, strict=True)) for r in own] for own in runs], pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t) for t in texts], pa.int64()), arrays, pa.array(kept, pa.string())], ["doc_id", "n_words", "runs", "collapsed"])


def repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) for every row: the runs by start, then period, and
    the text without repetitions, words joined by one space.

    A null text has no words; rows that repeat are rows of their own; an empty table gives no
    rows; columns besides doc_id and text aren't looked at. Memory grows with the longest
    stretch that may hold runs, some 0.8 KB a word. Nothing is shuffled.
    """
    common.prepare(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_rows, SCHEMA)


def echoed(docs: DataFrame) -> DataFrame:
    """(doc_id, text): one text of ten made to repeat itself from a word on. With h the crc32
    of the id and g = h div 10, where h mod 10 is 0 each word i from a = g mod n on becomes
    word a + (i - a) mod p of the text, p = 1 + (n - a) div (3 + g mod 8). A null id has no h."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = docs.select("doc_id", "text", h.alias("h")).withColumn("words", F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit(WORD), F.lit(0))))
    rows = rows.withColumn("n", F.size("words")).withColumn("g", F.floor(F.col("h") / 10))
    some = F.col("n") > 0
    rows = rows.withColumn("a", F.when(some, F.col("g") % F.col("n")).cast("int"))
    rows = rows.withColumn("p", F.when(some, 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    place = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p"))
    said = F.array_join(F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.get("words", place(i))), " ")
    return rows.select("doc_id", F.when(some, said).otherwise(F.col("text")).alias("text"))


def digest(found: DataFrame) -> DataFrame:
    """The number of runs; the one with most periods (ties: by start, then period); sha256 of
    the runs' lines and of the collapsed text."""
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    # exact comparison of length / period by cross products
    more = lambda a, r: F.when(a.isNull() | (r["length"] * a["period"] > a["length"] * r["period"]), r).otherwise(a)
    rows = found.withColumn("top", F.aggregate("runs", F.get("runs", F.lit(0)), more))
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col("top")[c].alias(c) for c in ("start", "length", "period")],
        F.expr("top.length * 1000 div top.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
        "n_words",
    )
