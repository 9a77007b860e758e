"""Benchmark decontamination by templates.

A text becomes a row of canonical words: numbers, units after a number, and names
(capitalised words inside a sentence) turn into typed placeholders, all else is lower
case. Windows of ``WINDOW`` canonical words, and of a third of a shorter item, five at least, are hashed
and joined to those of the benchmark. Windows of one document and item that lie on
diagonals near each other (words were put in or left out between them) are an alignment;
it holds only diagonals where each value of the item stands for one value of the document
throughout, so a question with new numbers and names is caught, while a chance match
of placeholders is not. A plain form (names kept as words) is joined in the same way,
for passages whose case was changed or cut. A document is contaminated by an item of
whose words at least ``COVERAGE`` lie in an alignment's windows.

Placeholders say little, so a part of an item counts only with ``LEAST_LITERALS`` different
words besides them, and the whole of one with ``WHOLE_LITERALS``. What is short or made of numbers
is found in a third, exact form: windows of the words and numbers as they are, the whole
of an item of up to ``WINDOW`` words, with no such condition.

A benchmark within ``BLOCK_BYTES`` of text is held in memory by the tasks of one pass over
the documents, and no row is shuffled. Beyond it, windows of documents that pass a filter
of fixed size join those of the items by hash, and pairs of a document and an item that
share enough of them are aligned.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WINDOW = 10
#: Words of the narrowest window, but for items that are shorter and taken whole.
LEAST_WORDS = 5
COVERAGE = 0.5
#: Share of placeholders above which a window of a part of an item is joined in its exact form only.
MOST_SLOTS = 0.5
#: Different words besides placeholders that an alignment must cover, in part and in whole.
LEAST_LITERALS, WHOLE_LITERALS = 5, 2
#: Characters of all items together up to which tasks hold the benchmark.
BLOCK_BYTES = 2_000_000
#: Bits of the filter of window hashes where the benchmark is larger.
FILTER_BITS = 26
TABLE_ENTRIES = 200_000

# Units that count as such after a number.
UNITS = frozenset(
    "mm cm dm m km inch inches in foot feet ft yard yards mile miles g kg mg gram grams kilogram kilograms lb lbs pound pounds ounce ounces oz ton tons tonnes"
    " s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years"
    " l ml liter liters litre litres gallon gallons cup cups pint pints quart quarts"
    " dollar dollars cent cents euro euros usd eur gbp percent degree degrees celsius fahrenheit kelvin"
    " hz khz mhz ghz w kw watt watts v volt volts j joule joules n newton newtons pa kpa mph kmh bit bits byte bytes kb mb gb tb".split()
)
NUMBER, UNIT, NAME = (np.uint64(x) for x in (0xA5A5000000000001, 0xA5A5000000000002, 0xA5A5000000000003))

_find = re.compile(r"\d+(?:[.,]\d+)*|[^\W\d_][^\W_]*").findall
_tail = re.compile(r"[.!?][^\w\s]*$").search
_P = common.mix(np.arange(1, 65, dtype=np.uint64) * common.M1) | np.uint64(1)
_FILTER = (1 << 20) - 1


class _Chunks(dict):
    """Chunk between spaces to packed pairs (word hash, flags): 1 number, 2 unit, 4 capitalised, 8 ends a sentence."""

    def __missing__(self, chunk: bytes) -> bytes:
        text = chunk.decode("utf-8", "replace")
        tokens = _find(text)
        out = []
        for k, t in enumerate(tokens):
            low = t.lower()
            flags = (1 if t[0].isdigit() else 0) | (2 if low in UNITS else 0) | (4 if len(t) > 1 and t[0].isupper() and t[1:].islower() else 0)
            if k == len(tokens) - 1 and _tail(text):
                flags |= 8
            out += [xxhash.xxh3_64_intdigest(low.encode()), flags]
        found = self[chunk] = np.array(out, np.uint64).tobytes()
        return found


_chunks = common.cache(__name__, _Chunks())


def canonical(*texts: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of texts one after another, their typed and their plain canonical forms,
    and the text that each word is of."""
    if len(_chunks) > TABLE_ENTRIES:
        _chunks.clear()
    packed = [b"".join(map(_chunks.__getitem__, t.split())) for t in texts]
    pairs = np.frombuffer(b"".join(packed), np.uint64).reshape(-1, 2)
    of = np.repeat(np.arange(len(texts)), [len(p) // 16 for p in packed])
    word, flags = pairs[:, 0], pairs[:, 1].astype(np.uint8)
    number, first = (flags & 1) > 0, np.ones(len(of), bool)
    first[1:] = of[1:] != of[:-1]
    start, after = first.copy(), np.zeros(len(of), bool)
    start[1:] |= (flags[:-1] & 8) > 0
    after[1:] = number[:-1] & ~first[1:]
    unit, name = ((flags & 2) > 0) & after, ((flags & 4) > 0) & ~start
    plain = np.where(number, NUMBER, word)
    return word, np.where(unit, UNIT, np.where(name & ~number, NAME, plain)), plain, of


def window_hashes(canon: np.ndarray, width: int) -> np.ndarray:
    return next(h for _, h in windows_of(canon, [width]))


def windows_of(canon: np.ndarray, widths: list[int]):
    """(width, hashes of its windows) for rising widths; a width's sums go on from the last one's."""
    total, done = np.zeros(len(canon), np.uint64), 0
    for width in widths:
        n = max(len(canon) - width + 1, 0)
        total = total[:n]
        for k in range(done, width):
            total = total + canon[k : k + n] * _P[k]
        done = width
        yield width, common.mix(total + np.uint64(width))


def item_windows(form, window: int = WINDOW):
    """(kind, width, hashes, places) of the windows by which an item is found. Kind 0 is the
    exact form, which is left out where the plain one is the same and as good."""
    n = len(form[0])
    if n == 0:
        return
    slots = [np.zeros(n, bool), *(np.isin(form[kind], (NUMBER, UNIT, NAME)) for kind in (1, 2))]
    if n < LEAST_WORDS or slots[2].any() or len(np.unique(form[0])) < LEAST_LITERALS:
        yield 0, min(window, n), window_hashes(form[0], min(window, n)), np.arange(n - min(window, n) + 1)
    for width in {min(window, n), min(window, n, max(LEAST_WORDS, n // 3))}:
        for kind in (1, 2):
            share = np.convolve(slots[kind].astype(np.int64), np.ones(width, np.int64), "valid") / width
            at = np.flatnonzero((share <= MOST_SLOTS) | (width == n))
            yield kind, width, window_hashes(form[kind], width)[at], at


class Templates:
    """The windows of a block of items: (hash, item, place) sorted by hash, for each width and form."""

    def __init__(self, items: list[tuple[int, str]], window: int = WINDOW):
        self.ids = [i for i, _ in items]
        self.forms = [canonical((t or "").encode()) for _, t in items]
        rows: dict[tuple[int, int], list] = {}
        for k, form in enumerate(self.forms):
            for kind, width, h, at in item_windows(form, window):
                rows.setdefault((width, kind), []).append((h, np.full(len(at), k), at))
        self.tables = {}
        for key, parts in rows.items():
            h, item, place = (np.concatenate(c) for c in zip(*parts, strict=True))
            order = np.argsort(h, kind="stable")
            seen = np.zeros(_FILTER + 1, bool)
            seen[(h & np.uint64(_FILTER)).astype(np.int64)] = True
            self.tables[key] = (h[order], item[order], place[order], seen)

    def windows(self, form):
        """(kind, width, hashes) of a text's windows for each of the tables."""
        for kind in sorted({kind for _, kind in self.tables}):
            for width, h in windows_of(form[kind], sorted(w for w, of in self.tables if of == kind)):
                yield kind, width, h

    def likely(self, texts: list[bytes]) -> list[int]:
        """Places of the texts that share a window with an item; all texts are hashed together."""
        form, found = canonical(*texts), []
        of = form[3]
        for kind, width, h in self.windows(form):
            keys, _, _, seen = self.tables[width, kind]
            at = np.flatnonzero(seen[(h & np.uint64(_FILTER)).astype(np.int64)])
            at = at[of[at] == of[at + width - 1]]
            if len(at) and len(keys):
                at = at[keys[np.minimum(np.searchsorted(keys, h[at]), len(keys) - 1)] == h[at]]
                found.append(of[at])
        return np.unique(np.concatenate(found)).tolist() if found else []

    def all_matches(self, texts: list[bytes]) -> dict[int, list]:
        """Place of a text to its matches, for those that have any."""
        return {k: m for k in self.likely(texts) if (m := self.matches(texts[k]))}

    def matches(self, text: bytes) -> list[tuple[int, float, int, bool]]:
        """(item_id, coverage, windows, reparameterised) of the items in a text."""
        form, diagonals = canonical(text), {}
        for kind, width, h in self.windows(form):
            keys, item, place, seen = self.tables[width, kind]
            at = np.flatnonzero(seen[(h & np.uint64(_FILTER)).astype(np.int64)])
            if not len(at):
                continue
            lo, hi = np.searchsorted(keys, h[at]), np.searchsorted(keys, h[at], "right")
            for p, x, y in zip(at[hi > lo].tolist(), lo[hi > lo].tolist(), hi[hi > lo].tolist(), strict=True):
                for r in range(x, y):
                    diagonals.setdefault((int(item[r]), kind, p - int(place[r]), width), []).append(int(place[r]))
        parts: dict[int, list] = {}
        for (k, kind, shift, width), places in diagonals.items():
            parts.setdefault(k, []).append((shift, kind, width, places))
        best = {k: m for k, own in parts.items() if (m := self._best(k, own, form[0]))}
        return [(self.ids[k], *best[k]) for k in sorted(best)]

    def _best(self, k: int, parts: list, text: np.ndarray) -> tuple[float, int, bool] | None:
        """The alignment of an item that covers most: around each diagonal, those near it are
        added, largest first, as far as their slots agree. None if none counts."""
        own = self.forms[k][0]
        n, pieces = len(own), []
        kinds = [np.zeros(n, bool), *(np.isin(self.forms[k][kind], (NUMBER, UNIT, NAME)) for kind in (1, 2))]
        total, plain, exact = np.zeros(n, bool), np.zeros(n, bool), np.zeros(n, bool)
        for kind, width, p in {(kind, width, p) for _, kind, width, places in parts for p in places}:
            total[p : p + width] = True
            plain[p : p + width] |= ~kinds[kind][p : p + width]
            if kind == 0:
                exact[p : p + width] = True

        def enough(covered, literal, exact):
            share = float(covered.mean())
            least = WHOLE_LITERALS if share == 1.0 else LEAST_LITERALS
            return share if share >= COVERAGE and (len(np.unique(own[literal])) >= least or float(exact.mean()) >= COVERAGE) else 0.0

        if not enough(total, plain, exact):
            return None  # not even all together
        for shift, kind, width, places in parts:
            covered = np.zeros(n, bool)
            for p in places:
                covered[p : p + width] = True
            slots = kinds[kind]
            slot, whole = {}, True
            for p in np.flatnonzero(covered & slots).tolist():
                mine, theirs = int(own[p]), int(text[p + shift])
                if slot.setdefault(mine, theirs) != theirs:
                    whole = False
                    break
            if whole:
                pieces.append((shift, covered, covered & ~slots, slot, places, covered if kind == 0 else np.zeros(n, bool)))
        pieces.sort(key=lambda p: (-int(p[1].sum()), p[0]))
        near, best = max(WINDOW, n // 2), None
        at = np.array([p[0] for p in pieces])
        for base in pieces:
            covered, literal, same, slot, windows = np.zeros(n, bool), np.zeros(n, bool), np.zeros(n, bool), {}, set()
            around = [base, *(pieces[i] for i in np.flatnonzero(np.abs(at - base[0]) <= near).tolist() if pieces[i] is not base)]
            for _, more, words, values, places, exact in around:
                if all(slot.get(mine, theirs) == theirs for mine, theirs in values.items()):
                    covered, literal, same = covered | more, literal | words, same | exact
                    slot.update(values)
                    windows.update(places)
            share = enough(covered, literal, same)
            if share:
                changed = any(mine != theirs for mine, theirs in slot.items())
                if best is None or (share, len(windows)) > best[:2]:
                    best = (share, len(windows), changed)
                if share == 1.0:
                    break
        return best


SCHEMA = "doc_id long, item_id long, coverage double, n_windows long, reparameterised boolean"
_TYPES = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.bool_())


def _matches(rows: list[tuple], more: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (*more, *_TYPES), strict=True)], names)


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("item_id IS NOT NULL AND text IS NOT NULL")


def _templates(items: DataFrame) -> Templates | None:
    """The templates of a benchmark of bounded size; None if it is larger."""
    if (items.agg(F.sum(F.length("text"))).first()[0] or 0) > BLOCK_BYTES:
        return None
    return Templates([tuple(r) for r in items.orderBy("item_id", "text").collect()])


def _filter(windows: DataFrame) -> np.ndarray:
    """Which hashes may be an item's, by their last ``FILTER_BITS`` bits, 64 in a number."""
    low = F.col("hash").bitwiseAND((1 << FILTER_BITS) - 1)
    bit = F.expr("shiftleft(1L, cast(hash & 63 AS int))")
    got = windows.groupBy(F.shiftright(low, 6).cast("int").alias("at")).agg(F.bit_or(bit).alias("bits")).toArrow()  # of fixed size
    found = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    found[got["at"].to_numpy()] = got["bits"].to_numpy()
    return found


def _by_join(keyed: DataFrame, items: DataFrame, row: str) -> DataFrame:
    """The matches of documents with a column ``row`` that tells them apart: it comes first."""
    spark = keyed.sparkSession
    items = common.materialise(items.distinct().select(F.monotonically_increasing_id().alias("k"), "item_id", "text"), "items")

    def of_items(batches):
        for b in batches:
            for k, text in zip(b.column(0).to_pylist(), common.byte_texts(b.column(1)), strict=True):
                form = canonical(text)
                for kind, width, h, at in item_windows(form):
                    n = len(at)
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.full(n, 16 * kind + width, np.int32)), pa.array(np.full(n, k, np.int64)), pa.array(at.astype(np.int32)), pa.array(np.full(n, len(form[0]), np.int32))], ["hash", "shape", "k", "at", "words"])

    windows = common.materialise(items.select("k", "text").mapInArrow(of_items, "hash long, shape int, k long, at int, words int"), "item-windows")
    shapes = sorted(r[0] for r in windows.select("shape").distinct().collect())  # 3 forms of ``WINDOW`` widths at most
    known = spark.sparkContext.broadcast(_filter(windows))

    def of_docs(batches):
        common.only(__name__)
        for b in batches:
            for k, text in zip(b.column(0).to_pylist(), common.byte_texts(b.column(1)), strict=True):
                form = canonical(text)
                for kind in range(3):
                    for width, h in windows_of(form[kind], [x % 16 for x in shapes if x // 16 == kind]):
                        h = np.unique(h).view(np.int64)
                        low = h & ((1 << FILTER_BITS) - 1)
                        h = h[(known.value[low >> 6] >> (low & 63)) & 1 == 1]
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), k, np.int64)), pa.array(h), pa.array(np.full(len(h), 16 * kind + width, np.int32))], ["r", "hash", "shape"])

    hits = keyed.select(row, "text").mapInArrow(of_docs, "r long, hash long, shape int")
    # words of the item that the shared windows cover, at most: too few can't be an alignment
    most = F.size(F.array_distinct(F.flatten(F.collect_set(F.sequence("at", F.col("at") + F.col("shape") % 16 - 1)))))
    pairs = hits.join(windows, ["hash", "shape"]).groupBy("r", "k", "words").agg(most.alias("most")).filter(F.col("most") >= COVERAGE * F.col("words")).select("r", "k")
    own = keyed.select(F.col(row).alias("r"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("theirs"))
    both = pairs.join(items, "k").join(own, "r").select("r", "doc_id", "theirs", "item_id", "text")

    def align(batches):
        for b in batches:
            rows, theirs, mine = b.select(["r", "doc_id", "item_id"]).to_pylist(), common.byte_texts(b.column(2)), b.column(4).to_pylist()
            found = [(r["r"], r["doc_id"], *m) for r, t, text in zip(rows, theirs, mine, strict=True) for m in Templates([(r["item_id"], text)]).matches(t)]
            yield _matches(found, [pa.int64()], ["r", "doc_id", "item_id", "coverage", "n_windows", "reparameterised"])

    return both.mapInArrow(align, "r long, " + SCHEMA)


def find(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each document and each benchmark item that it holds: doc_id, item_id,
    coverage (share of the item's words), n_windows, reparameterised.

    Clean documents, null and empty texts have no row. A row with a null doc_id that
    holds an item keeps its null id. Repeated rows give repeated results. Items without
    id, text or any word match nothing; every other item is found where it stands word
    for word, one of a single word too. An item_id given twice may be found by either text.
    """
    spark = docs.sparkSession
    common.prepare(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    held = _templates(_items(benchmark))
    if held is None:
        keyed = common.materialise(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"), "documents")
        return _by_join(keyed, _items(benchmark), "row").drop("r")
    templates = spark.sparkContext.broadcast(held)

    def run(batches):
        common.only(__name__)
        for b in batches:
            docs = b.column(0)
            rows = [(docs[k].as_py(), *m) for k, own in templates.value.all_matches(common.byte_texts(b.column(1))).items() for m in own]
            yield _matches(rows, [], [f.split()[0] for f in SCHEMA.split(", ")])

    return docs.mapInArrow(run, SCHEMA)


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no item, all columns kept."""
    spark = docs.sparkSession
    common.prepare(spark)
    held = _templates(_items(benchmark))
    if held is None:
        row = common.fresh(docs, "row")
        keyed = common.materialise(docs.withColumn(row, F.monotonically_increasing_id()), "documents")
        return keyed.join(_by_join(keyed, _items(benchmark), row).select(F.col("r").alias(row)), row, "left_anti").select(*docs.columns)
    templates = spark.sparkContext.broadcast(held)

    def keep(column):
        held = np.ones(len(column), bool)
        held[list(templates.value.all_matches(common.byte_texts(column)))] = False
        return held

    return common.filter_rows(docs, __name__, keep, "text")
