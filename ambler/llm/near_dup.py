"""Near-duplicate documents by one-permutation hashing.

1. A document is its set of distinct 5-word shingles, as 64-bit hashes. One hash
   orders them all: its top bits choose one of ``BINS`` bins, a bin's value is its
   smallest member. An empty bin takes the value of the first filled bin in a fixed
   random order of its own (optimal densification).
2. Documents with equal sets form a class, whose smallest doc_id stands for it.
3. Bins are cut into bands; a band's values name a bucket. In each bucket one member
   is the centre, the one with most bucket mates, and only centre-member edges become
   candidates: stars, as many edges as rows.
4. Candidates whose signatures can't reach the threshold go; the others are confirmed
   on full sets, and components are joined by alternating large and small stars.
5. Buckets that still hold different components are cut into blocks of bounded size,
   and pairs of blocks are compared in memory: first by signature, which shows the
   members that matter, then these on full sets. A task emits no more links than
   join its members, so no group's pairs are ever written, yet no link between bucket
   mates is lost.

With 128 bins in 32 bands of 4, a pair at 0.75 shares no bucket once in 190,000
pairs, and rarer above it. Nothing is collected to the driver but counts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

WIDTH = 5
PERCENT = 75
BINS = 128
BANDS = 32
#: Share of equal signature values below which a pair is dropped unseen: five
#: standard deviations below 0.75 over 128 bins.
SKETCH_LEAST = 0.55
#: Document ids that may be broadcast to pick texts; beyond it the texts are shuffled.
BROADCAST_IDS = 500_000
TABLE_ENTRIES = 200_000
#: Members of a bucket in one block, about; a task compares two blocks at a time.
BLOCK_ROWS = 256

_P = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
#: Row i: the order in which empty bin i looks for a filled one.
_PROBES = np.array([np.random.default_rng(7919 + i).permutation(BINS) for i in range(BINS)])
_EDGES = np.arange(BINS, dtype=np.uint64) << np.uint64(64 - BINS.bit_length() + 1)


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


_hashes = common.cache(__name__, _WordHash())


def word_hashes(text: bytes) -> np.ndarray:
    words = text.lower().split()  # bytes: A-Z only, ASCII spaces only
    if len(_hashes) > TABLE_ENTRIES:
        _hashes.clear()
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


def shingles(text: bytes) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles; empty without words."""
    h = word_hashes(text)
    n = len(h)
    if n == 0:
        return h
    if n < WIDTH:
        return common.mix(np.array([xxhash.xxh3_64_intdigest(h.tobytes(), seed=n)], np.uint64))
    total = h[: n - WIDTH + 1] * _P[0]
    for k in range(1, WIDTH):
        total = total + h[k : n - WIDTH + 1 + k] * _P[k]
    total = np.sort(common.mix(total))
    return total[np.concatenate([[True], total[1:] != total[:-1]])]


def signature(shingle: np.ndarray) -> np.ndarray:
    """Bin values of a set that isn't empty."""
    start = np.searchsorted(shingle, _EDGES)
    filled = np.append(start[1:], len(shingle)) > start
    value = shingle[np.minimum(start, len(shingle) - 1)]
    empty = np.flatnonzero(~filled)
    if len(empty):
        probe = _PROBES[empty]
        value[empty] = value[probe[np.arange(len(empty)), filled[probe].argmax(1)]]
    return value


def _signatures(batches):
    common.only(__name__)
    rows = BINS // BANDS
    seed = common.mix(np.arange(1, BANDS + 1, dtype=np.uint64))
    for b in batches:
        sets = [shingles(t) for t in common.byte_texts(b.column(1))]
        n = np.array([len(s) for s in sets], np.int64)
        prints = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), np.int64).reshape(-1, 2)
        sig = np.zeros((len(sets), BINS), np.uint64)
        for i, s in enumerate(sets):
            if len(s):
                sig[i] = signature(s)
        keys = np.broadcast_to(seed, (len(sets), BANDS)).copy()
        for k in range(rows):
            keys = common.mix(keys + sig[:, k::rows] * _P[k])
        short = common.mix(sig).astype(np.uint16)
        yield pa.RecordBatch.from_arrays(
            [
                b.column(0),
                pa.array(n),
                pa.array(np.ascontiguousarray(prints[:, 0])),
                pa.array(np.ascontiguousarray(prints[:, 1])),
                pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * BANDS), pa.array(keys.view(np.int64).ravel())),
                pa.array([r.tobytes() for r in short], pa.binary()),
            ],
            ["doc_id", "n_shingles", "fp1", "fp2", "bands", "sketch"],
        )


def _sets(batches):
    common.only(__name__)
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingles(t).tobytes() for t in common.byte_texts(b.column(1))], pa.binary())], ["node", "members"])


def _sketch_filter(batches):
    for b in batches:
        x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint16).reshape(-1, BINS) for i in (2, 3))
        keep = pa.array((x == y).mean(1) >= SKETCH_LEAST)
        yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], ["a", "b"])


def _confirm(batches):
    for b in batches:
        keep = []
        for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(100 * both >= PERCENT * (len(x) + len(y) - both))
        keep = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], ["a", "b"])


def _blocks(batches):
    """Streams the row groups of equal (key, i, j), which come sorted."""
    held = None
    for b in batches:
        keys = np.column_stack([b.column(k).to_numpy() for k in range(3)])
        cuts = np.concatenate([[0], np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1, [len(keys)]]) if len(keys) else []
        for x, y in zip(cuts[:-1], cuts[1:], strict=True):
            rows = pa.Table.from_batches([b.slice(x, y - x)])
            if held is not None and tuple(keys[x]) == held[0]:
                held = (held[0], [*held[1], rows])
            else:
                if held is not None:
                    yield pa.concat_tables(held[1])
                held = (tuple(keys[x]), [rows])
    if held is not None:
        yield pa.concat_tables(held[1])


def _pairs_of_block(t: pa.Table):
    """Places of the pairs of one group that may be links, best first: of different
    components, not compared with the centre before, alike by signature, and of blocks
    i and j (a pair within one block is compared where i = j only)."""
    comp, block, centre = (t.column(c).to_numpy() for c in ("comp", "block", "was"))
    sketch = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint16).reshape(-1, BINS)
    i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
    left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
    alike = np.concatenate([(sketch[left[k : k + 64], None] == sketch[None, right]).mean(2) for k in range(0, len(left), 64)])
    fit = (alike >= SKETCH_LEAST) & (comp[left][:, None] != comp[right]) & ~centre[left][:, None] & ~centre[right]
    if i == j:
        fit &= left[:, None] < right
    x, y = np.nonzero(fit)
    order = np.argsort(-alike[x, y], kind="stable")
    return left[x[order]], right[y[order]]


def _flag(batches):
    """(key, node) of members that have a likely partner."""
    for t in _blocks(batches):
        x, y = _pairs_of_block(t)
        at = np.unique(np.concatenate([x, y]))
        if len(at):
            got = t.take(pa.array(at)).combine_chunks()
            yield pa.RecordBatch.from_arrays([got.column("key").chunk(0), got.column("node").chunk(0)], ["key", "node"])


def _link_blocks(batches):
    """Confirmed links of each group that join different components."""
    for t in _blocks(batches):
        x, y = _pairs_of_block(t)
        if not len(x):
            continue
        key = t.column("key")[0].as_py()
        node, comp = t.column("node").to_pylist(), t.column("comp").to_pylist()
        bands = np.array(t.column("bands").to_pylist(), np.int64)
        sets = [np.frombuffer(m, np.uint64) for m in t.column("members").to_pylist()]
        same = bands[x] == bands[y]
        first = bands[x, same.argmax(1)] == key  # every pair is compared in the first bucket it shares
        root: dict[int, int] = {}

        def find(c, root=root):
            while root.get(c, c) != c:
                c = root[c]
            return c

        a, b = [], []
        for p, q in zip(x[first], y[first], strict=True):
            u, v = find(comp[p]), find(comp[q])
            if u == v:
                continue
            both = len(np.intersect1d(sets[p], sets[q], assume_unique=True))
            if 100 * both >= PERCENT * (len(sets[p]) + len(sets[q]) - both):
                root[max(u, v)] = min(u, v)
                a.append(node[p])
                b.append(node[q])
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _in_blocks(members: DataFrame, function, schema: str) -> DataFrame:
    """Deals (key, node, ...) rows to pairs of blocks of their bucket and streams each pair."""
    size = common.materialise(members.groupBy("key").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks")), "blocks")
    rows = members.join(size, "key").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("key", F.least("block", "other").cast("long").alias("i"), F.greatest("block", "other").cast("long").alias("j"), *[c for c in rows.columns if c not in ("key", "other", "blocks")])
    return rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(function, schema)


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for the nodes of (a, b) edges that aren't their component's smallest."""
    edges = common.materialise(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct(), "edges")
    state = None
    while True:
        found = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if found == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("comp"))
        state = found
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        edges = common.materialise(small.filter("u != v").distinct(), "edges")


def _merge(comps: DataFrame | None, edges: DataFrame) -> DataFrame:
    if comps is not None:
        for end in ("a", "b"):
            own = comps.select(F.col("node").alias(end), F.col("comp").alias("c"))
            edges = edges.join(own, end, "left").withColumn(end, F.coalesce("c", end)).drop("c")
    new = components(edges)
    if comps is None:
        return new
    moved = comps.join(new.select(F.col("node").alias("comp"), F.col("comp").alias("to")), "comp", "left").select("node", F.coalesce("to", "comp").alias("comp"))
    return common.materialise(moved.unionByName(new), "components")


def link(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row.

    A text without words (null, empty, spaces) has 0 shingles and is linked with
    nothing; one of fewer than five words has one shingle, its whole sequence. A row
    with a null doc_id is linked with nothing, has a null component_id and is kept.
    Rows that repeat a doc_id are one document: whatever any of them is linked with, and
    the copies of all their texts, are in one component.
    """
    spark = docs.sparkSession
    common.prepare(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = common.materialise(docs.mapInArrow(_signatures, "doc_id long, n_shingles long, fp1 long, fp2 long, bands array<long>, sketch binary"), "signatures")
    real = signed.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = common.materialise(real.groupBy("n_shingles", "fp1", "fp2").agg(F.min("doc_id").alias("node")), "classes")
    heads = signed.join(classes.select("n_shingles", "fp1", "fp2", F.col("node").alias("doc_id")), ["n_shingles", "fp1", "fp2", "doc_id"], "left_semi").withColumnRenamed("doc_id", "node")
    heads = common.materialise(heads.select("node", "bands", "sketch"), "heads")

    rows = heads.select("node", F.explode("bands").alias("key"))
    # tables by key are written before they are joined: a join of two plain shuffles can be split where a key is hot
    mates = common.materialise(rows.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "mates")
    shared = common.materialise(rows.join(mates, "key"), "shared-buckets")
    degree = shared.groupBy("node").agg(F.sum("n").alias("d"))
    ranked = shared.join(degree, "node").select("key", "node", "d")
    centres = ranked.groupBy("key").agg(F.max(F.struct("d", F.xxhash64("node").alias("o"), "node")).getField("node").alias("centre"))
    centres = common.materialise(centres, "centres")
    buckets = common.materialise(shared.select("key", "node").join(centres, "key"), "buckets")
    pairs = buckets.select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).filter("a != b").distinct()
    sketches = heads.select("node", "sketch")
    comps = _merge(None, _verify(docs, sketches, pairs))

    at = buckets.join(comps, "node", "left").select("key", "node", F.coalesce("comp", "node").alias("comp"), (F.col("node") == F.col("centre")).alias("was"))
    at = common.materialise(at, "members")
    open_ = at.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.sum(F.when(F.col("was"), 0).otherwise(1)).alias("left")).filter("x != y AND left > 1").select("key")
    open_ = common.materialise(open_, "open-buckets")
    at = at.join(open_, "key", "left_semi").join(sketches, "node")
    flags = common.materialise(_in_blocks(at, _flag, "key long, node long").distinct(), "flags")
    if not flags.isEmpty():
        sets = _sets_of(docs, flags.select(F.col("node").alias("doc_id")).distinct())
        rows = at.join(flags, ["key", "node"], "left_semi").join(heads.select("node", "bands"), "node").join(sets, "node")
        comps = _merge(comps, common.materialise(_in_blocks(rows, _link_blocks, "a long, b long"), "links"))

    texts = F.struct("n_shingles", "fp1", "fp2")
    several = real.groupBy("doc_id").agg(F.min(texts).alias("x"), F.max(texts).alias("y")).filter("x != y").select("doc_id")
    own = real.join(several, "doc_id", "left_semi").join(classes, ["n_shingles", "fp1", "fp2"]).select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    own = common.materialise(own.filter("a != b").distinct(), "repeated-ids")
    if not own.isEmpty():
        comps = _merge(comps, own)

    member = signed.select("doc_id", "n_shingles", "fp1", "fp2").join(classes, ["n_shingles", "fp1", "fp2"], "left")
    node = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("node")).otherwise(F.col("doc_id"))
    member = member.select("doc_id", "n_shingles", node.alias("node"))
    found = member.join(comps, "node", "left").select("doc_id", "n_shingles", F.coalesce("comp", "node").alias("component_id"))
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def deduplicate(docs: DataFrame) -> DataFrame:
    """One row of each group of near duplicates, that of the smallest doc_id; of rows that
    repeat this doc_id the first by text. Rows without words, and those with a null
    doc_id, all stay. Columns are kept."""
    kept = common.materialise(link(docs).filter("kept AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("times"), F.max("n_shingles").alias("words")), "kept")
    out = docs.join(common.broadcast_if_small(kept.select("doc_id"), BROADCAST_IDS), "doc_id", "left_semi").select(docs.columns)
    repeated = kept.filter("times > 1 AND words > 0").select("doc_id")
    if not repeated.isEmpty():
        first = Window.partitionBy("doc_id").orderBy(F.col("text").asc_nulls_last())
        place = common.fresh(out, "place")
        again = out.join(repeated, "doc_id", "left_semi").withColumn(place, F.row_number().over(first)).filter(F.col(place) == 1).drop(place)
        out = out.join(repeated, "doc_id", "left_anti").select(docs.columns).unionByName(again.select(docs.columns))
    return out.unionByName(docs.filter("doc_id IS NULL"))


def _verify(docs: DataFrame, sketches: DataFrame, pairs: DataFrame) -> DataFrame:
    """The (a, b) of pairs whose full sets are similar enough."""
    both = pairs.join(sketches.select(F.col("node").alias("a"), F.col("sketch").alias("x")), "a").join(sketches.select(F.col("node").alias("b"), F.col("sketch").alias("y")), "b")
    likely = common.materialise(both.select("a", "b", "x", "y").mapInArrow(_sketch_filter, "a long, b long"), "likely-pairs")
    sets = _sets_of(docs, likely.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
    full = likely.join(sets.select(F.col("node").alias("a"), F.col("members").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("members").alias("y")), "b")
    return common.materialise(full.select("a", "b", "x", "y").mapInArrow(_confirm, "a long, b long").distinct(), "links")


def _sets_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(node, members) of some documents."""
    ids = common.materialise(ids, "ids")
    own = docs.join(common.broadcast_if_small(ids, BROADCAST_IDS), "doc_id", "left_semi").select("doc_id", "text")
    return common.materialise(own.mapInArrow(_sets, "node long, members binary"), "sets")
