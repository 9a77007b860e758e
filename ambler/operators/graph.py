"""A static, directed, weighted graph as DataFrames.

``edges(src, dst, weight)`` keeps parallel edges and loops. Vertices are 0 .. n-1,
those without edges too. Neighbours of a vertex are in order of (dst, weight); an
edge's place in that order is its ``pos``. No array holds a vertex's neighbours on the
main path: a step joins the frontier to one row of ``index``, so a hub's edges lie
spread over all partitions.
"""

from __future__ import annotations

from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from .scan import exclusive_scan, running
from .storage import checkpoint

#: Edges of one vertex up to which a task puts them in order; beyond it they are dealt to tasks by ranges.
HUB_EDGES = 1_000_000
#: Edges of a vertex that are one row where all of its edges are looked at.
RANGE = 256
#: Edges that are one row of the index that steps join, and of the one for choices by weight, which looks through a row.
SPAN, WEIGHTED_SPAN = 1024, 64
#: Edges that a task puts in order; vertices up to which the planner may broadcast their degrees, and up to
#: which tasks get them as an array, 4 bytes each.
SORTED, FEW_VERTICES, ARRAY_VERTICES = 1_000_000, 1 << 18, 16_000_000
#: Beyond so many edges hubs are looked for among one of ``SHARE``; either way of putting edges in order is exact.
MANY_EDGES, SHARE = 10_000_000, 64
EDGE_SCHEMA = "src int, dst int, weight double"


class Graph:
    def __init__(self, edges: DataFrame, n_vertices: int | None = None):
        self.edges = edges.select(F.col("src").cast("int").alias("src"), F.col("dst").cast("int").alias("dst"), F.col("weight").cast("double").alias("weight"))
        self._n = n_vertices
        self.shared: dict = {}  # broadcast copies, by whether they hold weights
        self.kept: dict = {}  # persisted tables, by name
        self.arrays: dict = {}  # broadcast arrays with an element for each vertex

    @property
    def spark(self) -> SparkSession:
        return self.edges.sparkSession

    def keep(self, name, make) -> DataFrame:
        """A table that runs share: made once, persisted by its maker, until ``release``."""
        if name not in self.kept:
            self.kept[name] = make()
        return self.kept[name]

    def release(self) -> None:
        """Frees what runs have kept: persisted tables and broadcast copies."""
        for table in self.kept.values():
            table.unpersist()
        for copy in (*self.shared.values(), *self.arrays.values()):
            copy.destroy()
        self.kept.clear()
        self.shared.clear()
        self.arrays.clear()

    @property
    def kept_edges(self) -> DataFrame:
        """The edges, computed once for all that is derived from them, whose sizes the planner then knows."""
        return self.keep("edges", lambda: self.edges.persist(StorageLevel.MEMORY_AND_DISK))

    @cached_property
    def n_vertices(self) -> int:
        """One more than the largest id at either end, unless given."""
        if self._n is not None:
            return self._n
        top = self.kept_edges.agg(F.max(F.greatest("src", "dst"))).first()[0]
        return 0 if top is None else top + 1

    @cached_property
    def n_edges(self) -> int:
        return self.kept_edges.count()

    # ------------------------------------------------------------- vertices

    @cached_property
    def degrees(self) -> DataFrame:
        """(id, degree, max_weight, total) of vertices with out-edges; max_weight is 0 at least."""
        return self.kept_edges.groupBy(F.col("src").alias("id")).agg(F.count("*").cast("int").alias("degree"), F.greatest(F.lit(0.0), F.max("weight")).alias("max_weight"), F.sum("weight").alias("total"))

    @property
    def kept_degrees(self) -> DataFrame:
        """The degrees, computed once for the joins of a run."""
        return self.keep("degrees", lambda: self.degrees.persist(StorageLevel.MEMORY_AND_DISK))

    @cached_property
    def vertices(self) -> DataFrame:
        """(id, degree, max_weight, total) of all vertices."""
        every = self.spark.range(self.n_vertices).select(F.col("id").cast("int").alias("id"))
        return every.join(self.degrees, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"), F.coalesce("max_weight", F.lit(0.0)).alias("max_weight"), F.coalesce("total", F.lit(0.0)).alias("total"))

    def csr(self) -> DataFrame:
        """(id, start_edge, end_edge, degree, max_weight): inclusive edge ranges; end_edge is -1 without edges."""
        rows = exclusive_scan(self.vertices, "id", "degree", "start_edge")
        end = F.when(F.col("degree") > 0, F.col("start_edge") + F.col("degree") - 1).otherwise(F.lit(-1).cast("long"))
        return rows.select("id", "start_edge", end.alias("end_edge"), "degree", "max_weight")

    @cached_property
    def has_hubs(self) -> bool:
        """Whether a vertex has more edges than one task should sort. It only decides how edges are put in order."""
        if self.n_edges <= HUB_EDGES:
            return False
        share = SHARE if self.n_edges > MANY_EDGES else 1
        some = self.kept_edges.filter(F.pmod(F.xxhash64("src", "dst"), F.lit(share)) == 0) if share > 1 else self.kept_edges
        return (some.groupBy("src").count().agg(F.max("count")).first()[0] or 0) * share > HUB_EDGES

    # ---------------------------------------------------------------- edges

    @cached_property
    def positions(self) -> DataFrame:
        """(src, pos, dst, weight): each edge's 0-based place among its source's."""
        rows = running(self.kept_edges, "src", ["dst", "weight"], F.lit(1), "__place", "dst" if self.has_hubs else None)
        return rows.select("src", (F.col("__place") - 1).cast("int").alias("pos"), "dst", "weight")

    def edge_vertices(self) -> DataFrame:
        """(edge, src, dst): global edge offsets with the vertices at both ends."""
        start = self.csr().select(F.col("id").alias("src"), "start_edge")
        return self.positions.join(start, "src").select((F.col("start_edge") + F.col("pos")).cast("long").alias("edge"), "src", "dst")

    @cached_property
    def pairs(self) -> DataFrame:
        """Distinct (src, dst)."""
        return self.kept_edges.select("src", "dst").distinct()

    def has_edge(self, probes: DataFrame) -> DataFrame:
        """Adds ``has_edge`` to (src, dst) rows."""
        return probes.join(self.pairs.withColumn("__has", F.lit(True)), ["src", "dst"], "left").withColumn("has_edge", F.coalesce("__has", F.lit(False))).drop("__has")

    def joined(self, pairs: DataFrame, *keys: str) -> DataFrame:
        """Those of the distinct rows of ``pairs``, whose columns named ``keys`` are a source and an end, that are
        edges. The edges, of which there are more, are neither put in order nor made distinct: they stream past the pairs."""
        edges = self.kept_edges.select(*[F.col(c).alias(k) for c, k in zip(("src", "dst"), keys, strict=True)])
        return edges.join(pairs.hint("shuffle_hash"), list(keys)).distinct()

    def has_vertex(self, column) -> "F.Column":
        return F.coalesce(F.col(column).between(0, self.n_vertices - 1), F.lit(False))

    def without_parallel(self) -> "Graph":
        """Equal (src, dst, weight) edges once. Each task has a bounded number of them."""
        parts = max(1, -(-self.n_edges // SORTED))
        return Graph(self.kept_edges.repartition(parts, "src", "dst", "weight").distinct(), self._n)

    def adjacency(self) -> DataFrame:
        """(vertex, nbrs array of (dst, weight)) for interchange and samplers that ask for arrays."""
        return self.edges.groupBy(F.col("src").alias("vertex")).agg(F.array_sort(F.collect_list(F.struct("dst", "weight"))).alias("nbrs"))

    # ---------------------------------------------------------------- index

    @cached_property
    def uniform_index(self) -> DataFrame:
        """(vertex, cell, dst, dst_degree): one row for each edge, cell = pos."""
        far = self.degrees.select(F.col("id").alias("dst"), F.col("degree").alias("dst_degree"))
        return self.positions.join(far, "dst", "left").select(F.col("src").alias("vertex"), F.col("pos").alias("cell"), "dst", F.coalesce("dst_degree", F.lit(0)).alias("dst_degree"))

    @cached_property
    def weighted_index(self) -> DataFrame:
        """A guide table for inverse-CDF choice: (vertex, cell, lo, hi, dst, dst_degree, dst_total).

        A vertex's total weight is cut into as many equal cells as it has edges; an edge
        has a row for each cell its interval (lo, hi] touches, twice the edges at most in
        all. A choice x in (0, total] joins its cell and keeps the row whose interval
        holds x. Where all weights are 0 every edge weighs 1.
        """
        rows = self._intervals.select("src", F.explode(F.sequence(_cell("lo"), _cell("hi"))).alias("cell"), "lo", "hi", "dst")
        return rows.join(self._far, "dst", "left").select(F.col("src").alias("vertex"), "cell", "lo", "hi", "dst", F.coalesce("dst_degree", F.lit(0)).alias("dst_degree"), F.coalesce("dst_total", F.lit(0.0)).alias("dst_total"))

    @property
    def _far(self) -> DataFrame:
        """(dst, dst_degree, dst_total): what a step has to know of where it leads."""
        total = F.when(F.col("total") > 0, F.col("total")).otherwise(F.col("degree").cast("double"))
        return self.kept_degrees.select(F.col("id").alias("dst"), F.col("degree").alias("dst_degree"), total.alias("dst_total"))

    @property
    def _intervals(self) -> DataFrame:
        """(src, pos, dst, weight, degree, total, lo, hi) of edges that can be chosen by weight."""
        total = self.kept_degrees.select(F.col("id").alias("src"), "degree", "total")
        rows = self.positions.join(total, "src")
        rows = rows.withColumn("weight", F.when(F.col("total") > 0, F.col("weight")).otherwise(1.0)).withColumn("total", F.when(F.col("total") > 0, F.col("total")).otherwise(F.col("degree").cast("double")))
        return running(rows, "src", ["pos"], F.col("weight"), "hi", "pos" if self.has_hubs else None).withColumn("lo", F.col("hi") - F.col("weight")).filter("weight > 0")

    @property
    def ends(self) -> DataFrame:
        """(vertex, cell, ends) of ``uniform_spans``, kept: edges are dealt to tasks by source as one number each."""
        ship(self.spark)
        edges = self.kept_edges.filter("src IS NOT NULL").select(_edge().alias("edge")).repartition(self._parts(), F.shiftright("edge", 32))
        return self.keep("ends", lambda: edges.sortWithinPartitions("edge").mapInArrow(_spans, "vertex int, cell int, ends array<int>").persist(StorageLevel.MEMORY_AND_DISK))

    @property
    def out_degrees(self) -> DataFrame:
        """(id, degree) of vertices with out-edges, kept: counted from the rows of edges where a run makes those."""
        if self.has_hubs or self.n_vertices > ARRAY_VERTICES:
            return self.kept_degrees.select("id", "degree")
        found = self.ends.groupBy(F.col("vertex").alias("id")).agg(F.sum(F.size("ends")).cast("int").alias("degree"))
        return self.keep("out degrees", lambda: found.persist(StorageLevel.MEMORY_AND_DISK))

    @property
    def counted(self) -> DataFrame:
        """(id, degree): of ``out_degrees`` where a run has made those, else counted from the edges."""
        return self.out_degrees if "out degrees" in self.kept else self.degrees.select("id", "degree")

    def degree_array(self):
        """A broadcast array of the degrees of all vertices, and a 0 for others."""
        if "degrees" not in self.arrays:
            got = self.out_degrees.mapInArrow(_packed_degrees, "id binary, degree binary").collect()
            ids, degrees = (np.frombuffer(b"".join(r[c] for r in got), np.int32) for c in ("id", "degree"))
            found = np.zeros(int(ids.max(initial=-1)) + 2, np.int32)
            found[ids] = degrees
            self.arrays["degrees"] = self.spark.sparkContext.broadcast(found)
        return self.arrays["degrees"]

    def _parts(self) -> int:
        """Tasks that put the edges in order."""
        return max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-self.n_edges // SORTED))

    def _in_order(self, *columns: str) -> DataFrame:
        """(src, edge, far, far_total, ..): the edges with what ``columns`` name of their ends, dealt to tasks
        by source, to be sorted there: ``edge`` is both ends in one number, in their order."""
        ship(self.spark)
        few = self.n_vertices <= FEW_VERTICES
        far = self._far.select("dst", *[c for c in columns if c != "weight"])
        rows = self.kept_edges.filter("src IS NOT NULL").join(far if few else far.hint("shuffle_hash"), "dst", "left")
        names = {"dst_degree": F.coalesce("dst_degree", F.lit(0)).alias("far"), "dst_total": F.coalesce("dst_total", F.lit(0.0)).alias("far_total"), "weight": F.col("weight")}
        return rows.select("src", _edge().alias("edge"), *[names[c] for c in columns]).repartition(self._parts(), "src")

    @property
    def uniform_spans(self) -> DataFrame:
        """(vertex, cell, ends array<int>, far array<int>): row ``cell`` of a vertex has the ends, and their
        degrees, of its edges at the places from ``SPAN * cell`` on. Edges meet the degrees before they are
        put in order, so that those of a row are together when it is made."""
        if not self.has_hubs and self.n_vertices <= ARRAY_VERTICES:
            degrees = self.degree_array()
            return self.ends.mapInArrow(lambda batches: _with_far(batches, degrees.value), "vertex int, cell int, ends array<int>, far array<int>")
        if not self.has_hubs:
            return self._in_order("dst_degree").select("edge", "far").sortWithinPartitions("edge").mapInArrow(_spans, "vertex int, cell int, ends array<int>, far array<int>")
        edges = self.kept_edges.join(self._far, "dst", "left").select("src", "dst", "weight", F.coalesce("dst_degree", F.lit(0)).alias("degree"))
        rows = running(edges, "src", ["dst", "weight"], F.lit(1), "place", "dst" if self.has_hubs else None)
        rows = rows.groupBy(F.col("src").alias("vertex"), F.floor((F.col("place") - 1) / SPAN).cast("int").alias("cell")).agg(F.array_sort(F.collect_list(F.struct("place", "dst", "degree"))).alias("e"))
        return rows.select("vertex", "cell", F.col("e.dst").alias("ends"), F.col("e.degree").alias("far"))

    @cached_property
    def weighted_spans(self) -> DataFrame:
        """(vertex, cell, lo, hi, upto array<double>, ends, far, far_total): as ``weighted_index``, but a row
        has up to ``WEIGHTED_SPAN`` edges one after another, whose intervals end at ``upto``, and is there
        for each run of ``WEIGHTED_SPAN`` cells that it touches."""
        run = lambda x: F.floor(_cell(x) / WEIGHTED_SPAN).cast("int")
        if not self.has_hubs:
            own = self._far.withColumnsRenamed({"dst": "src", "dst_degree": "degree", "dst_total": "total"})
            rows = self._in_order("dst_degree", "dst_total", "weight").join(own.hint("shuffle_hash"), "src").sortWithinPartitions("edge", "weight")
            rows = rows.select("edge", "weight", "far", "far_total", "degree", "total").mapInArrow(_weighted_spans, "vertex int, lo double, hi double, upto array<double>, ends array<int>, far array<int>, far_total array<double>, degree int, total double")
            return rows.select("vertex", F.explode(F.sequence(run("lo"), run("hi"))).alias("cell"), "lo", "hi", "upto", "ends", "far", "far_total")
        rows = self._intervals.join(self._far, "dst", "left")
        edge = F.struct("pos", F.col("hi").alias("upto"), "dst", F.coalesce("dst_degree", F.lit(0)).alias("degree"), F.coalesce("dst_total", F.lit(0.0)).alias("total"))
        rows = rows.groupBy(F.col("src").alias("vertex"), F.floor(F.col("pos") / WEIGHTED_SPAN).alias("span")).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.first("degree").alias("degree"), F.first("total").alias("total"), F.array_sort(F.collect_list(edge)).alias("e"))
        return rows.select("vertex", F.explode(F.sequence(run("lo"), run("hi"))).alias("cell"), "lo", "hi", F.col("e.upto").alias("upto"), F.col("e.dst").alias("ends"), F.col("e.degree").alias("far"), F.col("e.total").alias("far_total"))

    def edge_ranges(self, width: int) -> DataFrame:
        """(vertex, range, ends array<int>, weights array<double>, far array<int>): a vertex's edges in rows of ``width``."""
        schema = "vertex int, range int, ends array<int>, weights array<double>, far array<int>"
        if not self.has_hubs:
            rows = self._in_order("dst_degree", "weight").sortWithinPartitions("edge", "weight")
            return rows.select("edge", "weight", "far").mapInArrow(_ranges(width), schema)
        edges = self.positions.join(self._far.select("dst", "dst_degree"), "dst", "left")
        e = F.array_sort(F.collect_list(F.struct("pos", "dst", "weight", F.coalesce("dst_degree", F.lit(0)).alias("far"))))
        rows = edges.groupBy(F.col("src").alias("vertex"), F.floor(F.col("pos") / width).cast("int").alias("range")).agg(e.alias("e"))
        return rows.select("vertex", "range", F.col("e.dst").alias("ends"), F.col("e.weight").alias("weights"), F.col("e.far").alias("far"))

    def few_ends(self, most: int) -> DataFrame:
        """(vertex, ends array<int>) of vertices of fewer than ``most`` edges, ``SPAN`` at most."""
        if not self.has_hubs:
            return self.ends.filter((F.col("cell") == 0) & (F.size("ends") < most)).select("vertex", "ends")
        few = self.kept_degrees.filter(F.col("degree") < most).select(F.col("id").alias("src"))
        return self.kept_edges.join(few, "src").groupBy(F.col("src").alias("vertex")).agg(F.collect_list("dst").alias("ends"))

    @cached_property
    def most_edges(self) -> int:
        """The largest degree."""
        return self.out_degrees.agg(F.max("degree")).first()[0] or 0

    def neighbor_sets(self, least: int = 1) -> DataFrame:
        """(src, bucket, near array<int>): the distinct ends of a vertex's edges in as many buckets as it has
        ``SPAN`` edges, by ``bucket_of``, to look an end up in one row; of vertices of ``least`` edges or more."""
        degrees = self.kept_degrees.filter(F.col("degree") >= least).select(F.col("id").alias("src"), "degree")
        rows = self.kept_edges.select("src", "dst").join(degrees, "src")
        return rows.groupBy("src", bucket_of("dst", F.col("degree")).alias("bucket")).agg(F.collect_set("dst").alias("near"))


def _edge() -> Column:
    """Both ends of an edge in one number, in their order; an end that is missing comes first."""
    return F.shiftleft(F.col("src").cast("long"), 32) + F.coalesce("dst", F.lit(-1)) + 1


def _packed_degrees(batches):
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([c.to_numpy().astype(np.int32).tobytes()], pa.binary()) for c in b.columns], ["id", "degree"])


def _with_far(batches, degrees: np.ndarray):
    """Adds the degrees of the ends to (vertex, cell, ends)."""
    for b in batches:
        lists = b.column(2)
        ends = lists.flatten().fill_null(-1).to_numpy()
        far = degrees[np.where((ends < 0) | (ends >= len(degrees)), len(degrees) - 1, ends)]
        offsets = lists.offsets.to_numpy()
        yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(offsets - offsets[0], pa.array(far))], ["vertex", "cell", "ends", "far"])


def whole(batches, shift: int = 32):
    """The columns of batches in the order of their first one, ``edge``, cut only between its sources: where its bits from ``shift`` on change."""
    joined = lambda parts: [np.concatenate(c) for c in zip(*parts, strict=True)]
    held = []
    for b in batches:
        if not b.num_rows:
            continue
        columns = [c.to_numpy(zero_copy_only=False) for c in b.columns]
        src = columns[0] >> shift
        cut = int(np.searchsorted(src, src[-1]))
        if cut:
            yield joined([*held, [c[:cut] for c in columns]])
            held, columns = [], [c[cut:] for c in columns]
        elif held and held[0][0][0] >> shift != src[0]:
            yield joined(held)
            held = []
        held.append(columns)
    if held:
        yield joined(held)


def _places(edge: np.ndarray):
    """Where the sources of edges in order begin (and the last one ends), and each edge's place among its source's."""
    src = edge >> 32
    bounds = np.concatenate([[0], np.flatnonzero(src[1:] != src[:-1]) + 1, [len(edge)]])
    return bounds, np.arange(len(edge)) - np.repeat(bounds[:-1], np.diff(bounds))


def _ends(edge: np.ndarray) -> pa.Array:
    ends = (edge & 0xFFFFFFFF) - 1
    return pa.array(ends.astype(np.int32), mask=ends < 0)


def _lists(rows: np.ndarray, values) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.append(rows, len(values)).astype(np.int32), values)


def _spans(batches):
    """From (edge) or (edge, far) in order to the rows of ``uniform_spans``, without ``far`` or with it."""
    for edge, *far in whole(batches):
        _, place = _places(edge)
        rows = np.flatnonzero(place % SPAN == 0)
        columns = [pa.array((edge[rows] >> 32).astype(np.int32)), pa.array((place[rows] // SPAN).astype(np.int32)), _lists(rows, _ends(edge)), *[_lists(rows, pa.array(f)) for f in far]]
        yield pa.RecordBatch.from_arrays(columns, ["vertex", "cell", "ends", "far"][: len(columns)])


def _ranges(width: int):
    """From (edge, weight, far) in order to rows of ``width`` edges of a source."""

    def run(batches):
        for edge, weight, far in whole(batches):
            _, place = _places(edge)
            rows = np.flatnonzero(place % width == 0)
            columns = [pa.array((edge[rows] >> 32).astype(np.int32)), pa.array((place[rows] // width).astype(np.int32)), *(_lists(rows, c) for c in (_ends(edge), pa.array(weight), pa.array(far)))]
            yield pa.RecordBatch.from_arrays(columns, ["vertex", "range", "ends", "weights", "far"])

    return run


def _weighted_spans(batches):
    """From (edge, weight, far, far_total, degree, total) in order to rows of edges with their intervals; those that can't be chosen go."""
    for edge, weight, far, far_total, degree, total in whole(batches):
        bounds, place = _places(edge)
        weight, upto = weight.copy(), np.empty(len(edge))
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):  # sums in order, as a window's are
            upto[a:b] = np.cumsum(weight[a:b])
            if not upto[b - 1] > 0:
                weight[a:b], upto[a:b] = 1.0, np.arange(1, b - a + 1)
        ok = np.flatnonzero(weight > 0)
        if not len(ok):
            continue
        src, span = edge[ok] >> 32, place[ok] // WEIGHTED_SPAN
        rows = np.concatenate([[0], np.flatnonzero((src[1:] != src[:-1]) | (span[1:] != span[:-1])) + 1])
        last = np.append(rows[1:], len(ok)) - 1
        lists = [_lists(rows, pa.array(upto[ok])), _lists(rows, _ends(edge[ok])), _lists(rows, pa.array(far[ok])), _lists(rows, pa.array(far_total[ok]))]
        columns = [pa.array(src[rows].astype(np.int32)), pa.array((upto - weight)[ok][rows]), pa.array(upto[ok][last]), *lists, pa.array(degree[ok][rows]), pa.array(total[ok][rows])]
        yield pa.RecordBatch.from_arrays(columns, ["vertex", "lo", "hi", "upto", "ends", "far", "far_total", "degree", "total"])


def bucket_of(end: str, degree: Column) -> Column:
    """The row of ``neighbor_sets`` that ``end`` is in, if at all, of a vertex of that degree."""
    return F.pmod(F.xxhash64(end), F.ceil(degree / SPAN)).cast("int")


def _cell(x: str) -> Column:
    """The cell of equal weight that a point of a vertex's total weight lies in."""
    return F.least(F.floor(F.col(x) * F.col("degree") / F.col("total")), F.col("degree").cast("long") - 1).cast("int")


def partition_by_bytes(graph: Graph, budget: int, vertex_bytes: int = 16, edge_bytes: int = 8) -> DataFrame:
    """(part, id, first, last): vertices with the places of their edges in each part (last is -1
    for a vertex without edges there), so that no part holds more than ``budget`` bytes. Vertices and
    edges stand in a line by id; a cut falls after at most ``budget`` bytes less one vertex and one
    edge, so that a hub cut in two has its own bytes in both parts."""
    room = budget - vertex_bytes - edge_bytes
    if room < vertex_bytes + edge_bytes:
        raise ValueError("a part has to hold two vertices and two edges")
    rows = graph.vertices.select("id", "degree").withColumn("__bytes", F.lit(vertex_bytes) + F.col("degree") * edge_bytes)
    rows = exclusive_scan(rows, "id", "__bytes", "__before")
    top, own = F.floor(F.col("__before") / room), F.col("__before") + vertex_bytes  # its edges begin at own
    end = F.when(F.col("degree") > 0, F.floor((own + (F.col("degree") - 1) * edge_bytes) / room)).otherwise(top)
    rows = rows.select("id", "degree", own.alias("own"), F.explode(F.sequence(top, end)).alias("part"))
    first = F.greatest(F.ceil((F.col("part") * room - F.col("own")) / edge_bytes), F.lit(0))
    last = F.least(F.ceil(((F.col("part") + 1) * room - F.col("own")) / edge_bytes) - 1, F.col("degree").cast("long") - 1)
    return rows.select(F.col("part").cast("int").alias("part"), "id", F.when(F.col("degree") > 0, first).otherwise(0).cast("int").alias("first"), F.greatest(last, F.lit(-1)).cast("int").alias("last"))


def bfs(graph: Graph, roots: list[int], most: int = 64) -> DataFrame:
    """(id, depth) of vertices within ``most`` steps of the roots."""
    spark = graph.spark
    seen = spark.createDataFrame([(r, 0) for r in sorted(set(roots))], "id int, depth int")
    last = seen
    for depth in range(1, most + 1):
        new = last.join(graph.pairs, last["id"] == graph.pairs["src"]).select(F.col("dst").alias("id")).distinct().join(seen, "id", "left_anti").withColumn("depth", F.lit(depth))
        new = checkpoint(new)
        if new.isEmpty():
            break
        seen, last = checkpoint(seen.unionByName(new)), new
    return seen
