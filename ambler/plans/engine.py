"""Runs an app: a frontier joins the graph's index once a step.

A frontier row knows its transit's degree (and total weight), so the choice is made
before the join and the join key is (transit, cell): one row of the index, which holds
up to ``SPAN`` of its edges, or the few rows of one run of cells. All choices of a
fan-out at a transit of no more edges meet its row together and are made there. The index
is partitioned by that key once and kept; a step shuffles only the frontier. Rows that have
ended carry a key of their own that meets nothing, so they don't gather in one task.

Strategy ``transit`` is this, for graphs of any size. ``sample`` gives every worker the
whole graph: plain apps run all their steps inside a task (``plans/local.py``), others join
a broadcast index. ``auto`` counts the edges and takes ``sample`` within ``BROADCAST_ROWS``, of which
the packed graph that tasks get takes ``PACKED`` times as many.
"""

from __future__ import annotations

import dataclasses
import functools
import itertools
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import rng
from ..operators.frontier import different_places
from ..operators.graph import ARRAY_VERTICES, RANGE, SPAN, WEIGHTED_SPAN, Graph, bucket_of
from ..operators.storage import checkpoint, stored
from ..operators.validate import vertex_violations
from ..shipping import ship
from .app import ALL_NEIGHBORS, OutputFormat, SamplingApp, SamplingType, StepContext
from .edges import chosen_edges
from .local import dealt_edges, importance_in_part, root_chains, run_importance, run_local, run_many_roots, run_second_order

#: Edges up to which the index is broadcast to joins, and each worker gets the whole graph.
BROADCAST_ROWS = 4_000_000
#: How many edges of the packed graph (4 bytes each in a worker, 12 with weights) stand for one of the index.
PACKED = 4
#: Vertices, 8 bytes each in a worker, up to the same.
BROADCAST_VERTICES = 16_000_000
#: A row of a frontier takes the memory of so many edges of the index.
EDGES_A_ROW = 8
#: Steps between checkpoints of a long walk.
CHECKPOINT_EVERY = 25
#: Steps whose vertices a row of a plain walk carries before they are stored, so that what a step shuffles doesn't grow.
CARRIED = 5
#: Rounds of weighed walks between checkpoints, and looks at whether any walk is left.
ROUNDS = 4
#: Proposals in a row after which a weighed walk is taken to have no edge to accept.
MOST_ROUNDS = 10_000
STRATEGIES = ("auto", "sample", "transit")


@dataclasses.dataclass
class SamplingRun:
    """The result: samples(sample_id, step, slot, parent_slot, transit, vertex), valid vertices only."""

    app: SamplingApp
    graph: Graph
    samples: DataFrame

    def sample_length(self) -> int:
        return self.app.final_size()

    def total_length(self, n_samples: int) -> int:
        return n_samples * self.app.final_size()

    def output(self) -> DataFrame:
        """The samples in the app's output format: rows of vertices, or adjacency matrices
        (sample_id, row, col, n) of the edges that were walked, or that lead from each layer to the
        next (with ``step``), or that the sampler gave."""
        if self.app.output is OutputFormat.SAMPLED_VERTICES:
            return self.samples
        if self.app.table is not None:
            return self.samples.groupBy("sample_id", F.col("src").alias("row"), F.col("dst").alias("col")).agg(F.count("*").alias("n"))
        if self.app.importance is not None:
            return layer_edges(self)
        return self.samples.groupBy("sample_id", F.col("transit").alias("row"), F.col("vertex").alias("col")).agg(F.count("*").alias("n"))

    def valid_count(self) -> DataFrame:
        return self.samples.agg(F.count("vertex").alias("n_valid"))

    def violations(self, seed: int = 42) -> DataFrame:
        """Rows that break the property of a sample: by the app's own check, or else that a vertex is a
        neighbour of one before, and that no step is empty that needn't be."""
        if self.app.check is not None:
            return self.app.check(self.graph, self.samples, seed)
        found = vertex_violations(self.samples, self.app.seeds(self.graph), self.graph, self.app.steps)
        ends = self.app.end is not None or self.app.stop is not None or self.app.next is not None
        return found.filter("kind != 'empty_step'") if ends else found

    def dense(self, fill: int | None = None) -> DataFrame:
        """(sample_id, vertices array): samples in step and slot order, padded with ``fill``
        (the number of vertices unless given) for what ended early."""
        fill = self.graph.n_vertices if fill is None else fill
        app, base, starts = self.app, 0, []
        for k in range(app.steps):
            starts.append(base)
            base += app.outputs_until(k)
        at = F.element_at(F.array(*[F.lit(s) for s in starts]), F.col("step") + 1) + F.col("slot")
        found = self.samples.groupBy("sample_id").agg(F.map_from_entries(F.collect_list(F.struct(at.alias("k"), F.col("vertex").alias("v")))).alias("m"))
        return found.select("sample_id", F.transform(F.sequence(F.lit(0), F.lit(base - 1)), lambda i: F.coalesce(F.element_at("m", i), F.lit(fill))).alias("vertices"))


def chosen(graph: Graph, strategy: str, packed: bool = False) -> str:
    """``sample`` or ``transit``; ``packed`` where tasks take the graph rather than joins the index."""
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy must be one of {STRATEGIES}")
    if strategy == "transit":
        return strategy
    most = BROADCAST_ROWS * (PACKED if packed else 1)
    fits = graph.n_edges <= most and graph.n_vertices <= BROADCAST_VERTICES
    if strategy == "sample" and not fits:
        raise ValueError(f"strategy 'sample' is for graphs of up to {most} edges and {BROADCAST_VERTICES} vertices; this one has {graph.n_edges} and {graph.n_vertices}")
    return "sample" if fits else "transit"


def renamed_index(graph: Graph, weighted: bool) -> DataFrame:
    index = graph.weighted_spans if weighted else graph.uniform_spans
    return index.withColumnsRenamed({c: f"i_{c}" for c in index.columns})


def store_index(graph: Graph, path: str, weighted: bool = False, buckets: int | None = None) -> int:
    """Writes the index in buckets by (vertex, cell) to a folder, for ``stored_index`` of this
    session or later ones; gives the number of buckets, the shuffle's partitions by default. It
    should be no less than those later, or the index is shuffled then."""
    spark = graph.spark
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"ambler_{uuid.uuid4().hex}"
    index = renamed_index(graph, weighted).repartition(buckets, "i_vertex", "i_cell")  # a file a bucket
    index.write.format("parquet").bucketBy(buckets, "i_vertex", "i_cell").sortBy("i_vertex", "i_cell").option("path", path).saveAsTable(name)
    spark.sql(f"DROP TABLE {name}")  # the files stay: the folder is the caller's
    return buckets


def stored_index(graph: Graph, path: str, buckets: int, weighted: bool = False) -> None:
    """Has the graph's runs by joins use an index of ``store_index``: a step shuffles the
    frontier only, and nothing is built or persisted."""
    spark, name = graph.spark, f"ambler_{uuid.uuid4().hex}"
    columns = ", ".join(f"{c} {t}" for c, t in spark.read.parquet(path).dtypes)
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (i_vertex, i_cell) SORTED BY (i_vertex, i_cell) INTO {buckets} BUCKETS LOCATION '{path}'")
    graph.kept["stored", weighted] = spark.read.table(name)


def prepared_index(graph: Graph, weighted: bool, strategy: str = "auto") -> tuple[DataFrame, bool]:
    """(index, broadcast?) for the joins of a run."""
    index = renamed_index(graph, weighted)
    if chosen(graph, strategy) == "sample":
        return graph.keep(("index", weighted), lambda: index.persist(StorageLevel.MEMORY_AND_DISK)), True
    if ("stored", weighted) in graph.kept:
        return graph.kept["stored", weighted], False
    parts = int(graph.spark.conf.get("spark.sql.shuffle.partitions"))
    return graph.keep(("index", weighted, parts), lambda: index.repartition(parts, "i_vertex", "i_cell").persist(StorageLevel.MEMORY_AND_DISK)), False


def start(graph: Graph, app: SamplingApp) -> DataFrame:
    """The seeds with their degrees."""
    seeds = app.seeds(graph)
    if not app.weighted and app.next is app.stop is app.update is app.transits is None:  # no choice looks at weights
        own = graph.out_degrees.select(F.col("id").alias("transit"), "degree")
        return seeds.join(own, "transit", "left").withColumn("degree", F.coalesce("degree", F.lit(0))).withColumn("total", F.col("degree").cast("double"))
    own = graph.kept_degrees.select(F.col("id").alias("transit"), "degree", F.when(F.col("total") > 0, F.col("total")).otherwise(F.col("degree").cast("double")).alias("total"))
    return seeds.join(own, "transit", "left").withColumn("degree", F.coalesce("degree", F.lit(0))).withColumn("total", F.coalesce("total", F.lit(0.0)))


@dataclasses.dataclass(frozen=True)
class Joins:
    """How a run joins its index: ``broadcast`` it; else hash the frontier where that is ``smaller``
    than the index; ``balance`` joins keys that many rows share apart from the others."""

    broadcast: bool
    smaller: bool = False
    balance: bool = False

    @classmethod
    def of(cls, graph: Graph, app: SamplingApp, broadcast: bool, balance: bool) -> "Joins":
        if broadcast:
            return cls(True)
        return cls(False, app.seeds(graph).count() * app.outputs_until(app.steps - 1) // max(app.initial_size, 1) <= graph.n_edges, balance)


def hot_keys(rows: DataFrame, parts: int) -> DataFrame:
    """(__vertex, __cell) of keys with more than a quarter of a partition's share of the rows:
    fewer than 4 * ``parts``."""
    most = rows.count() // (4 * parts) + 1
    found = rows.filter("__cell >= 0").groupBy("__vertex", "__cell").agg(F.count("*").alias("__n")).filter(F.col("__n") > most)
    return checkpoint(found.select("__vertex", "__cell"))


def _joined(rows: DataFrame, index: DataFrame, how: Joins, weighted: bool) -> DataFrame:
    def on(left, right):
        same = (F.col("__vertex") == F.col("i_vertex")) & (F.col("__cell") == F.col("i_cell"))
        return same & (F.col("__x") > F.col("i_lo")) & (F.col("__x") <= F.col("i_hi")) if weighted else same

    def join(left, right):
        return left.join(right, on(left, right), "left")

    if how.broadcast:
        return join(rows, F.broadcast(index))
    cold = []
    if how.balance:
        rows = checkpoint(rows)
        hot = hot_keys(rows, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        if not hot.isEmpty():
            # the index's rows of hot keys go to every task, the walkers at them stay where they are
            key = ["__vertex", "__cell"]
            few = index.join(F.broadcast(hot), (F.col("i_vertex") == F.col("__vertex")) & (F.col("i_cell") == F.col("__cell")), "left_semi")
            cold = [join(rows.join(F.broadcast(hot), key, "left_semi"), F.broadcast(few))]
            rows = rows.join(F.broadcast(hot), key, "left_anti")
    found = join(rows.hint("shuffle_hash"), index) if how.smaller else join(rows, index.hint("shuffle_hash"))
    return functools.reduce(DataFrame.unionByName, cold, found)


def step_join(rows: DataFrame, index: DataFrame, how: Joins, app: SamplingApp, step: int, seed: int, slot) -> DataFrame:
    """Chooses for each frontier row and joins: adds vertex, v_degree, v_total (null where it ended)."""
    context = StepContext(step, seed, F.col("degree"), F.col("total"), F.col("transit"), slot, {c: F.col(c) for c in rows.columns})
    alive = F.col("transit").isNotNull() & (F.col("degree") > 0)
    if app.end is not None:
        alive = alive & (context.u(1) >= app.end)
    if app.stop is not None:
        alive = alive & ~app.stop(context)
    if app.weighted:
        rows = rows.withColumn("__x", F.when(alive, context.u() * F.col("total")))
        cell = F.least(F.floor(F.col("__x") * F.col("degree") / F.col("total")), F.col("degree").cast("long") - 1).cast("int")
    elif app.next is not None:
        cell = F.when(alive, app.next(context)).cast("int")
    else:
        cell = F.when(alive, F.least(F.floor(context.u() * F.col("degree")), F.col("degree").cast("long") - 1)).cast("int")
    # few calls: each of them has the whole plan so far analysed again
    rows = rows.withColumn("__place", cell)
    rows = _joined(_keyed(rows, F.col("__place"), WEIGHTED_SPAN if app.weighted else SPAN), index, how, app.weighted)
    own = [c for c in rows.columns if c not in KEYS]
    if app.weighted:  # the first edge whose interval ends at x or beyond
        rows = rows.select(*own, "i_ends", "i_far", "i_far_total", F.size(F.filter("i_upto", lambda h: h < F.col("__x"))).alias("__at"))
    else:
        rows = rows.select(*own, "i_ends", "i_far", F.pmod("__place", F.lit(SPAN)).alias("__at"))
    found = {"vertex": "i_ends", "v_degree": "i_far"} | ({"v_total": "i_far_total"} if app.weighted else {})
    return rows.select(*own, *[F.get(of, F.col("__at")).alias(name) for name, of in found.items()])


def _keyed(rows: DataFrame, place, span: int) -> DataFrame:
    """The rows with the key of the index's row that has ``place``; an ended row's key meets no vertex,
    and no other ended row's by more than chance."""
    vertex = F.when(place.isNull(), -1 - F.pmod(F.xxhash64("sample_id"), F.lit(1 << 30)).cast("int")).otherwise(F.col("transit"))
    # a negative place meets no row
    return rows.withColumns({"__vertex": vertex, "__cell": F.coalesce(F.floor(place / span).cast("int"), F.lit(-1))})


def fan_join(rows: DataFrame, index: DataFrame, how: Joins, app: SamplingApp, step: int, seed: int) -> DataFrame:
    """As ``step_join`` for ``size`` uniform choices of each of rows(.., slot), whose slots are
    parent_slot * size + j, or for different ones. A transit of up to ``SPAN`` edges has one row in the
    index: its frontier row is joined as it is, and its choices are made after that."""
    size = app.size(step)
    rows = rows.filter("transit IS NOT NULL AND degree > 0").withColumnRenamed("slot", "parent_slot")
    whole = F.col("degree") <= SPAN
    if app.distinct:
        different = different_places(seed, step, "parent_slot", F.col("degree"), size)
        rows = rows.select("*", F.posexplode(F.when(whole, F.array(F.lit(-1))).otherwise(different)).alias("j", "cell"))
    else:
        rows = rows.withColumn("j", F.explode(F.when(whole, F.array(F.lit(-1))).otherwise(F.sequence(F.lit(0), F.lit(size - 1)))))
        rows = rows.withColumn("cell", F.when(whole, -1).otherwise(rng.pick(rng.uniform(seed, "sample_id", step, f"parent_slot * {size} + j", 0), F.col("degree"))))
    rows = _joined(_keyed(rows, F.greatest("cell", F.lit(0)), SPAN), index, how, False)
    own = [c for c in rows.columns if c not in (*KEYS, "j")]
    if app.distinct:
        rows = rows.select(*own, "i_ends", "i_far", "j", F.posexplode(F.when(whole, different).otherwise(F.array("cell"))).alias("__j", "__place"))
        rows = rows.withColumn("slot", F.col("parent_slot") * size + F.when(whole, F.col("__j")).otherwise(F.col("j"))).drop("__j", "j")
    else:
        rows = rows.select(*own, "i_ends", "i_far", F.explode(F.when(whole, F.sequence(F.lit(0), F.lit(size - 1))).otherwise(F.array("j"))).alias("j"))
        rows = rows.withColumn("slot", F.col("parent_slot") * size + F.col("j")).drop("j")
        context = StepContext(step, seed, F.col("degree"), F.col("total"), F.col("transit"), "slot", {c: F.col(c) for c in (*own, "slot")})
        if app.end is not None:
            rows = rows.filter(context.u(1) >= app.end)
        if app.stop is not None:
            rows = rows.filter(~app.stop(context))
        rows = rows.withColumn("__place", rng.pick(context.u(), F.col("degree")))
    at = F.pmod("__place", F.lit(SPAN))
    return rows.select(*own, "slot", F.get("i_ends", at).alias("vertex"), F.get("i_far", at).alias("v_degree"))


#: What a step's join adds, which its choice is made of.
KEYS = ("__vertex", "__cell", "__x", "__place", "i_vertex", "i_cell", "i_lo", "i_hi", "i_upto", "i_ends", "i_far", "i_far_total", "cell")


def onward(rows: DataFrame, **columns) -> DataFrame:
    """The rows of a step's join as the next step's frontier: the vertex is the transit, with its
    degree and total; ``columns`` are set, those of the join go."""
    total = F.coalesce("v_total", F.lit(0.0)) if "v_total" in rows.columns else F.coalesce(F.col("v_degree").cast("double"), F.lit(0.0))
    new = {"transit": F.col("vertex"), "degree": F.coalesce("v_degree", F.lit(0)), "total": total} | columns
    kept = [c for c in rows.columns if c not in (*KEYS, *new, "vertex", "v_degree", "v_total", "parent_slot")]
    return rows.select(*kept, *[c.alias(name) for name, c in new.items()])


def run(graph: Graph, app: SamplingApp, seed: int = 42, strategy: str = "auto", checkpoint_every: int = CHECKPOINT_EVERY, balance: bool = False) -> SamplingRun:
    """All steps of an app. A walk's rows carry their path, one row a sample; a fan-out's
    steps are united; a collective app's choices look at all transits of a sample.
    ``balance`` joins keys apart at which many rows meet."""
    in_tasks = app.second_order is not None or app.counts or app.many_roots is not None or app.table is None and app.choose is None and app.sampling_type is SamplingType.INDIVIDUAL and app.is_plain()
    own = chosen(graph, strategy, in_tasks)
    return SamplingRun(app, graph, _samples(graph, app, seed, strategy, own, checkpoint_every, balance))


def _samples(graph: Graph, app: SamplingApp, seed: int, strategy: str, own: str, checkpoint_every: int, balance: bool) -> DataFrame:
    walk = all(app.size(k) == 1 for k in range(app.steps))
    if app.table is not None:
        return app.table(graph, seed, strategy)
    if app.sampling_type is SamplingType.COLLECTIVE:
        if app.importance is None:
            return _collective(graph, app, seed, checkpoint_every)
        if app.counts and own == "sample":
            return run_importance(graph, app, seed)
        return _importance(graph, app, seed)
    if app.weigh is not None:
        if not walk or app.weighted or app.next is not None or app.end is not None or app.stop is not None or app.update is not None or app.transits is not None:
            raise ValueError("edges are weighed in walks, one choice a step, without other rules")
        if app.second_order is not None and own == "sample":
            return run_second_order(graph, app.seeds(graph), app.steps, *app.second_order, seed)
        return _weighed_walk(graph, app, seed)
    if app.choose is not None:
        if not walk or app.weighted or app.next is not None or app.distinct:
            raise ValueError("edges are chosen in walks, one choice a step, by no other rule")
        return _choosing_walk(graph, app, seed, own)
    if app.distinct and (app.weighted or app.next is not None or app.end is not None or app.stop is not None or not all(app.size(k) > 0 for k in range(app.steps))):
        raise ValueError("different edges are drawn uniformly, without other rules")
    if app.many_roots is not None:
        samples = app.seeds(graph).count() if app.samples is None else app.samples(graph)
        return run_many_roots(graph, samples, app.steps, app.many_roots, seed) if own == "sample" else _root_chains(graph, app, samples, seed, balance)
    if app.is_plain() and own == "sample":
        return run_local(graph, app, seed)
    if app.update is not None or app.transits is not None:
        if not walk:
            raise ValueError("only walks, one choice a step, may have state")
        return _stateful_walk(graph, app, seed, strategy, checkpoint_every, balance)
    if walk and not app.distinct:
        return _walk(graph, app, seed, strategy, checkpoint_every, balance)
    return _fan_out(graph, app, seed, strategy, balance)


def _collective(graph: Graph, app: SamplingApp, seed: int, checkpoint_every: int) -> DataFrame:
    """In each step a sample draws ``size`` edges uniformly from those of all its transits, in
    order of slot and place: a draw falls in one transit's range of edges, found by the
    running sum of degrees, and joins one row of the index."""
    if app.next is not None or app.weighted or app.update is not None or app.transits is not None or app.end is not None or app.stop is not None:
        raise ValueError("a collective app draws uniformly, without state")
    index, broadcast = prepared_index(graph, False)
    how = Joins(True) if broadcast else Joins.of(graph, app, False, False)
    rows, steps = start(graph, app).select("sample_id", "slot", "transit", "degree"), []
    for step in range(app.steps):
        size = app.size(step)
        upto = Window.partitionBy("sample_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)  # a sample's transits
        ranges = rows.filter("degree > 0").withColumn("hi", F.sum("degree").over(upto)).withColumn("lo", F.col("hi") - F.col("degree"))
        whole = ranges.groupBy("sample_id").agg(F.max("hi").alias("edges"))
        drawn = whole.select("sample_id", "edges", F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("new"))
        at = F.least(F.floor(rng.uniform(seed, "sample_id", step, "new", 0) * F.col("edges")), F.col("edges") - 1)
        drawn = drawn.select("sample_id", "new", at.alias("at"))
        found = drawn.join(ranges, "sample_id").filter("at >= lo AND at < hi").select("sample_id", "new", "slot", "transit", (F.col("at") - F.col("lo")).cast("int").alias("__place"))
        found, at = _joined(_keyed(found, F.col("__place"), SPAN), index, how, False), F.pmod("__place", F.lit(SPAN))
        rows = found.select("sample_id", F.lit(step).alias("step"), F.col("new").alias("next_slot"), F.col("slot").alias("parent_slot"), "transit", F.get("i_ends", at).alias("v"), F.get("i_far", at).alias("d"))
        rows = checkpoint(rows) if step + 1 < app.steps else rows
        steps.append(rows.select("sample_id", "step", F.col("next_slot").cast("long").alias("slot"), F.col("parent_slot").cast("long").alias("parent_slot"), "transit", F.col("v").alias("vertex")))
        rows = rows.select("sample_id", F.col("next_slot").alias("slot"), F.col("v").alias("transit"), F.col("d").alias("degree"))
    return functools.reduce(DataFrame.unionByName, steps)


def _layer(rows: DataFrame, graph: Graph) -> DataFrame:
    """(sample_id, dst, n, weight): the vertices that edges of rows(sample_id, transit, degree) lead
    to, with their number and weight. A row meets each range of its transit's edges by itself."""
    index = graph.keep("flat ranges", lambda: graph.positions.select(F.col("src").alias("transit"), F.floor(F.col("pos") / RANGE).cast("int").alias("range"), "dst", "weight").persist(StorageLevel.MEMORY_AND_DISK))
    each = rows.filter("degree > 0").select("sample_id", "transit", F.explode(F.sequence(F.lit(0), F.floor((F.col("degree") - 1) / RANGE).cast("int"))).alias("range"))
    return each.join(index, ["transit", "range"]).groupBy("sample_id", "dst").agg(F.count("*").alias("n"), F.sum("weight").alias("weight"))


#: Edges of samples' transits that a task counts.
COUNTED = 2_000_000


def _spans_of(rows: DataFrame, graph: Graph, vertex: str) -> DataFrame:
    """rows(.., vertex) with each of the index's rows of their vertices."""
    index, broadcast = prepared_index(graph, False)
    own = graph.kept_degrees.select(F.col("id").alias(vertex), F.col("degree").alias("__degree"))
    each = rows.join(own, vertex).withColumn("__cell", F.explode(F.sequence(F.lit(0), F.floor((F.col("__degree") - 1) / SPAN).cast("int")))).withColumn("__vertex", F.col(vertex))
    found = each.join(F.broadcast(index) if broadcast else index, (F.col("__vertex") == F.col("i_vertex")) & (F.col("__cell") == F.col("i_cell")))
    return found.select(*rows.columns, "i_ends")


def _counted_layer(rows: DataFrame, graph: Graph) -> DataFrame:
    """(sample_id, dst, n) as of ``_layer``. Rows of edges are shuffled by sample, of which tasks have no
    more than can be counted in memory, and each edge has a row only inside its task."""
    edges = rows.agg(F.sum("degree")).first()[0] or 0
    found = _spans_of(rows.select("sample_id", "transit"), graph, "transit")
    found = found.select("sample_id", "i_ends").repartition(max(1, -(-edges // COUNTED), int(graph.spark.conf.get("spark.sql.shuffle.partitions"))), "sample_id")
    return found.select("sample_id", F.explode("i_ends").alias("dst")).groupBy("sample_id", "dst").agg(F.count("*").alias("n")).withColumn("weight", F.lit(None).cast("double"))


#: Edges of a part of the graph that a task holds, 12 bytes each.
PART_EDGES = 16_000_000


def _counted_importance(graph: Graph, app: SamplingApp, seed: int) -> DataFrame:
    """As ``_importance``, by the number of edges alone. A task holds the edges that end in one part of the vertices, and all
    that lead to one of them; samples come to each part, as a row of their transits, and leave with the first of its
    vertices. So no edge of a sample is shuffled, however often samples meet it."""
    ship(graph.spark)
    parts = max(1, -(-graph.n_edges // PART_EDGES))
    shares = max(1, -(-2 * graph.spark.sparkContext.defaultParallelism // parts))  # of the samples
    edges = graph.keep(("parts", parts), lambda: graph.kept_edges.filter("src IS NOT NULL AND dst IS NOT NULL").select("src", "dst").mapInArrow(dealt_edges(parts), "part int, src binary, dst binary").persist(StorageLevel.MEMORY_AND_DISK))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    edges = edges.withColumn("share", each(shares)).select("part", "share", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("sample_id"), F.lit(None).cast("array<int>").alias("layer"), "src", "dst")
    none, app_ = F.lit(None).cast("binary"), dataclasses.replace(app, seeds=None, check=None)
    rows = app.seeds(graph).filter(F.col("transit").between(0, graph.n_vertices - 1)).groupBy(F.col("sample_id").cast("long").alias("sample_id")).agg(F.collect_set("transit").alias("layer"))
    steps = []
    for step in range(app.steps):
        come = rows.select(each(parts).alias("part"), F.pmod(F.xxhash64("sample_id"), F.lit(shares)).cast("int").alias("share"), F.lit(1).alias("kind"), "sample_id", "layer", none.alias("src"), none.alias("dst"))
        dealt = edges.unionByName(come).repartitionById(parts * shares, (F.col("share") * parts + F.col("part")).cast("int")).sortWithinPartitions("kind")
        best = dealt.select("kind", "sample_id", "layer", "src", "dst").mapInArrow(importance_in_part(app_, seed, step, graph.n_vertices), "sample_id long, vertices array<int>, keys array<double>")
        best = best.groupBy("sample_id").agg(F.flatten(F.collect_list(F.struct("keys", "vertices"))["keys"]).alias("k"), F.flatten(F.collect_list(F.struct("keys", "vertices"))["vertices"]).alias("v"))
        first = F.slice(F.sort_array(F.arrays_zip("k", "v")), 1, app.size(step))
        rows = stored(best.select("sample_id", F.transform(first, lambda x: x["v"]).alias("layer")).filter(F.size("layer") > 0))
        found = rows.select("sample_id", F.posexplode("layer").alias("slot", "vertex"))
        steps.append(found.select("sample_id", F.lit(step).alias("step"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("long").alias("parent_slot"), F.lit(None).cast("int").alias("transit"), "vertex"))
    return functools.reduce(DataFrame.unionByName, steps)


def _importance(graph: Graph, app: SamplingApp, seed: int) -> DataFrame:
    """In each step a sample draws ``size`` different vertices of those its transits' edges lead to, by
    the app's weight: those of the least keys -ln(u) / weight, of which each task keeps its own
    first before any are shuffled. Vertices of weight 0 aren't drawn."""
    if app.next is not None or app.weighted or app.update is not None or app.transits is not None or app.end is not None or app.stop is not None:
        raise ValueError("vertices are drawn by importance without other rules")
    if app.counts and graph.n_vertices <= BROADCAST_VERTICES:  # of which each task has an array
        return _counted_importance(graph, app, seed)
    own = graph.degrees.select(F.col("id").alias("transit"), "degree")
    rows, steps = start(graph, app).select("sample_id", "transit", "degree").distinct(), []
    for step in range(app.steps):
        found = (_counted_layer if app.counts else _layer)(rows, graph).withColumn("w", app.importance(F.col("n"), F.col("weight")).cast("double")).filter("w > 0")
        found = found.withColumn("key", -F.ln(rng.uniform(seed, "sample_id", step, "dst", 0)) / F.col("w"))
        order = Window.partitionBy("sample_id").orderBy("key", "dst")
        found = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= app.size(step)).select("sample_id", "rank", F.col("dst").alias("transit"))
        found = checkpoint(found)
        steps.append(found.select("sample_id", F.lit(step).alias("step"), (F.col("rank") - 1).cast("long").alias("slot"), F.lit(None).cast("long").alias("parent_slot"), F.lit(None).cast("int").alias("transit"), F.col("transit").alias("vertex")))
        rows = found.join(own, "transit").select("sample_id", "transit", "degree")
    return functools.reduce(DataFrame.unionByName, steps)


def layer_edges(run: SamplingRun) -> DataFrame:
    """(sample_id, step, row, col, n): edges from the vertices of each layer (the seeds before the
    first) to those drawn next."""
    seeds = run.app.seeds(run.graph).select("sample_id", F.lit(0).alias("step"), F.col("transit").alias("src")).distinct()
    drawn = run.samples.select("sample_id", "step", F.col("vertex").alias("dst"))
    before = seeds.unionByName(drawn.select("sample_id", (F.col("step") + 1).alias("step"), F.col("dst").alias("src")))
    # a row of edges meets all that was drawn for its sample, a layer's size at most, in the task that has it
    lists = drawn.groupBy("sample_id", "step").agg(F.collect_set("dst").alias("drawn"))
    found = _spans_of(before.join(lists, ["sample_id", "step"]), run.graph, "src")
    found = found.select("sample_id", "step", "src", "i_ends", F.explode(F.array_intersect("i_ends", "drawn")).alias("dst"))
    n = F.size("i_ends") - F.size(F.array_remove("i_ends", F.col("dst")))
    return found.groupBy("sample_id", "step", F.col("src").alias("row"), F.col("dst").alias("col")).agg(F.sum(n).alias("n"))


class Finished:
    """Rows that have ended leave a loop for a table of their own."""

    def __init__(self, *columns: str):
        self.columns, self.rows = columns, None

    def take(self, rows: DataFrame, over) -> DataFrame:
        """The rows that go on, of a stored copy; the others are kept."""
        rows = stored(rows)
        ended = rows.filter(over).select(*self.columns)
        self.rows = ended if self.rows is None else self.rows.unionByName(ended)
        return rows.filter(~over)

    def all(self, rows: DataFrame) -> DataFrame:
        rows = rows.select(*self.columns)
        return rows if self.rows is None else self.rows.unionByName(rows)


def _over():
    return F.col("transit").isNull() | (F.col("degree") == 0)


def _walk(graph: Graph, app: SamplingApp, seed: int, strategy: str, checkpoint_every: int, balance: bool) -> DataFrame:
    index, broadcast = prepared_index(graph, app.weighted, strategy)
    how, done, first = Joins.of(graph, app, broadcast, balance), [], 0
    rows = start(graph, app).withColumn("path", F.array(F.col("transit")))
    every = checkpoint_every and min(checkpoint_every, CARRIED)
    for step in range(app.steps):
        rows = step_join(rows, index, how, app, step, seed, "slot")
        rows = onward(rows, path=F.when(F.col("vertex").isNull(), F.col("path")).otherwise(F.concat("path", F.array("vertex"))))
        if every and (step + 1) % every == 0 and step + 1 + every <= app.steps:
            rows = stored(rows)
            done.append(path_rows(rows, first))
            rows, first = rows.filter(~_over()).withColumn("path", F.array(F.col("transit"))), step + 1
            if rows.isEmpty():
                break
    return functools.reduce(DataFrame.unionByName, [*done, path_rows(rows, first)])


def _choosing_walk(graph: Graph, app: SamplingApp, seed: int, own: str) -> DataFrame:
    """A walk whose app weighs all edges of a transit, with state, stop and end as other walks."""
    done = Finished("sample_id", "slot", "found")
    degrees = graph.degrees.select(F.col("id").alias("transit"), F.col("degree").alias("t_degree"))
    none = F.lit(None).cast("int")
    rows = start(graph, app).withColumns({"previous": none, "previous_degree": none, "found": F.array().cast(FOUND)})
    for step in range(app.steps):
        context = lambda k: StepContext(k, seed, F.col("degree"), F.col("total"), F.col("transit"), "slot", {c: F.col(c) for c in rows.columns})  # noqa: B023, E731
        over = _over()
        if app.end is not None:
            over = over | (context(step).u(1) < app.end)
        if app.stop is not None:
            over = over | app.stop(context(step))
        rows = done.take(rows, over)  # two branches read the rows
        if rows.isEmpty():
            break
        rows = rows.join(chosen_edges(rows, graph, app, seed, step, own), ["sample_id", "slot"], "left")
        rows = rows.withColumn("found", F.when(F.col("vertex").isNull(), F.col("found")).otherwise(F.concat("found", F.array(F.struct(F.lit(step).alias("step"), "transit", "vertex"))))).withColumns({"previous": F.col("transit"), "previous_degree": F.col("degree")})
        if app.update is not None:
            rows = rows.withColumns(app.update(context(step)))
        if app.transits is None:
            rows = rows.withColumn("transit", F.col("vertex")).withColumn("degree", F.coalesce("v_degree", F.lit(0)))
        else:
            rows = rows.withColumn("transit", app.transits(context(step + 1)).cast("int")).drop("degree").join(degrees, "transit", "left").withColumn("degree", F.coalesce("t_degree", F.lit(0))).drop("t_degree")
        rows = rows.drop("vertex", "v_degree", "pos")
    return found_rows(done.all(rows))


FOUND = "array<struct<step:int,transit:int,vertex:int>>"


def found_rows(rows: DataFrame) -> DataFrame:
    """Sample rows from (sample_id, slot, found)."""
    long = rows.select("sample_id", F.col("slot").cast("long").alias("slot"), F.explode("found").alias("f"))
    return long.select("sample_id", F.col("f.step").alias("step"), "slot", F.col("slot").alias("parent_slot"), F.col("f.transit").alias("transit"), F.col("f.vertex").alias("vertex"))


def _stateful_walk(graph: Graph, app: SamplingApp, seed: int, strategy: str, checkpoint_every: int, balance: bool) -> DataFrame:
    """A walk whose rows carry state. A sample ends only where its transit is null: a choice
    that finds nothing leaves the state to say where to go on from."""
    index, broadcast = prepared_index(graph, app.weighted, strategy)
    how, done = Joins.of(graph, app, broadcast, balance), Finished("sample_id", "slot", "found")
    own = graph.degrees.select(F.col("id").alias("transit"), F.col("degree").alias("v_degree"), F.when(F.col("total") > 0, F.col("total")).otherwise(F.col("degree").cast("double")).alias("v_total"))
    rows = start(graph, app).withColumn("found", F.array().cast(FOUND))
    for step in range(app.steps):
        rows = step_join(rows, index, how, app, step, seed, "slot")
        new = F.array(F.struct(F.lit(step).alias("step"), "transit", "vertex"))
        rows = rows.withColumn("found", F.when(F.col("vertex").isNull(), F.col("found")).otherwise(F.concat("found", new)))
        context = lambda k: StepContext(k, seed, F.col("degree"), F.col("total"), F.col("transit"), "slot", {c: F.col(c) for c in rows.columns})  # noqa: B023, E731
        if app.update is not None:
            rows = rows.withColumns(app.update(context(step)))
        if step + 1 == app.steps:
            break
        transit = F.col("vertex") if app.transits is None else app.transits(context(step + 1)).cast("int")
        if app.degree_of is not None:
            known = app.degree_of(context(step + 1))
            rows = rows.withColumns({"transit": transit, "degree": known, "total": known.cast("double")}).drop("vertex", "v_degree", "v_total")
        else:
            rows = rows.withColumn("transit", transit).drop("vertex", "v_degree", "v_total", "degree", "total").join(own, "transit", "left")
            rows = rows.withColumn("degree", F.coalesce("v_degree", F.lit(0))).withColumn("total", F.coalesce("v_total", F.lit(0.0))).drop("v_degree", "v_total")
        if checkpoint_every and (step + 1) % checkpoint_every == 0:
            rows = done.take(rows, F.col("transit").isNull())
            if rows.isEmpty():
                break
    return found_rows(done.all(rows))


#: Samples with many roots whose chains a task makes.
CHAINED = 1 << 14


def _root_chains(graph: Graph, app: SamplingApp, samples: int, seed: int, balance: bool) -> DataFrame:
    """Walks with many roots, root by root: a round is the next step of every root that has one left, so there are
    as many rounds as the steps of one root, and no row carries the other roots."""
    ship(graph.spark)
    index, _ = prepared_index(graph, False, "transit")
    degrees = graph.degree_array() if graph.n_vertices <= ARRAY_VERTICES else None
    rows = graph.spark.range(0, samples, 1, max(graph.spark.sparkContext.defaultParallelism, -(-samples // CHAINED)))
    rows = rows.mapInArrow(root_chains(seed, app.steps, app.many_roots, graph.n_vertices, degrees), "sample_id long, steps array<int>, transit int, degree int")
    if degrees is None:
        rows = rows.drop("degree").join(graph.out_degrees.select(F.col("id").alias("transit"), "degree"), "transit")
    done, left = [], None
    for k in itertools.count():
        # the index is hashed for the first round, whose rows are most of all
        how = Joins(False, left is not None and left * EDGES_A_ROW <= graph.n_edges, balance)
        rows = rows.withColumn("step", F.get("steps", F.lit(k))).withColumn("__place", rng.pick(rng.uniform(seed, "sample_id", "step", 0, 0), F.col("degree")))
        rows, at = _joined(_keyed(rows, F.col("__place"), SPAN), index, how, False), F.pmod("__place", F.lit(SPAN))
        rows = stored(rows.select("sample_id", "steps", "step", "transit", "degree", F.get("i_ends", at).alias("vertex"), F.get("i_far", at).alias("v_degree")))
        zero = F.lit(0).cast("long")
        done.append(rows.filter("vertex IS NOT NULL").select("sample_id", "step", zero.alias("slot"), zero.alias("parent_slot"), "transit", "vertex"))
        # an edge without an end leaves the root where it is
        rows = rows.filter(F.size("steps") > k + 1).select("sample_id", "steps", F.coalesce("vertex", "transit").alias("transit"), F.when(F.col("vertex").isNull(), F.col("degree")).otherwise(F.col("v_degree")).alias("degree")).filter("degree > 0")
        left = rows.count()
        if not left:
            return functools.reduce(DataFrame.unionByName, done)


def _weighed_walk(graph: Graph, app: SamplingApp, seed: int) -> DataFrame:
    """A walk by rejection: a round proposes one uniform edge of each walk's transit, one row
    of the index, probes the pairs of edges, and accepts by the weight. So no walk is joined
    to all edges of a hub. Walks run ahead of each other: a join is a round of every walk
    that isn't finished, whatever step it is in."""
    parts = int(graph.spark.conf.get("spark.sql.shuffle.partitions"))
    # a round shuffles the walks only
    index = graph.keep(("index", False, parts), lambda: renamed_index(graph, False).repartition(parts, "i_vertex", "i_cell").persist(StorageLevel.MEMORY_AND_DISK))
    sets = graph.keep(("sets", parts), lambda: _near_sets(graph, index).repartition(parts, "i_t", "i_bucket").persist(StorageLevel.MEMORY_AND_DISK))
    rows = start(graph, app).select("sample_id", "slot", "transit", "degree", F.array("transit").alias("path"), F.lit(None).cast("int").alias("t"), F.lit(None).cast("int").alias("t_degree"), F.lit(0).alias("step"), F.lit(0).alias("round"))
    done, over = Finished("sample_id", "slot", "path"), F.col("transit").isNull() | (F.col("degree") == 0) | (F.col("step") >= app.steps)
    for rounds in itertools.count():
        if rounds % ROUNDS == 0:
            rows = done.take(rows, over)
            if rows.isEmpty():
                return path_rows(done.rows)
            if rounds and rows.filter(F.col("round") >= MOST_ROUNDS).limit(1).count():
                raise ValueError(f"no edge of a vertex was accepted in {MOST_ROUNDS} rounds: their weights are 0 or far below ``most``")
        context = StepContext("step", seed, F.col("degree"), F.col("degree").cast("double"), F.col("transit"), "slot", {}, F.col("dst"), F.col("t"), F.coalesce("near", F.lit(False)))
        sure = F.lit(None).cast("int") if app.sure is None else app.sure(context)
        # both draws come before the joins; rows that are over meet nothing, each with a key of its own
        rows = rows.withColumns({"sure": sure, "__u": context.u("round * 2 + 1"), "cell": rng.pick(context.u("round * 2"), F.col("degree"))})
        rows = rows.withColumn("__place", F.when(~over, F.coalesce("sure", "cell")))
        rows = _joined(_keyed(rows, F.col("__place"), SPAN), index, Joins(False), False)
        at = F.pmod("__place", F.lit(SPAN))
        rows = rows.drop("near").withColumns({"dst": F.get("i_ends", at), "dst_degree": F.get("i_far", at)}).drop("i_ends", "i_far")
        bucket = F.coalesce(bucket_of("dst", F.col("t_degree")), -1 - F.pmod(F.xxhash64("sample_id"), F.lit(1 << 30)).cast("int"))  # no row in the first step
        rows = rows.withColumn("__bucket", bucket)
        rows = rows.join(sets.hint("shuffle_hash"), (F.col("t") == F.col("i_t")) & (F.col("__bucket") == F.col("i_bucket")), "left")
        rows = rows.withColumn("near", F.array_contains("near", F.col("dst")))
        rows = rows.withColumn("yes", F.col("dst").isNotNull() & (F.col("sure").isNotNull() | (F.col("__u") * app.most <= app.weigh(context))))
        now = lambda a, b: F.when(F.col("yes"), a).otherwise(b)
        rows = rows.select(
            "sample_id",
            "slot",
            now(F.col("dst"), F.col("transit")).alias("transit"),
            now(F.col("dst_degree"), F.col("degree")).alias("degree"),
            now(F.concat("path", F.array("dst")), F.col("path")).alias("path"),
            now(F.col("transit"), F.col("t")).alias("t"),
            now(F.col("degree"), F.col("t_degree")).alias("t_degree"),
            now(F.col("step") + 1, F.col("step")).alias("step"),
            now(F.lit(0), F.col("round") + 1).alias("round"),
        )


def _near_sets(graph: Graph, index: DataFrame) -> DataFrame:
    """(i_t, i_bucket, near): where an end is looked up. The index has a vertex of fewer than ``SPAN`` edges in
    one row, which is its only bucket; only the others' edges are dealt to buckets."""
    few = index.filter((F.col("i_cell") == 0) & (F.size("i_ends") < SPAN)).select(F.col("i_vertex").alias("i_t"), F.lit(0).alias("i_bucket"), F.col("i_ends").alias("near"))
    return few.unionByName(graph.neighbor_sets(SPAN).withColumnsRenamed({"src": "i_t", "bucket": "i_bucket"}))


def path_rows(rows: DataFrame, first: int = 0) -> DataFrame:
    """Sample rows from (sample_id, slot, path), whose first element is where step ``first`` begins."""
    long = rows.filter(F.size("path") > 1).select("sample_id", F.col("slot").cast("long").alias("slot"), "path", F.explode(F.sequence(F.lit(1), F.size("path") - 1)).alias("k"))
    return long.select("sample_id", (F.col("k") + (first - 1)).alias("step"), "slot", F.col("slot").alias("parent_slot"), F.get("path", F.col("k") - 1).alias("transit"), F.get("path", F.col("k")).alias("vertex"))


def _fan_out(graph: Graph, app: SamplingApp, seed: int, strategy: str, balance: bool) -> DataFrame:
    index, broadcast = prepared_index(graph, app.weighted, strategy)
    rows, steps = start(graph, app), []
    how = Joins(True) if broadcast else Joins.of(graph, app, False, balance) if ALL_NEIGHBORS not in [app.size(k) for k in range(app.steps)] else Joins(False, False, balance)
    for step in range(app.steps):
        size = app.size(step)
        if size == ALL_NEIGHBORS:
            rows = all_neighbors(rows, graph)
        elif app.distinct or not app.weighted and app.next is None:
            rows = fan_join(rows, index, how, app, step, seed).filter("vertex IS NOT NULL")
        else:
            rows = rows.withColumn("parent_slot", F.col("slot")).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(size - 1))))
            rows = rows.withColumn("slot", F.col("parent_slot") * size + F.col("j")).drop("j")
            rows = step_join(rows, index, how, app, step, seed, "slot").filter("vertex IS NOT NULL")
        rows = stored(rows.drop(*KEYS, "degree", "total")) if step + 1 < app.steps else rows
        steps.append(rows.select("sample_id", F.lit(step).alias("step"), F.col("slot").cast("long").alias("slot"), F.col("parent_slot").cast("long").alias("parent_slot"), "transit", "vertex"))
        if step + 1 < app.steps and rows.isEmpty():
            break
        rows = onward(rows)
    return functools.reduce(DataFrame.unionByName, steps)


def all_neighbors(rows: DataFrame, graph: Graph) -> DataFrame:
    """Every neighbour of every frontier row; slot = parent_slot * (largest degree) + place."""
    most = graph.degrees.agg(F.max("degree")).first()[0] or 1
    # a row meets each range of its transit's edges by itself: a hub is in no one task
    index = graph.uniform_index.withColumnsRenamed({"dst": "vertex_", "dst_degree": "v_degree", "vertex": "transit"}).withColumn("range", F.floor(F.col("cell") / RANGE).cast("int"))
    rows = rows.filter("degree > 0").withColumn("range", F.explode(F.sequence(F.lit(0), F.floor((F.col("degree") - 1) / RANGE).cast("int"))))
    joined = rows.join(index, ["transit", "range"]).drop("range").withColumnRenamed("vertex_", "vertex")
    return joined.withColumn("parent_slot", F.col("slot")).withColumn("slot", F.col("parent_slot").cast("long") * most + F.col("cell")).withColumn("v_total", F.col("v_degree").cast("double")).drop("cell")
