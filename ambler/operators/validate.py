"""Validators: each gives the rows that break a property, so a valid result gives none."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..shipping import ship
from .graph import SPAN, Graph, whole
from .storage import stored


def _levels(samples: DataFrame, seeds: DataFrame) -> DataFrame:
    """(sample_id, step, vertex) with the seeds as step -1."""
    return samples.select("sample_id", "step", "vertex").unionByName(seeds.select("sample_id", F.lit(-1).alias("step"), F.col("transit").alias("vertex")))


def vertex_violations(samples: DataFrame, seeds: DataFrame, graph: Graph, most_steps: int | None = None) -> DataFrame:
    """(sample_id, step, vertex, kind). ``not_neighbor``: a vertex that no vertex of the step
    before has an edge to. ``empty_step``: no vertex, though the step before has edges
    (null vertex); a step that an earlier one of its sample ended isn't reported. Steps are
    due up to ``most_steps``, or the last of any sample."""
    last = _levels(samples, seeds).select("sample_id", (F.col("step") + 1).alias("step"), F.col("vertex").alias("src")).distinct()
    now = samples.select("sample_id", "step", "vertex").distinct()
    if most_steps is not None:
        now, last = now.filter(F.col("step") < most_steps), last.filter(F.col("step") < most_steps)
    # the pairs of a step and the one before are looked up among the edges; a hub's other edges meet nothing
    key = ["sample_id", "step", "vertex"]
    probes, pair = last.join(now, ["sample_id", "step"]), ["src", "vertex"]
    allowed = probes.join(graph.joined(probes.select(*pair).distinct(), *pair), pair, "left_semi").select(*key)
    wrong = now.join(allowed, key, "left_anti").withColumn("kind", F.lit("not_neighbor"))
    due = last.join(graph.counted.select(F.col("id").alias("src")), "src", "left_semi").select("sample_id", "step").distinct()
    if most_steps is None:
        steps = samples.agg(F.max("step")).first()[0]
        due = due.filter(F.col("step") <= (-1 if steps is None else steps))
    empty = due.join(now, ["sample_id", "step"], "left_anti").select("sample_id", "step", F.lit(None).cast("int").alias("vertex"), F.lit("empty_step").alias("kind"))
    return wrong.unionByName(empty)


def matrix_violations(matrix: DataFrame, rows: DataFrame, cols: DataFrame, graph: Graph, true: DataFrame | None = None) -> DataFrame:
    """(sample_id, layer, row, col, kind) of a layered matrix: ``not_edge`` entries, and
    ``missing`` edges between rows(sample_id, layer, row, src) and cols(sample_id, layer, col, dst);
    ``true`` has all of these edges' places if they are known."""
    key = ["sample_id", "layer", "row", "col"]
    entries = matrix.select(*key).distinct()
    true = (rows.join(graph.pairs, "src").join(cols, ["sample_id", "layer", "dst"]) if true is None else true).select(*key).distinct()
    wrong = entries.join(true, key, "left_anti").withColumn("kind", F.lit("not_edge"))
    return wrong.unionByName(true.join(entries, key, "left_anti").withColumn("kind", F.lit("missing")))


#: Samples of a vertex that are one row where edges look for samples that both ends are in.
SAMPLES = 256


def induced(members: DataFrame, graph: Graph) -> DataFrame:
    """(sample_id, src, dst): the pairs of edges inside each sample of members(sample_id, vertex). An edge has
    a row for up to some ``SAMPLES`` samples of its source, and not one for each."""
    own = members.select("sample_id", "vertex").distinct()
    most = own.groupBy("vertex").count().agg(F.max("count")).first()[0] or 1
    bucket = F.pmod(F.xxhash64("sample_id"), F.lit(-(-most // SAMPLES))).cast("int")
    lists = own.groupBy("vertex", bucket.alias("bucket")).agg(F.collect_set("sample_id").alias("samples"))
    edges = graph.pairs.join(lists.withColumnsRenamed({"vertex": "src", "samples": "__own"}), "src")
    found = edges.join(lists.withColumnRenamed("vertex", "dst"), ["dst", "bucket"])
    return found.select(F.explode(F.array_intersect("__own", "samples")).alias("sample_id"), "src", "dst")


def subgraph_violations(found: DataFrame, members: DataFrame, graph: Graph, loops: bool = False) -> DataFrame:
    """(sample_id, src, dst, kind) of induced sub-graphs over members(sample_id, vertex)."""
    true = induced(members, graph)
    entries = found.select("sample_id", "src", "dst").distinct()
    if not loops:
        true, entries = true.filter("src != dst"), entries.filter("src != dst")
    key = ["sample_id", "src", "dst"]
    return entries.join(true, key, "left_anti").withColumn("kind", F.lit("not_edge")).unionByName(true.join(entries, key, "left_anti").withColumn("kind", F.lit("missing")))


def _inside(members: DataFrame, graph: Graph) -> DataFrame:
    """As ``induced``, maybe some rows twice. Where samples are no larger than a row of edges, each row of a member's edges
    meets all members at once, and no edge is shuffled with the samples of its source."""
    own = members.select("sample_id", "vertex").distinct()
    if graph.has_hubs or (own.groupBy("sample_id").count().agg(F.max("count")).first()[0] or 0) > SPAN:
        return induced(own, graph)
    each = own.groupBy("sample_id").agg(F.sort_array(F.collect_set("vertex")).alias("members")).select("sample_id", F.explode("members").alias("vertex"), "members")
    return graph.ends.join(each.hint("shuffle_hash"), "vertex").select("sample_id", F.col("vertex").alias("src"), F.explode(F.array_intersect("ends", "members")).alias("dst"))


#: Rows up to which a join of these violations is broadcast.
FEW = 1_000_000


def batch_violations(found: DataFrame, seeds: DataFrame, graph: Graph) -> DataFrame:
    """(sample_id, src, dst, kind) of batch edges: sound over all edges, complete over pairs inside the batch.

    The rows of ``found`` stay where they are if they are dealt by source: they meet the samples of their source as a
    list, and of those of their pairs that are no edges a list, by source too."""
    key = ["sample_id", "src", "dst"]
    own, entries = seeds.select("sample_id", F.col("transit").alias("vertex")).distinct(), found.select(*key)
    inside = stored(_inside(own, graph))
    most = own.groupBy("vertex").count().agg(F.max("count")).first()[0] or 1
    bucket = F.pmod(F.xxhash64("sample_id"), F.lit(-(-most // SAMPLES))).cast("int")
    on = ["src"] if most <= SAMPLES else ["src", "bucket"]
    lists = own.withColumnRenamed("vertex", "src").withColumn("bucket", bucket).groupBy(*on).agg(F.collect_set("sample_id").alias("samples"))
    rows = (entries if most <= SAMPLES else entries.withColumn("bucket", bucket)).join(lists.hint("shuffle_hash"), on, "left")
    held = F.array_contains("samples", F.col("sample_id"))
    none = stored(entries.select("src", "dst").distinct().join(graph.kept_edges.select("src", "dst"), ["src", "dst"], "left_anti"))
    ends = none.groupBy("src").agg(F.count("*").alias("n")).agg(F.max("n"), F.sum("n")).first()
    if not ends[0]:
        rows = rows.withColumn("edge", F.lit(True))
    elif ends[0] <= SPAN:
        lists = none.groupBy("src").agg(F.collect_list("dst").alias("ends"))
        rows = rows.join(lists if ends[1] <= FEW else lists.hint("shuffle_hash"), "src", "left").withColumn("edge", ~F.coalesce(F.array_contains("ends", F.col("dst")), F.lit(False)))
    else:
        rows = rows.join(none.withColumn("edge", F.lit(False)), ["src", "dst"], "left").withColumn("edge", F.coalesce("edge", F.lit(True)))
    wrong = rows.filter(~(F.col("edge") & F.col("dst").isNotNull() & F.coalesce(held, F.lit(False)))).select(*key).distinct()
    due = F.broadcast(inside) if inside.count() <= FEW else inside
    missing = inside.join(entries.join(due, key, "left_semi"), key, "left_anti").distinct()
    return wrong.withColumn("kind", F.lit("not_edge")).unionByName(missing.withColumn("kind", F.lit("missing")))


def edge_violations(samples: DataFrame, graph: Graph) -> DataFrame:
    """Rows of samples whose vertex is no neighbour of their transit. A row meets all ends of its transit at once;
    pairs are looked up among the edges only where that has ``SPAN`` of them or more."""
    pair, own = ["transit", "vertex"], ["sample_id", "step", "transit", "vertex"]
    lists = graph.few_ends(SPAN).withColumnsRenamed({"vertex": "transit", "ends": "__ends"})
    rows = samples.select(*own).join(lists.hint("shuffle_hash"), "transit", "left")
    found, rest = rows.filter(F.col("__ends").isNotNull() & ~F.coalesce(F.array_contains("__ends", F.col("vertex")), F.lit(False))).select(*own), rows.filter("__ends IS NULL").select(*own)
    if graph.most_edges >= SPAN:
        rest = rest.join(graph.joined(rest.select(*pair).distinct(), *pair), pair, "left_anti").select(*own)
    return found.unionByName(rest).select("sample_id", "step", "vertex", F.lit("not_neighbor").alias("kind"))


def chain_violations(samples: DataFrame, seeds: DataFrame, graph: Graph, steps: int) -> DataFrame:
    """(sample_id, step, vertex, kind) of walks that go on from where they are. ``not_neighbor``: no
    edge from the transit. ``not_held``: the transit isn't the vertex of the step before, or of the
    seed. ``empty_step``: a walk stops (null vertex) before its last step at a vertex with edges."""
    at = Window.partitionBy("sample_id", "slot").orderBy("step")
    rows = samples.select("sample_id", F.col("slot").cast("long").alias("slot"), "step", "transit", "vertex")
    rows = rows.unionByName(seeds.select("sample_id", F.col("slot").cast("long").alias("slot"), F.lit(-1).alias("step"), F.lit(None).cast("int").alias("transit"), F.col("transit").alias("vertex")))
    rows = rows.withColumns({"before": F.lag("vertex").over(at), "last": F.lag("step").over(at), "next": F.lead("step").over(at)})
    held = F.col("before").eqNullSafe(F.col("transit")) & (F.coalesce(F.col("last"), F.lit(-9)) == F.col("step") - 1)
    wrong = rows.filter((F.col("step") >= 0) & ~held).select("sample_id", "step", "vertex", F.lit("not_held").alias("kind"))
    ends = rows.filter(F.col("next").isNull() & (F.col("step") < steps - 1)).join(graph.counted.select(F.col("id").alias("vertex")), "vertex", "left_semi")
    empty = ends.select("sample_id", (F.col("step") + 1).alias("step"), F.lit(None).cast("int").alias("vertex"), F.lit("empty_step").alias("kind"))
    return edge_violations(samples, graph).unionByName(wrong).unionByName(empty)


def root_violations(samples: DataFrame, roots: DataFrame, graph: Graph) -> DataFrame:
    """(sample_id, step, vertex, kind) of many-root walks from roots(sample_id, i, v). ``not_neighbor``:
    no edge from the root moved from. ``not_held``: the transit is no root held at that step; in
    the first step it must be root 0, and leaves the roots as they are, later its vertex takes its
    place. ``empty_step``: no first step (null vertex), though root 0 has edges.

    Held roots are counted for each sample and vertex: those given, plus the vertices and less
    the transits of steps before, in the task that a sample's rows are dealt to."""
    ship(graph.spark)
    id_ = lambda c: F.coalesce(c.cast("int"), F.lit(NONE))
    given = roots.select(F.col("sample_id").cast("long").alias("sample_id"), (-1 - F.col("i")).cast("int").alias("step"), id_(F.col("v")).alias("transit"), F.lit(NONE).alias("vertex"))
    moves = samples.filter("step >= 0").select(F.col("sample_id").cast("long").alias("sample_id"), F.col("step").cast("int").alias("step"), id_(F.col("transit")).alias("transit"), id_(F.col("vertex")).alias("vertex"))
    parts = max(int(graph.spark.conf.get("spark.sql.shuffle.partitions")), -(-roots.count() // REPLAYED))
    rows = given.unionByName(moves).repartition(parts, "sample_id").sortWithinPartitions("sample_id")
    found = rows.mapInArrow(_replayed, "sample_id long, step int, vertex int, due int")
    own = ["sample_id", "step", F.when(F.col("vertex") != NONE, F.col("vertex")).alias("vertex")]
    wrong = found.filter(F.col("due") == NONE).select(*own, F.lit("not_held").alias("kind"))
    empty = found.filter(F.col("due") != NONE).join(graph.counted.select(F.col("id").alias("due")), "due", "left_semi").select(*own, F.lit("empty_step").alias("kind"))
    return edge_violations(samples, graph).unionByName(wrong).unionByName(empty)


#: Roots that a task puts in order.
REPLAYED = 1 << 20
#: An id that is null.
NONE = -(1 << 31)


def _replayed(batches):
    """From (sample_id, step, transit, vertex) of whole samples, roots with steps below 0, to the steps from vertices that
    weren't held, and a row with root 0 as ``due`` of samples that have no first step."""
    for sample, step, transit, vertex in whole(batches, 0):
        given, used, moved = step < 0, step >= 0, step > 0
        at = np.flatnonzero(used)
        _, number = np.unique(sample, return_inverse=True)
        count = int(number.max()) + 1
        zero = np.flatnonzero(step == -1)
        root = np.full(count, NONE, np.int64)
        root[number[zero]] = transit[zero]
        # roots given, transits left and vertices taken, in order of sample and vertex, then of steps
        key = (number.astype(np.int64) << 33) + np.concatenate([transit, vertex]).astype(np.int64).reshape(2, -1) + (1 << 31)
        keys = np.concatenate([key[0, given], key[0, used], key[1, moved]])
        steps = np.concatenate([np.full(given.sum(), -1), step[used], step[moved]])
        change = np.concatenate([np.ones(given.sum(), np.int64), np.where(step[used] > 0, -1, 0), np.ones(moved.sum(), np.int64)])
        order = np.lexsort((steps, keys))
        keys, steps = keys[order], steps[order]
        before = np.concatenate([[0], np.cumsum(change[order])[:-1]])
        new_key = np.concatenate([[True], keys[1:] != keys[:-1]])
        new = new_key | np.concatenate([[True], steps[1:] != steps[:-1]])
        first = np.maximum.accumulate(np.where(new, np.arange(len(keys)), 0))  # of the events of its step
        begin = np.maximum.accumulate(np.where(new_key, np.arange(len(keys)), 0))
        held = np.empty(len(keys), np.int64)
        held[order] = before[first] - before[begin]
        held = held[given.sum() :][: len(at)]
        bad = at[(held < 1) | (step[at] == 0) & (transit[at] != root[number[at]])]
        started = np.zeros(count, bool)
        started[number[step == 0]] = True
        open_ = zero[~started[number[zero]]]
        columns = [np.concatenate([sample[bad], sample[open_]]), np.concatenate([step[bad], np.zeros(len(open_))]), np.concatenate([vertex[bad], np.full(len(open_), NONE)]), np.concatenate([np.full(len(bad), NONE), transit[open_]])]
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(t)) for c, t in zip(columns, (np.int64, np.int32, np.int32, np.int32), strict=True)], ["sample_id", "step", "vertex", "due"])
