"""Choices that look at the edges of a transit.

A vertex's edges lie in ranges of ``RANGE``. A frontier row meets each range of its transit in
a row of its own, so that a hub's edges are spread over tasks. The app's function weighs the
edges of many such rows in one Arrow batch; in each range one edge is taken by weight, and a
race gives one of the ranges by summed weight: of keys -ln(u) / sum the least, found by an
aggregation that is combined before it is shuffled. Two draws a range, not one an edge.
"""

from __future__ import annotations

import dataclasses

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rng import Draws
from ..operators.graph import RANGE, SPAN, Graph
from ..shipping import ship
from .app import SamplingApp

PICKED = "sample_id long, slot long, range int, key double, vertex int, v_degree int, pos int"


@dataclasses.dataclass(frozen=True)
class EdgeBatch:
    """The edges of many transits, an element each. ``previous`` is the transit before, -1 where
    there is none; ``near`` says whether that one has an edge to ``vertex``."""

    step: int
    sample: np.ndarray
    slot: np.ndarray
    transit: np.ndarray
    previous: np.ndarray
    vertex: np.ndarray
    weight: np.ndarray
    near: np.ndarray | None
    state: dict[str, np.ndarray]


def edge_ranges(graph: Graph, strategy: str) -> DataFrame:
    """(i_vertex, i_range, ends, weights, far): a row for each range of a vertex's edges, kept for the run, dealt
    to tasks by vertex and range unless it is broadcast."""
    parts = int(graph.spark.conf.get("spark.sql.shuffle.partitions"))

    def make():
        found = graph.edge_ranges(RANGE).withColumnsRenamed({"vertex": "i_vertex", "range": "i_range"})
        return (found if strategy == "sample" else found.repartition(parts, "i_vertex", "i_range")).persist(StorageLevel.MEMORY_AND_DISK)

    return graph.keep(("ranges", strategy, parts), make)


def few_ends(graph: Graph, strategy: str) -> DataFrame:
    """(i_t, i_ends): the ends of vertices of fewer than ``SPAN`` edges, kept as the ranges are."""
    parts = int(graph.spark.conf.get("spark.sql.shuffle.partitions"))

    def make():
        found = graph.few_ends(SPAN).withColumnsRenamed({"vertex": "i_t", "ends": "i_ends"})
        return (found if strategy == "sample" else found.repartition(parts, "i_t")).persist(StorageLevel.MEMORY_AND_DISK)

    return graph.keep(("few ends", strategy, parts), make)


def _placed(long: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Ends with the number of the row that they are in, one number each."""
    return np.repeat(np.arange(len(long), dtype=np.int64) << 32, long) + ends


def _picked(app: SamplingApp, seed: int, step: int, names: list[str]):
    """From batches of (sample_id, slot, transit, previous, range, state.., near, ends, weights, far) to a taken edge of each row."""

    def run(batches):
        draws = Draws(seed)
        for b in batches:
            column = {n: b.column(k) for k, n in enumerate(b.schema.names)}
            long = np.diff(column["ends"].offsets.to_numpy())
            each = lambda a: np.repeat(a.to_numpy(zero_copy_only=False), long)  # noqa: B023, E731
            field = lambda n: column[n].flatten().to_numpy(zero_copy_only=False)  # noqa: B023, E731
            ends = column["ends"].flatten().fill_null(-1).to_numpy()
            near = np.isin(_placed(long, ends), _placed(np.diff(column["near"].offsets.to_numpy()), column["near"].flatten().fill_null(-1).to_numpy())) if app.asks_near else None
            batch = EdgeBatch(step, each(column["sample_id"]), each(column["slot"]), each(column["transit"]), each(column["previous"]), ends, field("weights"), near, {n: each(column[n]) for n in names})
            weight = np.asarray(app.choose(batch), np.float64)
            if len(weight) != len(batch.vertex) or not (weight >= 0).all():
                raise ValueError("a weight of 0 or more is needed for every edge")
            first = np.concatenate([[0], np.cumsum(long)[:-1]]).astype(np.int64)
            some = long > 0
            total = np.zeros(len(long))
            upto = np.empty_like(weight)
            for k in range(RANGE):  # running sums inside the rows, a place at a time
                at = first[long > k] + k
                if not len(at):
                    break
                upto[at] = weight[at] + (upto[at - 1] if k else 0)
            total[some] = upto[first[some] + long[some] - 1]
            ok = np.flatnonzero(total > 0)
            sample, slot, part = (column[n].to_numpy(zero_copy_only=False)[ok].astype(np.int64) for n in ("sample_id", "slot", "range"))
            x = draws(sample, step, slot, 2 * part + 3) * total[ok]
            key = -np.log(draws(sample, step, slot, 2 * part + 2)) / total[ok]
            low, high = first[ok], first[ok] + long[ok] - 1
            while (open_ := low < high).any():  # the first edge whose running sum is at least x
                mid = (low + high) >> 1
                up = open_ & (upto[mid] < x)
                low, high = np.where(up, mid + 1, low), np.where(open_ & ~up, mid, high)
            pos = part * RANGE + low - first[ok]
            arrays = [sample, slot, part.astype(np.int32), key, ends[low], field("far")[low], pos.astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], ["sample_id", "slot", "range", "key", "vertex", "v_degree", "pos"])

    return run


def chosen_edges(rows: DataFrame, graph: Graph, app: SamplingApp, seed: int, step: int, strategy: str) -> DataFrame:
    """(sample_id, slot, vertex, v_degree, pos): the edge taken for each of rows(sample_id, slot,
    transit, degree, previous, previous_degree, state..) that has one of a weight above 0. (sample_id, slot) is unique."""
    ship(graph.spark)
    index = edge_ranges(graph, strategy)
    index = F.broadcast(index) if strategy == "sample" else index.hint("shuffle_hash")
    own = ["sample_id", "slot", "transit", "previous", *app.edge_columns]
    rows = rows.filter("degree > 0")
    if app.asks_near and step > 0:
        rows = _with_near(rows, graph, index, own, strategy)
    else:
        rows = _ranged(rows).select(*own, "range", F.array().cast("array<int>").alias("near"))
    rows = rows.join(index, _in_range())
    rows = rows.select(F.col("sample_id").cast("long"), F.col("slot").cast("long"), "transit", F.coalesce("previous", F.lit(-1)).alias("previous"), "range", *app.edge_columns, "near", "ends", "weights", "far")
    picked = rows.mapInArrow(_picked(dataclasses.replace(app, seeds=None, update=None, transits=None, stop=None), seed, step, list(app.edge_columns)), PICKED)
    best = picked.groupBy("sample_id", "slot").agg(F.min_by(F.struct("vertex", "v_degree", "pos"), F.struct("key", "range")).alias("b"))
    return best.select("sample_id", "slot", F.when(F.col("b.vertex") >= 0, F.col("b.vertex")).alias("vertex"), "b.v_degree", "b.pos")


def _ranged(rows: DataFrame) -> DataFrame:
    return rows.withColumn("range", F.explode(F.sequence(F.lit(0), F.floor((F.col("degree") - 1) / RANGE).cast("int"))))


def _in_range():
    return (F.col("transit") == F.col("i_vertex")) & (F.col("range") == F.col("i_range"))


def _with_near(rows: DataFrame, graph: Graph, index: DataFrame, own: list[str], strategy: str) -> DataFrame:
    """rows(own.., range, near): those of a range's ends, and maybe others, that ``previous`` has an edge to. Of transit
    and previous the one of fewer edges sends its ends to the other, as one list. Only where ``previous`` has ``SPAN``
    edges or more does each edge meet the pairs by a key of its own."""
    lists = few_ends(graph, strategy)
    lists = F.broadcast(lists) if strategy == "sample" else lists.hint("shuffle_hash")
    few, fewer = F.coalesce(F.col("previous_degree"), F.lit(0)) < SPAN, F.coalesce(F.col("previous_degree"), F.lit(0)) <= F.col("degree")
    no_ends, here = F.array().cast("array<int>"), F.col("previous") == F.col("i_t")
    # previous's ends go to every range of the transit
    sent = _ranged(rows.filter(few & fewer).join(lists, here, "left")).select(*own, "range", F.coalesce("i_ends", no_ends).alias("near"))
    # the transit's go to previous, which keeps those it has
    asked = _ranged(rows.filter(few & ~fewer)).join(index.select("i_vertex", "i_range", "ends"), _in_range()).select(*own, "range", "ends")
    found = sent.unionByName(asked.join(lists, here, "left").select(*own, "range", F.coalesce(F.array_intersect("ends", "i_ends"), no_ends).alias("near")))
    if graph.most_edges < SPAN:
        return found
    many = _ranged(rows.filter(~few))
    flat = many.join(index.select("i_vertex", "i_range", "ends"), _in_range()).select("sample_id", "slot", "range", "previous", F.explode("ends").alias("dst"))
    pairs = graph.pairs.select(F.col("src").alias("previous"), "dst")
    met = flat.join(pairs.hint("merge"), ["previous", "dst"], "left_semi").groupBy("sample_id", "slot", "range").agg(F.collect_set("dst").alias("near"))
    return found.unionByName(many.join(met, ["sample_id", "slot", "range"], "left").select(*own, "range", F.coalesce("near", no_ends).alias("near")))
