"""What a sampler declares: steps, fan-out, seeds, and how the next vertex is chosen."""

from __future__ import annotations

import dataclasses
import enum
import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rng
from ..operators.graph import Graph

#: Fan-out that takes every neighbour.
ALL_NEIGHBORS = -1


class SamplingType(enum.Enum):
    INDIVIDUAL = "individual"  # a choice looks at one transit's neighbours
    COLLECTIVE = "collective"  # a choice looks at all transits of a sample


class OutputFormat(enum.Enum):
    SAMPLED_VERTICES = "vertices"
    ADJACENCY_MATRIX = "matrix"


@dataclasses.dataclass(frozen=True)
class StepContext:
    """What a choice may use: columns of the frontier row, and draws. ``step`` is a number or the name
    of a column, ``slot`` such a name. Where a proposed edge is
    weighed, also ``vertex``, its end, ``previous``, the transit before (null in the first
    step), and ``near``, whether that one has an edge to ``vertex``."""

    step: int | str
    seed: int
    degree: Column
    total: Column
    transit: Column
    slot: str
    state: dict[str, Column]
    vertex: Column | None = None
    previous: Column | None = None
    near: Column | None = None

    def u(self, number: int | str = 0) -> Column:
        """The ``number``-th draw in (0, 1] of this sample, step and slot."""
        return rng.uniform(self.seed, "sample_id", self.step, self.slot, number)


@dataclasses.dataclass(frozen=True)
class SamplingApp:
    """A sampler.

    ``next``: a Column builder that gives the place of the chosen neighbour among the
    transit's, or null to end; by default uniform. ``weighted`` chooses by edge weight
    instead. ``end``: the chance that a sample ends before a choice. ``stop``: a Column
    builder, true where it ends. Walks may have state: columns that ``seeds`` gives, which
    ``update`` replaces after each choice (names to Columns, which may use ``vertex``), and
    from which ``transits`` names the next step's transit; else that is the chosen vertex.

    ``weigh``: a Column builder, the weight of a proposed uniform edge, which is accepted
    with chance weight / ``most``; else another one is proposed. At least one edge of a transit
    must have a weight above 0. ``sure`` names the place of an edge to take unweighed, or null.
    ``second_order``: (p, q) of node2vec's weights, which tasks know too.

    ``choose``: a function of an ``EdgeBatch`` (``plans/edges.py``) that gives the weight of every
    edge of a transit; one edge is taken by weight. ``asks_near`` if it looks at ``near``. It may go
    with end, stop, state and transits; ``edge_columns`` names the state it looks at.
    ``distinct``: a transit's choices of one step are different edges.
    ``degree_of``: the next transit's degree, where the state knows it. ``many_roots``: how many
    roots the state holds, where it is those alone, which tasks know too; ``samples``, a function of the
    graph, then gives the number of samples, 0 and on. ``importance``, of a
    collective app: a Column builder from the number and the summed weight of the edges that lead
    from a sample's transits to a vertex to its weight; vertices are drawn by it without
    replacement. ``counts`` if it is made of the number alone by operators that arrays have too, so that
    tasks know it. ``table``: a function of graph, seed and strategy that gives the sampler's edges, for
    samplers that aren't steps of choices, and ``check`` one of graph, result and seed for what
    breaks its property.
    """

    name: str
    steps: int
    step_size: int | Sequence[int] = 1
    seeds: Callable[[Graph], DataFrame] | None = None
    next: Callable[[StepContext], Column] | None = None
    weighted: bool = False
    end: float | None = None
    stop: Callable[[StepContext], Column] | None = None
    update: Callable[[StepContext], dict[str, Column]] | None = None
    transits: Callable[[StepContext], Column] | None = None
    weigh: Callable[[StepContext], Column] | None = None
    most: float = 1.0
    sure: Callable[[StepContext], Column] | None = None
    second_order: tuple[float, float] | None = None
    choose: Callable | None = None
    asks_near: bool = False
    edge_columns: Sequence[str] = ()
    distinct: bool = False
    degree_of: Callable[[StepContext], Column] | None = None
    many_roots: int | None = None
    samples: Callable[[Graph], int] | None = None
    importance: Callable[[Column, Column], Column] | None = None
    counts: bool = False
    table: Callable[[Graph, int, str], DataFrame] | None = None
    check: Callable[[Graph, DataFrame, int], DataFrame] | None = None
    sampling_type: SamplingType = SamplingType.INDIVIDUAL
    output: OutputFormat = OutputFormat.SAMPLED_VERTICES
    initial_size: int = 1

    def size(self, step: int) -> int:
        return self.step_size if isinstance(self.step_size, int) else self.step_size[step]

    def is_plain(self) -> bool:
        """Whether all choices are named, not Columns."""
        return self.next is self.stop is self.update is self.transits is self.weigh is self.choose is None and all(self.size(k) > 0 for k in range(self.steps))

    def outputs_until(self, step: int) -> int:
        """Outputs of a sample up to and with ``step``; before the first step its seeds."""
        if step < 0:
            return 0
        if self.sampling_type is SamplingType.COLLECTIVE:
            return sum(self.size(k) for k in range(step + 1))
        total = self.initial_size
        for k in range(step + 1):
            total *= self.size(k)
        return total

    def transits_at(self, step: int) -> int:
        """Transits of a sample at ``step``."""
        return self.initial_size if step == 0 else self.outputs_until(step - 1)

    def final_size(self) -> int:
        """Vertices of one finished sample; the seeds aren't counted."""
        if self.sampling_type is SamplingType.COLLECTIVE:
            return sum(self.size(k) for k in range(self.steps))
        total, product = 0, 1
        for k in range(self.steps):
            product *= self.size(k)
            total += product
        return total


#: Samples of one task, where a sampler has one seed each: what a task holds of them doesn't grow with the graph.
SEEDS = 1 << 18


def one_seed_per_vertex(samples: int | None = None) -> Callable[[Graph], DataFrame]:
    """Sample s starts at vertex s mod n; n samples unless given."""

    def seeds(graph: Graph) -> DataFrame:
        n = graph.n_vertices
        count = n if samples is None else samples
        rows = graph.spark.range(0, count, 1, max(graph.spark.sparkContext.defaultParallelism, -(-count // SEEDS)))
        return rows.select(F.col("id").alias("sample_id"), F.lit(0).alias("slot"), F.pmod("id", F.lit(max(n, 1))).cast("int").alias("transit"))

    return seeds


def batch_seeds(samples: int, size: int) -> Callable[[Graph], DataFrame]:
    """Sample s has the vertices (s size + i) mod n."""

    def seeds(graph: Graph) -> DataFrame:
        rows = every(graph.spark, samples, slot=size)
        return rows.select("sample_id", "slot", F.pmod(F.col("sample_id") * size + F.col("slot"), F.lit(max(graph.n_vertices, 1))).cast("int").alias("transit"))

    return seeds


def every(spark: SparkSession, samples: int, **sizes: int) -> DataFrame:
    """(sample_id, and a column for each of ``sizes``, from 0): all of their combinations. One range of
    all rows, as the planner counts a range's rows but not those that explode makes of it, and
    would send tables of any size through the driver to be broadcast."""
    rest, rows = math.prod(sizes.values()), spark.range(samples * math.prod(sizes.values()))
    columns = [F.expr(f"id div {max(rest, 1)}").alias("sample_id")]
    for name, size in sizes.items():
        rest //= max(size, 1)
        columns.append(F.expr(f"cast(id div {max(rest, 1)} % {max(size, 1)} AS int)").alias(name))
    return rows.select(*columns)


def passes(n_vertices: int, size: int = 32) -> int:
    """How many batches of ``size`` a sub-graph sampler draws: eight passes over the vertices of a graph of any size."""
    return -(-8 * n_vertices // size)


def batches(n_vertices: int, n_edges: int, size: int = 32, most: int = 1_500_000) -> int:
    """The number of batches in the original, which cuts the passes on large graphs. No sampler here does: see ``passes``."""
    return 800_000 if n_edges > 10**8 else min(most, passes(n_vertices, size))
