"""The samplers that come with the engine."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rng
from ..operators import validate
from ..operators.graph import Graph
from .app import OutputFormat, SamplingApp, SamplingType, batch_seeds, every, one_seed_per_vertex, passes
from .engine import SamplingRun, chosen, run

STEPS = 100
#: Walks from each vertex in the walk apps, on graphs of any size.
WALKS = 100
#: Vertices from which the original takes one walk from each.
SMALL_GRAPH = 262_144
#: Layers of the layer samplers, and their vertices and samples.
LAYERS, LAYER_SIZE, LAYER_SAMPLES = 5, 64, 10_000
ROOTS = 100


def walk_count(n_vertices: int) -> int:
    """The number of walks in the original, which cuts them on large graphs. No sampler here does: they take ``WALKS`` from each."""
    return 100 * n_vertices if n_vertices < SMALL_GRAPH else n_vertices


def _walk_seeds(samples):
    return lambda graph: one_seed_per_vertex(WALKS * graph.n_vertices if samples is None else samples)(graph)


def uniform_walk(steps: int = STEPS, samples: int | None = None) -> SamplingApp:
    """One uniform walk from each vertex."""
    return SamplingApp("uniform walk", steps, 1, one_seed_per_vertex(samples))


def deepwalk(steps: int = STEPS, samples: int | None = None) -> SamplingApp:
    """Walks that choose edges by weight; if all of a vertex's weights are 0, uniformly."""
    return SamplingApp("deepwalk", steps, 1, _walk_seeds(samples), weighted=True)


def ppr(steps: int = STEPS, samples: int | None = None, end: float = 0.01) -> SamplingApp:
    """As deepwalk; before each choice a walk ends with chance ``end``."""
    return SamplingApp("ppr", steps, 1, _walk_seeds(samples), weighted=True, end=end)


def khop(sizes=(25, 10), samples: int | None = None) -> SamplingApp:
    """Neighbourhood samples with replacement, ``sizes`` neighbours a hop."""
    return SamplingApp("k-hop", len(sizes), list(sizes), one_seed_per_vertex(samples))


def layer(sizes=(10, 25), samples: int | None = None) -> SamplingApp:
    """Layer samples: as k-hop, small layer first."""
    return SamplingApp("layer", len(sizes), list(sizes), one_seed_per_vertex(samples))


def khop_distinct(sizes=(25, 10), samples: int | None = None) -> SamplingApp:
    """Neighbourhood samples without replacement: the edges of one transit are different ones."""
    return SamplingApp("k-hop, different edges", len(sizes), list(sizes), one_seed_per_vertex(samples), distinct=True)


# ------------------------------------------------------------------ second order

def node2vec_app(steps: int = STEPS, samples: int | None = None, p: float = 2.0, q: float = 0.5) -> SamplingApp:
    """Second-order walks: a neighbour v weighs p if it is the transit before (p is the
    return's weight, not its inverse), 1/q if that transit has an edge to v, else 1. The
    first step, and a transit with one edge, take the first neighbour. Edge weights are
    not used."""
    weigh = lambda c: F.when(c.vertex == c.previous, p).when(c.near, 1 / q).otherwise(1.0)
    sure = lambda c: F.when((F.expr(str(c.step)) == 0) | (c.degree == 1), 0)
    check = lambda g, found, seed: validate.chain_violations(found, _walk_seeds(samples)(g), g, steps)
    return SamplingApp("node2vec", steps, 1, _walk_seeds(samples), weigh=weigh, most=max(p, 1 / q, 1.0), sure=sure, second_order=(p, q), check=check)


def node2vec(graph: Graph, steps: int = STEPS, samples: int | None = None, p: float = 2.0, q: float = 0.5, seed: int = 42, strategy: str = "auto") -> DataFrame:
    return run(graph, node2vec_app(steps, samples, p, q), seed, strategy).samples


def weighted_node2vec(steps: int = STEPS, samples: int | None = None, p: float = 2.0, q: float = 0.5) -> SamplingApp:
    """Second-order walks over weighted edges: an edge's weight times p, 1/q or 1, as in
    ``node2vec_app``; in the first step the weight alone. Looks at all edges of a transit."""

    def weights(b):
        return b.weight * np.where(b.previous < 0, 1.0, np.where(b.vertex == b.previous, p, np.where(b.near, 1 / q, 1.0)))

    check = lambda g, found, seed: validate.chain_violations(found, one_seed_per_vertex(samples)(g), g, steps)
    return SamplingApp("weighted node2vec", steps, 1, one_seed_per_vertex(samples), choose=weights, asks_near=True, check=check)


# -------------------------------------------------------------------- many roots

def root_table(graph: Graph, samples: int, roots: int, seed: int) -> DataFrame:
    """(sample_id, i, v): the roots of each sample, drawn uniformly from all vertices."""
    each = every(graph.spark, samples, i=roots)
    return each.withColumn("v", (rng.draw(seed, "sample_id", -1, "i", 0) % max(graph.n_vertices, 1)).cast("int"))


def multirw_app(steps: int = STEPS, samples: int | None = None, roots: int = ROOTS, seed: int = 42) -> SamplingApp:
    """Walks with many roots: each step moves from a root drawn uniformly (the first step
    from root 0) to a uniform neighbour, which replaces the root, save in the first step.
    A root without edges stays and gives no vertex. The roots and their degrees are the
    walk's state, drawn by ``seed``, with which the app is to be run."""
    count = lambda g: g.n_vertices if samples is None else samples

    def seeds(g: Graph) -> DataFrame:
        each = root_table(g, count(g), roots, seed).join(g.degrees.select(F.col("id").alias("v"), "degree"), "v", "left").withColumn("d", F.coalesce("degree", F.lit(0)))
        rows = each.groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("i", "v", "d"))).alias("r"))
        return rows.select("sample_id", F.lit(0).alias("slot"), F.get("r", F.lit(0))["v"].alias("transit"), F.transform("r", lambda x: F.struct(x["v"].alias("v"), x["d"].alias("d"))).alias("roots"))

    drawn = lambda c: rng.pick(c.u(1), roots)
    root = lambda c: F.get(c.state["roots"], drawn(c))

    def update(c):
        if c.step == 0:
            return {}
        put = F.transform("roots", lambda r, i: F.when(i == drawn(c), F.struct(c.state["vertex"].alias("v"), c.state["v_degree"].alias("d"))).otherwise(r))
        return {"roots": F.when(c.state["vertex"].isNull(), c.state["roots"]).otherwise(put)}

    check = lambda g, found, seed_: validate.root_violations(found, root_table(g, count(g), roots, seed), g)
    return SamplingApp("multi-root walk", steps, 1, seeds, update=update, transits=lambda c: root(c)["v"], degree_of=lambda c: root(c)["d"], many_roots=roots, samples=count, check=check)


def multirw(graph: Graph, steps: int = STEPS, samples: int | None = None, roots: int = ROOTS, seed: int = 42, strategy: str = "auto") -> DataFrame:
    return run(graph, multirw_app(steps, samples, roots, seed), seed, strategy).samples


# --------------------------------------------------------------------- sub-graphs

def layer_vertices(graph: Graph, layers: int = LAYERS, size: int = LAYER_SIZE, samples: int = LAYER_SAMPLES, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """The vertices of the layers: (sample_id, layer, row, src) of the layer before each, whose
    first are the seeds, and (sample_id, layer, col, dst) as drawn."""
    n = graph.n_vertices
    seeds = batch_seeds(samples, size)(graph).select("sample_id", F.lit(0).alias("layer"), F.col("slot").alias("row"), F.col("transit").alias("src"))
    drawn = every(graph.spark, samples, layer=layers, col=size)
    drawn = drawn.withColumn("dst", rng.pick(rng.uniform(seed, "sample_id", "layer", "col", 0), n))
    before = seeds.unionByName(drawn.filter(F.col("layer") < layers - 1).select("sample_id", (F.col("layer") + 1).alias("layer"), F.col("col").alias("row"), F.col("dst").alias("src")))
    return before, drawn


def layer_matrices(graph: Graph, layers: int = LAYERS, size: int = LAYER_SIZE, samples: int = LAYER_SAMPLES, seed: int = 42, strategy: str = "auto") -> DataFrame:
    """(sample_id, layer, row, col, src, dst): in each layer ``size`` ids are drawn uniformly
    from all vertices; an entry says that vertex ``row`` of the layer before (the seeds
    before the first) has an edge to drawn vertex ``col``. Both layer samplers, the
    importance-free FastGCN and LADIES forms, are this."""
    return layer_entries(graph, *layer_vertices(graph, layers, size, samples, seed), strategy)


def layer_entries(graph: Graph, before: DataFrame, drawn: DataFrame, strategy: str = "auto") -> DataFrame:
    """The entries of the matrices between ``before`` and ``drawn`` vertices of layers."""
    out = ["sample_id", "layer", "row", "col", "src", "dst"]
    if chosen(graph, strategy) == "sample":
        # the pairs of a sample's layers probe the edges, one number each, in memory
        key = lambda a, b: F.col(a).cast("long") * graph.n_vertices + F.col(b)
        edges = graph.pairs.select(key("src", "dst").alias("edge"))
        return before.join(drawn, ["sample_id", "layer"]).withColumn("edge", key("src", "dst")).join(F.broadcast(edges), "edge", "left_semi").select(*out)
    # larger graphs: edges of the layers before, by equal keys only
    return before.join(graph.pairs, "src").join(drawn, ["sample_id", "layer", "dst"]).select(*out)


def layer_violations(graph: Graph, found: DataFrame, layers: int = LAYERS, size: int = LAYER_SIZE, samples: int = LAYER_SAMPLES, seed: int = 42) -> DataFrame:
    before, drawn = layer_vertices(graph, layers, size, samples, seed)
    return validate.matrix_violations(found, before, drawn, graph, layer_entries(graph, before, drawn))


fastgcn = layer_matrices
ladies = layer_matrices


def mvs(graph: Graph, size: int = 32, samples: int | None = None) -> DataFrame:
    """(sample_id, slot, src, dst): all edges of the vertices of each batch, parallel ones too."""
    samples = passes(graph.n_vertices, size) if samples is None else samples
    seeds = batch_seeds(samples, size)(graph)
    return seeds.join(graph.kept_edges, F.col("transit") == F.col("src")).select("sample_id", "slot", "src", "dst")


def cluster_seeds(graph: Graph, samples: int, width: int = 16, each: int = 2) -> DataFrame:
    """(sample_id, slot, vertex): sample s has clusters (each s + k) mod C, which are runs of
    ``width`` ids; what is left of the ids is in no cluster."""
    clusters = max(graph.n_vertices // width, 1)
    rows = every(graph.spark, samples, slot=each * width)
    cluster = F.pmod(F.col("sample_id") * each + F.floor(F.col("slot") / width), F.lit(clusters))
    return rows.select("sample_id", "slot", (cluster * width + F.pmod("slot", F.lit(width))).cast("int").alias("vertex")).filter(F.col("vertex") < graph.n_vertices)


def clustergcn(graph: Graph, samples: int | None = None, width: int = 16, each: int = 2) -> DataFrame:
    """(sample_id, src, dst): edges among the vertices of each sample's clusters, each pair once."""
    samples = passes(graph.n_vertices, width * each) if samples is None else samples
    # edges meet pairs of clusters, each * each a sample, rather than every sample that their source is in
    clusters = max(graph.n_vertices // width, 1)
    cluster = lambda k: F.pmod(F.col("sample_id") * each + F.col(k), F.lit(clusters)).alias(k)
    together = every(graph.spark, samples, a=each, b=each).select("sample_id", cluster("a"), cluster("b"))
    own = lambda v: F.floor(F.col(v) / width)
    edges = graph.kept_edges.select("src", "dst", own("src").alias("a"), own("dst").alias("b"))
    inside = edges.join(together.select("a", "b").distinct(), ["a", "b"], "left_semi").distinct()
    return inside.join(together, ["a", "b"]).select("sample_id", "src", "dst")


def layer_app(layers: int = LAYERS, size: int = LAYER_SIZE, samples: int = LAYER_SAMPLES) -> SamplingApp:
    """The layer samplers without importance, FastGCN's and LADIES's uniform forms."""
    make = lambda g, seed, strategy: layer_matrices(g, layers, size, samples, seed, strategy)
    check = lambda g, found, seed: layer_violations(g, found, layers, size, samples, seed)
    return SamplingApp("layer matrices", layers, size, batch_seeds(samples, size), table=make, check=check, sampling_type=SamplingType.COLLECTIVE, output=OutputFormat.ADJACENCY_MATRIX, initial_size=size)


def ladies_app(layers: int = LAYERS, size: int = LAYER_SIZE, samples: int | None = None) -> SamplingApp:
    """LADIES: a layer's vertices are drawn without replacement from the neighbours of the one
    before, each by the square of the number of edges that lead to it from there. Eight passes
    over the vertices unless ``samples`` is given."""
    seeds = lambda g: batch_seeds(passes(g.n_vertices, size) if samples is None else samples, size)(g)
    check = lambda g, found, seed: validate.vertex_violations(found, seeds(g), g, layers)
    return SamplingApp("ladies by importance", layers, size, seeds, importance=lambda n, weight: n * n, counts=True, check=check, sampling_type=SamplingType.COLLECTIVE, output=OutputFormat.ADJACENCY_MATRIX, initial_size=size)


def mvs_app(size: int = 32, samples: int | None = None) -> SamplingApp:
    count = lambda g: passes(g.n_vertices, size) if samples is None else samples
    check = lambda g, found, seed: validate.batch_violations(found, batch_seeds(count(g), size)(g), g)
    return SamplingApp("mini-batch edges", 1, size, lambda g: batch_seeds(count(g), size)(g), table=lambda g, seed, strategy: mvs(g, size, count(g)), check=check, sampling_type=SamplingType.COLLECTIVE, output=OutputFormat.ADJACENCY_MATRIX, initial_size=size)


def clustergcn_app(samples: int | None = None, width: int = 16, each: int = 2) -> SamplingApp:
    size = width * each
    count = lambda g: passes(g.n_vertices, size) if samples is None else samples
    members = lambda g: cluster_seeds(g, count(g), width, each)
    check = lambda g, found, seed: validate.subgraph_violations(found, members(g), g)
    return SamplingApp("cluster sub-graphs", 1, size, lambda g: members(g).withColumnRenamed("vertex", "transit"), table=lambda g, seed, strategy: clustergcn(g, count(g), width, each), check=check, sampling_type=SamplingType.COLLECTIVE, output=OutputFormat.ADJACENCY_MATRIX, initial_size=size)


#: All samplers by name, each run by the engine's ``run``.
APPS = {
    "uniform": uniform_walk,
    "deepwalk": deepwalk,
    "ppr": ppr,
    "khop": khop,
    "khop-distinct": khop_distinct,
    "layer": layer,
    "node2vec": node2vec_app,
    "node2vec-weighted": weighted_node2vec,
    "multirw": multirw_app,
    "fastgcn": layer_app,
    "ladies": layer_app,
    "ladies-importance": ladies_app,
    "mvs": mvs_app,
    "clustergcn": clustergcn_app,
}


def app_of(name: str, seed: int = 42, **options) -> SamplingApp:
    if name not in APPS:
        raise ValueError(f"no sampler {name!r}; there are {sorted(APPS)}")
    return APPS[name](**options, **({"seed": seed} if name == "multirw" else {}))


def sample(graph: Graph, name: str, seed: int = 42, strategy: str = "auto", **options) -> DataFrame:
    """The result of a sampler by its name."""
    return run(graph, app_of(name, seed, **options), seed, strategy).samples


def violations(graph: Graph, name: str, result: DataFrame, seed: int = 42, **options) -> DataFrame:
    """The rows of a sampler's result that break its property, empty steps too."""
    return SamplingRun(app_of(name, seed, **options), graph, result).violations(seed)
