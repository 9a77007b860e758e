"""Queries over the purchase graph, one for each operator, and their SQL twins.

All run over the whole graph. Walks, layers and roots are fewer here than the samplers'
defaults, so that DuckDB repeats them quickly; ``full_queries`` has the whole jobs.
"""

from __future__ import annotations

import dataclasses
import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import arrays, rng
from .operators import frontier as fr
from .operators import graph as gr
from .operators import validate
from .operators.scan import numbered
from .operators.storage import new_folder
from .plans import apps
from .plans.app import ALL_NEIGHBORS, OutputFormat, SamplingApp, SamplingType, batch_seeds, one_seed_per_vertex, passes
from .plans.engine import run
from .sources.graphs import edges_to_adjacency, purchase_graph, read_binary_edges, read_graph, write_adjacency, write_binary_edges, write_text_edges

SEED = 42
WALK, LONG = 10, 6
LAYERS, LAYER_SIZE, LAYER_SAMPLES = 3, 16, 200
ROOTS, ROOT_STEPS = 20, 4

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

EDGES = """first AS (SELECT max(l_suppkey) + 1 AS s FROM lineitem),
purchases AS MATERIALIZED (SELECT CAST(l_suppkey AS INTEGER) AS a, CAST(s + l_partkey AS INTEGER) AS b, max(l_quantity) AS q FROM lineitem, first GROUP BY 1, 2),
edges AS MATERIALIZED (SELECT a AS src, b AS dst, 1 + (CAST(floor(q) AS INTEGER) % 16) / 4.0::DOUBLE AS weight FROM purchases
  UNION ALL SELECT b, a, 1 + (CAST(floor(q) AS INTEGER) % 16) / 4.0::DOUBLE FROM purchases),
n AS MATERIALIZED (SELECT max(greatest(src, dst)) + 1 AS n FROM edges),
deg AS MATERIALIZED (SELECT src AS id, CAST(count(*) AS INTEGER) AS degree, max(weight) AS max_weight, sum(weight) AS total FROM edges GROUP BY 1),
vertices AS (SELECT CAST(r.range AS INTEGER) AS id, coalesce(degree, 0) AS degree, coalesce(max_weight, 0.0) AS max_weight, coalesce(total, 0.0) AS total
  FROM range(0, (SELECT n FROM n)) r LEFT JOIN deg ON deg.id = r.range),
pos AS MATERIALIZED (SELECT src, CAST(row_number() OVER (PARTITION BY src ORDER BY dst, weight) - 1 AS INTEGER) AS pos, dst, weight FROM edges),
cum AS (SELECT src, pos, dst, weight, sum(weight) OVER (PARTITION BY src ORDER BY pos ROWS UNBOUNDED PRECEDING) AS hi FROM pos)"""


def _sql(body: str, *more: str) -> str:
    return "WITH RECURSIVE " + ",\n".join([EDGES, *more]) + "\n" + body


def _query(sql: str | None = None):
    def add(f):
        def on(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(purchase_graph(spark, sf_dir))

        QUERIES[f.__name__] = on
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# ------------------------------------------------------------------------ graph

@_query(_sql("SELECT src, dst, weight FROM edges"))
def edges_canonical(g):
    return g.edges


@_query(_sql("SELECT (SELECT CAST(n AS BIGINT) FROM n) AS n_vertices, (SELECT count(*) FROM edges) AS n_edges"))
def graph_counts(g):
    return g.spark.range(1).select(F.lit(g.n_vertices).cast("long").alias("n_vertices"), F.lit(g.n_edges).cast("long").alias("n_edges"))


@_query(_sql("SELECT id, degree FROM vertices"))
def graph_degree(g):
    return g.vertices.select("id", "degree")


@_query(_sql("SELECT id, max_weight FROM vertices"))
def vertex_max_weight(g):
    return g.vertices.select("id", "max_weight")


CSR = """csr AS (SELECT id, degree, max_weight, CAST(coalesce(sum(degree) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_edge FROM vertices)"""


@_query(_sql("SELECT id, start_edge, CASE WHEN degree > 0 THEN start_edge + degree - 1 ELSE -1 END AS end_edge, degree, max_weight FROM csr", CSR))
def csr_offsets(g):
    return g.csr()


@_query(_sql("SELECT start_edge + pos AS edge, src, dst FROM pos JOIN csr ON id = src", CSR))
def edge_to_vertex(g):
    return g.edge_vertices()


@_query(_sql("SELECT src, pos, dst, weight FROM pos"))
def neighbor_slices(g):
    return g.positions


@_query(_sql("""SELECT p.src, p.dst, e.src IS NOT NULL AS has_edge FROM (SELECT id AS src, CAST((id * 7 + 3) % (SELECT n FROM n) AS INTEGER) AS dst FROM vertices) p
LEFT JOIN (SELECT DISTINCT src, dst FROM edges) e ON e.src = p.src AND e.dst = p.dst"""))
def has_edge_probe(g):
    return g.has_edge(g.vertices.select(F.col("id").alias("src"), F.pmod(F.col("id").cast("long") * 7 + 3, F.lit(g.n_vertices)).cast("int").alias("dst")))


@_query(_sql("SELECT src, dst, weight FROM (SELECT DISTINCT src, dst, weight FROM edges)"))
def without_parallel_edges(g):
    return g.without_parallel().edges


@_query(_sql("SELECT src AS vertex, count(DISTINCT dst) AS n_nbrs, CAST(sum(DISTINCT dst) AS BIGINT) AS sum_nbrs FROM edges GROUP BY 1"))
def adjacency_lists(g):
    return edges_to_adjacency(g.edges).select("vertex", F.size("nbrs").cast("long").alias("n_nbrs"), F.aggregate("nbrs", F.lit(0).cast("long"), lambda a, x: a + x).alias("sum_nbrs"))


@_query(_sql("SELECT CAST(CASE WHEN degree > 0 THEN floor(log2(degree)) ELSE -1 END AS INTEGER) AS bucket, count(*) AS n_vertices FROM vertices GROUP BY 1"))
def degree_buckets(g):
    return fr.degree_histogram(g)


ROOM = 65536 - 16 - 8


@_query(_sql(f"SELECT CAST(part AS INTEGER) AS part, id, CAST(min(coalesce(pos, 0)) AS INTEGER) AS first, CAST(max(coalesce(pos, -1)) AS INTEGER) AS last FROM (SELECT id, pos, floor((CASE WHEN pos IS NULL THEN before ELSE before + 16 + pos * 8 END) / {ROOM}) AS part FROM line LEFT JOIN pos ON src = id UNION ALL SELECT id, NULL, floor(before / {ROOM}) FROM line) GROUP BY 1, 2".replace("max(coalesce(pos, -1))", "coalesce(max(pos), -1)").replace("min(coalesce(pos, 0))", "coalesce(min(pos), 0)"), "line AS (SELECT id, coalesce(sum(16 + degree * 8) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM vertices)"))
def graph_parts(g):
    return gr.partition_by_bytes(g, 65536)


@_query(_sql("""SELECT id, CAST(min(depth) AS INTEGER) AS depth FROM (SELECT 0 AS id, 0 AS depth
UNION ALL SELECT dst, 1 FROM edges WHERE src = 0
UNION ALL SELECT e2.dst, 2 FROM (SELECT DISTINCT dst FROM edges WHERE src = 0) e1 JOIN edges e2 ON e2.src = e1.dst) GROUP BY id"""))
def bfs_two_steps(g):
    return gr.bfs(g, [0], 2)


# ------------------------------------------------------------------------ seeds

def _batch_sql(size: int, samples: str) -> str:
    return f"batch AS MATERIALIZED (SELECT s.range AS sample_id, CAST(i.range AS INTEGER) AS slot, CAST((s.range * {size} + i.range) % (SELECT n FROM n) AS INTEGER) AS transit FROM range(0, {samples}) s, range(0, {size}) i)"


BATCHES = "(SELECT CAST(ceil(8 * n / 32.0) AS BIGINT) FROM n)"
BATCH = _batch_sql(32, BATCHES)


def _batch(g):
    return batch_seeds(passes(g.n_vertices), 32)(g)


@_query(_sql("SELECT sample_id, slot, transit FROM batch", BATCH))
def seeds_batch32(g):
    return _batch(g)


CLUSTERS = f"""clusters AS (SELECT greatest(n // 16, 1) AS c FROM n),
members AS (SELECT DISTINCT s.range AS sample_id, CAST(i.range AS INTEGER) AS slot, CAST(((s.range * 2 + i.range // 16) % (SELECT c FROM clusters)) * 16 + i.range % 16 AS INTEGER) AS vertex
  FROM range(0, {BATCHES}) s, range(0, 32) i)"""


def _members(g):
    return apps.cluster_seeds(g, passes(g.n_vertices))


@_query(_sql("SELECT sample_id, slot, vertex FROM members WHERE vertex < (SELECT n FROM n)", CLUSTERS))
def seeds_clusters(g):
    return _members(g)


@_query(_sql("SELECT sample_id, transit, CAST(least(sample_id // greatest((SELECT n FROM n) // 4, 1), 3) AS INTEGER) AS part FROM (SELECT CAST(id AS BIGINT) AS sample_id, id AS transit FROM vertices)"))
def sample_partition(g):
    return fr.sample_parts(one_seed_per_vertex()(g).select("sample_id", "transit"), g.n_vertices, 4)


# --------------------------------------------------------------------- frontier

@_query(_sql("SELECT transit, count(*) AS n_samples FROM batch GROUP BY 1", BATCH))
def transit_histogram(g):
    return fr.histogram(_batch(g))


@_query(_sql("SELECT sample_id, transit, row_number() OVER (ORDER BY transit, sample_id) - 1 AS place FROM batch", BATCH))
def inverted_frontier(g):
    return fr.invert(_batch(g).select("sample_id", "transit"))


@_query(_sql("SELECT transit, n_samples, CAST(coalesce(sum(n_samples) OVER (ORDER BY transit ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM (SELECT transit, count(*) AS n_samples FROM batch GROUP BY 1)", BATCH))
def transit_positions(g):
    return fr.positions(_batch(g))


FIRST_HOP = _sql(
    "SELECT c.transit, n_samples, CASE WHEN n_samples >= 256 THEN 'grid' WHEN n_samples >= 32 THEN 'block' WHEN n_samples >= 8 THEN 'sub_warp' ELSE 'identity' END AS class FROM (SELECT vertex AS transit, count(*) AS n_samples FROM w GROUP BY 1) c",
    f"w AS (SELECT p.dst AS vertex FROM vertices v JOIN pos p ON p.src = v.id AND p.pos = {rng.sql_pick(rng.sql_uniform(SEED, 'v.id', 0, 0, 0), 'v.degree')} WHERE v.degree > 0)",
)


def _after_one_step(g):
    return run(g, apps.uniform_walk(1), SEED).samples.select("sample_id", F.col("vertex").alias("transit"))


@_query(FIRST_HOP)
def transit_kernel_class(g):
    return fr.kernel_classes(_after_one_step(g))


@_query(_sql("SELECT class, count(*) AS n_transits, CAST(sum(n_samples) AS BIGINT) AS n_samples, max(degree) AS max_degree FROM (" + FIRST_HOP[FIRST_HOP.rindex("SELECT c.transit") :] + ") k JOIN deg ON deg.id = k.transit GROUP BY 1", FIRST_HOP[FIRST_HOP.index("w AS (") : FIRST_HOP.rindex("\nSELECT c.transit")]))
def transit_class_report(g):
    return fr.class_report(_after_one_step(g), g)


@_query(_sql("SELECT sample_id, transit FROM (SELECT CAST(id AS BIGINT) AS sample_id, CAST(id * 3 - 100 AS INTEGER) AS transit FROM vertices) WHERE transit BETWEEN 0 AND (SELECT n FROM n) - 1"))
def invalid_cut(g):
    rows = g.vertices.select(F.col("id").cast("long").alias("sample_id"), (F.col("id") * 3 - 100).alias("transit"))
    return fr.valid(rows, g.n_vertices)


@_query(_sql("SELECT sample_id, size, CAST(coalesce(sum(size) OVER (ORDER BY sample_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM (SELECT sample_id, CAST(sum(degree) AS BIGINT) AS size FROM batch JOIN vertices ON id = transit GROUP BY 1)", BATCH))
def collective_size(g):
    return fr.collective_size(_batch(g), g)


@_query(_sql("""SELECT b.sample_id, b.slot, p.pos, p.dst, CAST(b.before + p.pos AS BIGINT) AS place FROM
(SELECT sample_id, slot, transit, coalesce(sum(degree) OVER (PARTITION BY sample_id ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM batch JOIN deg ON id = transit) b
JOIN pos p ON p.src = b.transit""", BATCH))
def collective_edges(g):
    return fr.collective_edges(_batch(g), g)


# -------------------------------------------------------------------- sub-graphs

@_query(_sql("SELECT sample_id, slot, src, dst FROM batch JOIN edges ON src = transit", BATCH))
def mvs_batch_edges(g):
    return apps.mvs(g)


CLUSTER_EDGES = "cluster_edges AS (SELECT a.sample_id, e.src, e.dst FROM members a JOIN (SELECT DISTINCT src, dst FROM edges) e ON e.src = a.vertex JOIN members b ON b.sample_id = a.sample_id AND b.vertex = e.dst)"


@_query(_sql("SELECT sample_id, src, dst FROM cluster_edges", CLUSTERS, CLUSTER_EDGES))
def clustergcn_subgraph(g):
    return apps.clustergcn(g)


# ---------------------------------------------------------------------- variants

@_query(_sql("SELECT CAST(v.id AS BIGINT) AS sample_id, CAST(p.pos AS BIGINT) AS slot, p.src AS transit, p.dst AS vertex FROM vertices v JOIN pos p ON p.src = v.id"))
def all_neighbors_step(g):
    app = SamplingApp("all", 1, [ALL_NEIGHBORS], one_seed_per_vertex())
    return run(g, app, SEED).samples.select("sample_id", "slot", "transit", "vertex")


def different_sql(size: int, step: int) -> list[str]:
    """From w{step}, ``size`` different places of each vertex's edges: p{step}(sample_id, slot, parent_slot, transit, place)."""
    u = lambda i: rng.sql_pick(rng.sql_uniform(SEED, "sample_id", step, "slot", i), f"(degree - m + {i + 1})")
    drawn = ", ".join(f"CASE WHEN {i} < m THEN {u(i)} END AS t{i}" for i in range(size))
    taken = f"t{step}"  # a level for each place, as an alias is written out wherever it is used
    for i in range(size):
        before = f"t{i} IN ({', '.join(f's{k}' for k in range(i))})" if i else "false"
        taken = f"(SELECT *, CASE WHEN {before} THEN degree - m + {i} ELSE t{i} END AS s{i} FROM {taken})"
    return [
        f"m{step} AS (SELECT w.sample_id, w.slot, w.vertex, d.degree, least({size}, d.degree) AS m FROM w{step} w JOIN deg d ON d.id = w.vertex)",
        f"t{step} AS MATERIALIZED (SELECT *, {drawn} FROM m{step})",
        f"s{step} AS (SELECT * FROM {taken})",
        f"p{step} AS (SELECT sample_id, slot * {size} + i AS slot, slot AS parent_slot, vertex AS transit, place FROM (SELECT sample_id, slot, vertex, unnest(range(0, {size})) AS i, unnest([{', '.join(f's{i}' for i in range(size))}]) AS place FROM s{step}) WHERE place IS NOT NULL)",
    ]


SEEDS = "w0 AS (SELECT CAST(id AS BIGINT) AS sample_id, CAST(0 AS BIGINT) AS slot, id AS vertex FROM vertices)"


@_query(_sql("SELECT sample_id, slot, transit, dst AS vertex, pos FROM p0 JOIN pos ON src = transit AND pos = place", SEEDS, *different_sql(5, 0)))
def sample_without_replacement(g):
    return fr.without_replacement(one_seed_per_vertex()(g), g, 5, SEED).withColumn("slot", F.col("slot").cast("long"))


# ------------------------------------------------------------------------- walks

def walk_sql(steps: int, weighted: bool = False, end: float | None = None, per_vertex: int = 1) -> list[str]:
    """CTEs w0 .. w{steps}: the walks' rows after each step."""
    out = [f"w0 AS (SELECT s.range AS sample_id, CAST(s.range % (SELECT n FROM n) AS INTEGER) AS vertex FROM range(0, {per_vertex} * (SELECT n FROM n)) s)"]
    for k in range(steps):
        u = rng.sql_uniform(SEED, "w.sample_id", k, 0, 0)
        stop = f" AND NOT ({rng.sql_uniform(SEED, 'w.sample_id', k, 0, 1)} < {end})" if end is not None else ""
        if weighted:
            out.append(f"x{k} AS (SELECT w.sample_id, w.vertex AS transit, {u} * d.total AS x FROM w{k} w JOIN deg d ON d.id = w.vertex{stop})")
            out.append(f"w{k + 1} AS (SELECT x.sample_id, x.transit, c.dst AS vertex FROM x{k} x JOIN cum c ON c.src = x.transit AND x.x > c.hi - c.weight AND x.x <= c.hi)")
        else:
            out.append(f"x{k} AS (SELECT w.sample_id, w.vertex AS transit, {rng.sql_pick(u, 'd.degree')} AS p FROM w{k} w JOIN deg d ON d.id = w.vertex{stop})")
            out.append(f"w{k + 1} AS (SELECT x.sample_id, x.transit, c.dst AS vertex FROM x{k} x JOIN pos c ON c.src = x.transit AND c.pos = x.p)")
    return out


def _steps(steps: int, columns: str = "sample_id, {k} AS step, transit, vertex") -> str:
    return " UNION ALL ".join(f"SELECT {columns.format(k=k)} FROM w{k + 1}" for k in range(steps))


def _plain(samples: DataFrame) -> DataFrame:
    return samples.select("sample_id", "step", "transit", "vertex")


@_query(_sql(_steps(WALK), *walk_sql(WALK)))
def uniform_walk(g):
    return _plain(run(g, apps.uniform_walk(WALK), SEED).samples)


@_query(_sql(_steps(WALK), *walk_sql(WALK)))
def uniform_walk_shuffled(g):
    return _plain(run(g, apps.uniform_walk(WALK), SEED, strategy="transit").samples)


@_query(_sql(_steps(LONG), *walk_sql(LONG, weighted=True, per_vertex=2)))
def deepwalk(g):
    return _plain(run(g, apps.deepwalk(LONG, 2 * g.n_vertices), SEED).samples)


@_query(_sql(_steps(LONG), *walk_sql(LONG, weighted=True, end=0.01, per_vertex=2)))
def ppr_walk(g):
    return _plain(run(g, apps.ppr(LONG, 2 * g.n_vertices), SEED).samples)


def node2vec_sql(steps: int, p: float = 2.0, q: float = 0.5, per_vertex: int = 1) -> list[str]:
    """Rounds of all walks: a row is a walk after a round, and whether it took a step in it."""
    u = lambda k: rng.sql_uniform(SEED, "w.sample_id", "w.step", 0, f"2 * w.round + {k}")
    first = "(w.step = 0 OR d.degree = 1)"
    weight = f"CASE WHEN c.dst = w.t THEN {p} WHEN e.src IS NOT NULL THEN {1 / q} ELSE 1.0 END"
    yes = f"({first} OR {u(1)} * {max(p, 1 / q, 1.0)} <= {weight})"
    return [
        "near AS (SELECT DISTINCT src, dst FROM edges)",
        f"""w AS (SELECT s.range AS sample_id, 0 AS step, 0 AS round, CAST(NULL AS INTEGER) AS t, CAST(s.range % (SELECT n FROM n) AS INTEGER) AS vertex, false AS moved FROM range(0, {per_vertex} * (SELECT n FROM n)) s
UNION ALL SELECT w.sample_id, CASE WHEN {yes} THEN w.step + 1 ELSE w.step END, CASE WHEN {yes} THEN 0 ELSE w.round + 1 END, CASE WHEN {yes} THEN w.vertex ELSE w.t END, CASE WHEN {yes} THEN c.dst ELSE w.vertex END, {yes}
FROM w JOIN deg d ON d.id = w.vertex JOIN pos c ON c.src = w.vertex AND c.pos = CASE WHEN {first} THEN 0 ELSE {rng.sql_pick(u(0), 'd.degree')} END LEFT JOIN near e ON e.src = w.t AND e.dst = c.dst WHERE w.step < {steps})""",
    ]


MOVED = "SELECT sample_id, step - 1 AS step, t AS transit, vertex FROM w WHERE moved"


@_query(_sql(MOVED, *node2vec_sql(4)))
def node2vec_walk(g):
    return _plain(apps.node2vec(g, 4, g.n_vertices, seed=SEED))


@_query(_sql(MOVED, *node2vec_sql(2)))
def node2vec_walk_shuffled(g):
    return _plain(apps.node2vec(g, 2, g.n_vertices, seed=SEED, strategy="transit"))


def multirw_sql(steps: int, roots: int) -> list[str]:
    out = [f"r0 AS (SELECT s.range AS sample_id, CAST(i.range AS INTEGER) AS i, CAST({rng.sql_draw(SEED, 's.range', -1, 'i.range', 0)} % (SELECT n FROM n) AS INTEGER) AS v FROM range(0, (SELECT n FROM n)) s, range(0, {roots}) i)"]
    for k in range(steps):
        x = "0" if k == 0 else rng.sql_pick(rng.sql_uniform(SEED, "r.sample_id", k, 0, 1), str(roots))
        out.append(f"x{k} AS (SELECT r.sample_id, r.i, r.v AS transit, {rng.sql_pick(rng.sql_uniform(SEED, 'r.sample_id', k, 0, 0), 'd.degree')} AS p FROM r{k} r JOIN deg d ON d.id = r.v WHERE r.i = {x})")
        out.append(f"w{k + 1} AS (SELECT x.sample_id, x.i, x.transit, c.dst AS vertex FROM x{k} x JOIN pos c ON c.src = x.transit AND c.pos = x.p)")
        if k + 1 < steps:
            out.append(f"r{k + 1} AS (SELECT r.sample_id, r.i, coalesce(w.vertex, r.v) AS v FROM r{k} r LEFT JOIN w{k + 1} w ON w.sample_id = r.sample_id AND w.i = r.i)" if k else "r1 AS (SELECT * FROM r0)")
    return out


@_query(_sql(_steps(ROOT_STEPS), *multirw_sql(ROOT_STEPS, ROOTS)))
def multirw_walk(g):
    return _plain(apps.multirw(g, ROOT_STEPS, g.n_vertices, ROOTS, SEED))


def hops_sql(sizes: tuple[int, ...]) -> list[str]:
    out = ["w0 AS (SELECT CAST(id AS BIGINT) AS sample_id, CAST(0 AS BIGINT) AS slot, id AS vertex FROM vertices)"]
    for k, size in enumerate(sizes):
        out.append(f"j{k} AS (SELECT w.sample_id, w.slot * {size} + j.range AS slot, w.slot AS parent_slot, w.vertex FROM w{k} w, range(0, {size}) j)")
        p = rng.sql_pick(rng.sql_uniform(SEED, "j.sample_id", k, "j.slot", 0), "d.degree")
        out.append(f"x{k} AS (SELECT j.sample_id, j.slot, j.parent_slot, j.vertex AS transit, {p} AS p FROM j{k} j JOIN deg d ON d.id = j.vertex)")
        out.append(f"w{k + 1} AS (SELECT x.sample_id, x.slot, x.parent_slot, x.transit, c.dst AS vertex FROM x{k} x JOIN pos c ON c.src = x.transit AND c.pos = x.p)")
    return out


HOP = "sample_id, {k} AS step, slot, parent_slot, transit, vertex"


def _slots(samples: DataFrame) -> DataFrame:
    return samples.withColumn("slot", F.col("slot").cast("long")).withColumn("parent_slot", F.col("parent_slot").cast("long"))


@_query(_sql(_steps(2, HOP), *hops_sql((25, 10))))
def khop_25_10(g):
    return _slots(run(g, apps.khop(), SEED).samples)


@_query(_sql(_steps(2, HOP), *hops_sql((10, 25))))
def layer_10_25(g):
    return _slots(run(g, apps.layer(), SEED).samples)


@_query(_sql("SELECT DISTINCT sample_id, step, vertex FROM (" + _steps(2, HOP) + ")", *hops_sql((10, 25))))
def hop_distinct(g):
    return fr.hop_distinct(run(g, apps.layer(), SEED).samples)


@_query(_sql("SELECT a.sample_id, a.step, count(*) AS n_shared FROM (SELECT DISTINCT sample_id, step, vertex FROM s) a JOIN (SELECT DISTINCT sample_id, step + 2 AS step, vertex FROM s) b ON a.sample_id = b.sample_id AND a.step = b.step AND a.vertex = b.vertex GROUP BY 1, 2", *walk_sql(WALK), f"s AS ({_steps(WALK)})"))
def step_overlap(g):
    return fr.step_overlap(run(g, apps.uniform_walk(WALK), SEED).samples, 2)


def _different_hops(sizes: tuple[int, ...]) -> list[str]:
    out = [SEEDS]
    for k, size in enumerate(sizes):
        out += [*different_sql(size, k), f"w{k + 1} AS MATERIALIZED (SELECT p.sample_id, p.slot, p.parent_slot, p.transit, e.dst AS vertex FROM p{k} p JOIN pos e ON e.src = p.transit AND e.pos = p.place)"]
    return out


@_query(_sql(_steps(2, HOP), *_different_hops((25, 10))))
def khop_distinct_25_10(g):
    return _slots(run(g, apps.khop_distinct(), SEED).samples)


@_query(_sql(_steps(2, HOP), *_different_hops((10, 4))))
def khop_distinct_shuffled(g):
    return _slots(run(g, apps.khop_distinct((10, 4)), SEED, strategy="transit").samples)


def choosing_sql(steps: int, weight: str) -> list[str]:
    """Walks that weigh all edges e of their transit (n: near) by ``weight``, in ranges of 256."""
    out = ["near AS MATERIALIZED (SELECT DISTINCT src, dst FROM edges)", "w0 AS (SELECT CAST(id AS BIGINT) AS sample_id, CAST(NULL AS INTEGER) AS t, id AS vertex FROM vertices)"]
    for k in range(steps):
        u = lambda i: rng.sql_uniform(SEED, "sample_id", k, 0, f"2 * part + {i}")  # noqa: B023, E731
        out.append(f"e{k} AS (SELECT w.sample_id, w.vertex AS transit, e.pos, e.dst, e.pos // {gr.RANGE} AS part, {weight} AS x FROM w{k} w JOIN pos e ON e.src = w.vertex LEFT JOIN near n ON n.src = w.t AND n.dst = e.dst)")
        out.append(f"c{k} AS (SELECT *, sum(x) OVER (PARTITION BY sample_id, part ORDER BY pos ROWS UNBOUNDED PRECEDING) AS upto, sum(x) OVER (PARTITION BY sample_id, part) AS total FROM e{k})")
        out.append(f"r{k} AS (SELECT sample_id, arg_min(part, key) AS part FROM (SELECT sample_id, part, -ln({u(2)}) / total AS key FROM (SELECT DISTINCT sample_id, part, total FROM c{k} WHERE total > 0)) GROUP BY 1)")
        out.append(f"w{k + 1} AS MATERIALIZED (SELECT c.sample_id, c.transit AS t, c.transit, arg_min(c.dst, c.pos) AS vertex FROM (SELECT *, {u(3)} * total AS at FROM c{k}) c JOIN r{k} r ON r.sample_id = c.sample_id AND r.part = c.part WHERE c.upto >= c.at GROUP BY 1, 2)")
    return out


SECOND_ORDER = "e.weight * CASE WHEN w.t IS NULL THEN 1.0 WHEN e.dst = w.t THEN 2.0 WHEN n.src IS NOT NULL THEN 2.0 ELSE 1.0 END"


@_query(_sql(_steps(4), *choosing_sql(4, SECOND_ORDER)))
def node2vec_weighted(g):
    return _plain(run(g, apps.weighted_node2vec(4), SEED).samples)


@_query(_sql(_steps(2), *choosing_sql(2, SECOND_ORDER)))
def node2vec_weighted_shuffled(g):
    return _plain(run(g, apps.weighted_node2vec(2), SEED, strategy="transit").samples)


def importance_sql(layers: int, size: int) -> list[str]:
    out = [_batch_sql(size, f"(SELECT CAST(ceil(8 * n / {size}.0) AS BIGINT) FROM n)"), "l0 AS (SELECT DISTINCT sample_id, transit AS vertex FROM batch)"]
    for k in range(layers):
        out.append(f"n{k} AS (SELECT l.sample_id, e.dst, count(*) AS n FROM l{k} l JOIN edges e ON e.src = l.vertex GROUP BY 1, 2)")
        out.append(f"l{k + 1} AS MATERIALIZED (SELECT sample_id, dst AS vertex, rank FROM (SELECT sample_id, dst, row_number() OVER (PARTITION BY sample_id ORDER BY -ln({rng.sql_uniform(SEED, 'sample_id', k, 'dst', 0)}) / CAST(n * n AS DOUBLE), dst) AS rank FROM n{k}) WHERE rank <= {size})")
    return out


@_query(_sql(" UNION ALL ".join(f"SELECT sample_id, {k} AS step, rank - 1 AS slot, vertex FROM l{k + 1}" for k in range(5)), *importance_sql(5, 64)))
def ladies_importance(g):
    return run(g, apps.ladies_app(), SEED).samples.select("sample_id", "step", "slot", "vertex")


@_query(_sql("SELECT b.sample_id, b.step, b.vertex AS row, d.vertex AS col, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT sample_id, {k} AS step, vertex FROM l{k}" for k in range(2)) + ") b JOIN edges e ON e.src = b.vertex JOIN (" + " UNION ALL ".join(f"SELECT sample_id, {k} AS step, vertex FROM l{k + 1}" for k in range(2)) + ") d ON d.sample_id = b.sample_id AND d.step = b.step AND d.vertex = e.dst GROUP BY ALL", *importance_sql(2, 32)))
def ladies_matrices(g):
    return run(g, apps.ladies_app(2, 32), SEED).output()


def layer_sql(layers: int, size: int, samples: int) -> list[str]:
    return [
        _batch_sql(size, str(samples)),
        f"drawn AS MATERIALIZED (SELECT s.range AS sample_id, CAST(l.range AS INTEGER) AS layer, CAST(c.range AS INTEGER) AS col, {rng.sql_pick(rng.sql_uniform(SEED, 's.range', 'l.range', 'c.range', 0), '(SELECT n FROM n)')} AS dst FROM range(0, {samples}) s, range(0, {layers}) l, range(0, {size}) c)",
        f"before AS (SELECT sample_id, 0 AS layer, slot AS row, transit AS src FROM batch UNION ALL SELECT sample_id, layer + 1, col, dst FROM drawn WHERE layer < {layers - 1})",
        "coo AS MATERIALIZED (SELECT b.sample_id, b.layer, b.row, d.col, b.src, d.dst FROM before b JOIN (SELECT DISTINCT src, dst FROM edges) e ON e.src = b.src JOIN drawn d ON d.sample_id = b.sample_id AND d.layer = b.layer AND d.dst = e.dst)",
    ]


LAYER_SQL = layer_sql(LAYERS, LAYER_SIZE, LAYER_SAMPLES)


def _layers(g):
    return apps.layer_matrices(g, LAYERS, LAYER_SIZE, LAYER_SAMPLES, SEED)


@_query(_sql("SELECT sample_id, layer, row, col, src, dst FROM coo", *LAYER_SQL))
def fastgcn_coo(g):
    return _layers(g)


@_query(_sql("SELECT sample_id, layer, row, col, src, dst FROM coo", *LAYER_SQL))
def ladies_coo(g):
    return apps.ladies(g, LAYERS, LAYER_SIZE, LAYER_SAMPLES, SEED)


# -------------------------------------------------------------------- validators

@_query(_sql(f"SELECT count(vertex) AS n_valid FROM ({_steps(WALK)})", *walk_sql(WALK)))
def walk_valid_count(g):
    return run(g, apps.uniform_walk(WALK), SEED).valid_count()


def _broken(samples):
    """Every vertex moved by one: a result that is wrong in a known way."""
    return samples.withColumn("vertex", F.col("vertex") + 1)


@_query(_sql(f"""SELECT DISTINCT s.sample_id, s.step, s.vertex + 1 AS vertex, 'not_neighbor' AS kind FROM s
LEFT JOIN (SELECT sample_id, step + 1 AS step, vertex + 1 AS src FROM s UNION SELECT CAST(id AS BIGINT), 0, id FROM vertices) l ON l.sample_id = s.sample_id AND l.step = s.step
WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.src = l.src AND e.dst = s.vertex + 1)""", *walk_sql(4), f"s AS ({_steps(4)})"))
def walk_violations(g):
    app = apps.uniform_walk(4)
    return validate.vertex_violations(_broken(run(g, app, SEED).samples), app.seeds(g), g).filter("kind = 'not_neighbor'")


@_query(_sql("SELECT sample_id, layer, row, col, 'missing' AS kind FROM (SELECT DISTINCT sample_id, layer, row, col FROM coo) WHERE (row + col) % 2 = 1", *LAYER_SQL))
def coo_violations(g):
    before, drawn = apps.layer_vertices(g, LAYERS, LAYER_SIZE, LAYER_SAMPLES, SEED)
    return validate.matrix_violations(_layers(g).filter("(row + col) % 2 = 0"), before, drawn, g)


@_query(_sql("SELECT sample_id, src, dst, 'missing' AS kind FROM cluster_edges WHERE (src + dst) % 3 = 0 AND src <> dst", CLUSTERS, CLUSTER_EDGES))
def subgraph_violations(g):
    return validate.subgraph_violations(apps.clustergcn(g).filter("(src + dst) % 3 != 0"), _members(g), g)


@_query(_sql("""SELECT DISTINCT a.sample_id, e.src, e.dst, 'missing' AS kind FROM batch a JOIN edges e ON e.src = a.transit
JOIN batch b ON b.sample_id = a.sample_id AND b.transit = e.dst WHERE (e.src + e.dst) % 3 = 0""", BATCH))
def batch_violations(g):
    return validate.batch_violations(apps.mvs(g).filter("(src + dst) % 3 != 0"), _batch(g), g)


def roots_replayed_sql(walked: str, roots: str) -> list[str]:
    """wrong(sample_id, step, vertex, kind) of many-root walks ``walked`` from ``roots`` (sample_id, i, v)."""
    return [
        f"moves AS MATERIALIZED ({walked})",
        f"held0 AS MATERIALIZED ({roots})",
        """events AS (SELECT sample_id, v, -1 AS step, count(*) AS change, CAST(NULL AS INTEGER) AS vertex, false AS used FROM held0 GROUP BY 1, 2
UNION ALL SELECT sample_id, vertex, step, 1, NULL, false FROM moves WHERE step > 0
UNION ALL SELECT sample_id, transit, step, CASE WHEN step > 0 THEN -1 ELSE 0 END, vertex, true FROM moves)""",
        "replayed AS (SELECT *, coalesce(sum(change) OVER (PARTITION BY sample_id, v ORDER BY step RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held FROM events)",
        "joined AS (SELECT DISTINCT src, dst FROM edges)",
        """wrong AS (SELECT s.sample_id, s.step, s.vertex, 'not_neighbor' AS kind FROM moves s ANTI JOIN joined e ON e.src = s.transit AND e.dst = s.vertex
UNION ALL SELECT sample_id, step, vertex, 'not_held' FROM replayed WHERE used AND (held < 1 OR step = 0 AND v <> (SELECT any_value(r.v) FROM held0 r WHERE r.i = 0 AND r.sample_id = replayed.sample_id))
UNION ALL SELECT r.sample_id, 0, NULL, 'empty_step' FROM held0 r JOIN deg ON deg.id = r.v ANTI JOIN (SELECT sample_id FROM moves WHERE step = 0) m ON m.sample_id = r.sample_id WHERE r.i = 0)""",
    ]


BROKEN = "SELECT sample_id, step, transit, vertex + 1 AS vertex FROM"


@_query(_sql("SELECT * FROM wrong", *multirw_sql(ROOT_STEPS, ROOTS), *roots_replayed_sql(f"{BROKEN} ({_steps(ROOT_STEPS)})", "SELECT sample_id, i, v FROM r0")))
def root_violations(g):
    return validate.root_violations(_broken(apps.multirw(g, ROOT_STEPS, g.n_vertices, ROOTS, SEED)), apps.root_table(g, g.n_vertices, ROOTS, SEED), g)


CHAINED = """rows AS (SELECT sample_id, step, transit, vertex FROM moved UNION ALL SELECT CAST(id AS BIGINT), -1, NULL, id FROM vertices),
seen AS (SELECT *, lag(vertex) OVER w AS held, lag(step) OVER w AS last, lead(step) OVER w AS next FROM rows WINDOW w AS (PARTITION BY sample_id ORDER BY step)),
wrong AS (SELECT s.sample_id, s.step, s.vertex, 'not_neighbor' AS kind FROM moved s ANTI JOIN near e ON e.src = s.transit AND e.dst = s.vertex
UNION ALL SELECT sample_id, step, vertex, 'not_held' FROM seen WHERE step >= 0 AND (held IS DISTINCT FROM transit OR last <> step - 1)
UNION ALL SELECT sample_id, step + 1, -1, 'empty_step' FROM seen JOIN deg ON id = vertex WHERE next IS NULL AND step < 3)"""


@_query(_sql("SELECT * FROM wrong", *node2vec_sql(4), "moved AS MATERIALIZED (SELECT sample_id, step - 1 AS step, t AS transit, vertex + CAST(sample_id % 2 AS INTEGER) AS vertex FROM w WHERE moved AND (sample_id % 3 > 0 OR step <> 2))", CHAINED))
def chain_violations(g):
    """Second-order walks of which half have every vertex moved by one, and a third lack a step."""
    found = apps.node2vec(g, 4, g.n_vertices, seed=SEED).filter("sample_id % 3 > 0 OR step != 1").withColumn("vertex", F.col("vertex") + (F.col("sample_id") % 2).cast("int"))
    return validate.chain_violations(found, one_seed_per_vertex()(g), g, 4).fillna(-1, "vertex")


@_query(_sql("SELECT CAST(id AS BIGINT) AS sample_id, 0 AS step, -1 AS vertex, 'empty_step' AS kind FROM vertices WHERE degree > 0"))
def empty_result_violations(g):
    """A result without any row is reported whole."""
    found = run(g, apps.uniform_walk(WALK), SEED).samples.filter("sample_id < 0")
    return apps.violations(g, "uniform", found, SEED).fillna(-1, "vertex")


@_query(_sql("""SELECT CAST(id AS BIGINT) AS sample_id, 0 AS step, -1 AS vertex, 'empty_step' AS kind FROM vertices WHERE degree > 0 AND id % 2 = 1"""))
def empty_step_violations(g):
    app = apps.uniform_walk(1)
    return validate.vertex_violations(run(g, app, SEED).samples.filter("sample_id % 2 = 0"), app.seeds(g), g).fillna(-1, "vertex")


@_query(_sql("""SELECT DISTINCT b.sample_id, e.src, CAST((e.dst + 1) % (SELECT n FROM n) AS INTEGER) AS dst, 'not_edge' AS kind FROM batch b JOIN edges e ON e.src = b.transit
WHERE NOT EXISTS (SELECT 1 FROM edges x WHERE x.src = e.src AND x.dst = (e.dst + 1) % (SELECT n FROM n))""", BATCH))
def not_edge_violations(g):
    moved = apps.mvs(g).withColumn("dst", F.pmod(F.col("dst") + 1, F.lit(g.n_vertices)))
    return validate.batch_violations(moved, _batch(g), g).filter("kind = 'not_edge'")


@_query(_sql("""SELECT c.sample_id, c.layer, c.row, c.col + 1000 AS col, 'not_edge' AS kind FROM coo c
UNION ALL SELECT sample_id, layer, row, col, 'missing' FROM (SELECT DISTINCT sample_id, layer, row, col FROM coo)""", *LAYER_SQL))
def not_edge_coo_violations(g):
    moved = _layers(g).withColumn("col", F.col("col") + 1000)
    return validate.matrix_violations(moved, *apps.layer_vertices(g, LAYERS, LAYER_SIZE, LAYER_SAMPLES, SEED), g)


# ---------------------------------------------------- sources, sinks and fetching

def _kept(g, name, write, read):
    """What is read from a folder that a writer has filled."""
    path = new_folder(g.spark, name)
    write(path)
    return read(path)


@_query(_sql("SELECT src, dst, weight FROM edges"))
def binary_edges_round_trip(g):
    """Ranges of 10,000 records, so that files are cut."""
    return _kept(g, "binary", lambda p: write_binary_edges(g, p), lambda p: read_binary_edges(g.spark, p, 10_000))


@_query(_sql("SELECT src, dst, weight FROM edges"))
def text_edges_round_trip(g):
    return _kept(g, "text", lambda p: write_text_edges(g, p), lambda p: read_graph(g.spark, p, "edge-list", "text").edges)


@_query(_sql("SELECT src, dst, weight FROM edges"))
def adjacency_round_trip(g):
    return _kept(g, "adjacency", lambda p: write_adjacency(g, p), lambda p: read_graph(g.spark, p, "adj-list", "text", relabel=False).edges)


@_query(_sql("SELECT src, dst, weight FROM edges"))
def csv_table_round_trip(g):
    return _kept(g, "csv", lambda p: g.edges.write.csv(p), lambda p: read_graph(g.spark, p, "table", "csv").edges)


@_query(_sql("SELECT src, dst, weight FROM edges"))
def orc_table_round_trip(g):
    return _kept(g, "orc", lambda p: g.edges.write.orc(p), lambda p: read_graph(g.spark, p, "table", "orc").edges)


@_query(_sql(f"SELECT sample_id, step, transit, vertex FROM ({_steps(4)})", *walk_sql(4)))
def samples_sink(g):
    found = _plain(run(g, apps.uniform_walk(4), SEED).samples)
    return _kept(g, "samples", lambda p: found.write.parquet(p), lambda p: g.spark.read.parquet(p))


@_query(_sql(f"""SELECT v.sample_id, CAST(k.range AS INTEGER) AS k, coalesce(s.vertex, (SELECT CAST(n AS INTEGER) FROM n)) AS vertex FROM (SELECT DISTINCT sample_id FROM s) v, range(0, 6) k
LEFT JOIN s ON s.sample_id = v.sample_id AND s.step = k.range""", *walk_sql(6, weighted=True, end=0.2), f"s AS ({_steps(6)})"))
def padded_samples(g):
    found = run(g, apps.ppr(6, g.n_vertices, end=0.2), SEED).dense()
    return found.select("sample_id", F.posexplode("vertices").alias("k", "vertex"))


@_query(_sql("SELECT sample_id, transit AS row, vertex AS col, count(*) AS n FROM (" + _steps(WALK) + ") GROUP BY ALL", *walk_sql(WALK)))
def walk_matrices(g):
    app = dataclasses.replace(apps.uniform_walk(WALK), output=OutputFormat.ADJACENCY_MATRIX)
    return run(g, app, SEED).output()


def collective_sql(size: int, steps: int) -> list[str]:
    out = ["f0 AS (SELECT sample_id, CAST(slot AS BIGINT) AS slot, transit AS vertex FROM batch)"]
    for k in range(steps):
        out.append(f"r{k} AS (SELECT f.sample_id, f.slot, f.vertex AS transit, sum(d.degree) OVER (PARTITION BY f.sample_id ORDER BY f.slot ROWS UNBOUNDED PRECEDING) AS hi, d.degree FROM f{k} f JOIN deg d ON d.id = f.vertex)")
        out.append(f"t{k} AS (SELECT sample_id, max(hi) AS edges FROM r{k} GROUP BY 1)")
        out.append(f"d{k} AS (SELECT t.sample_id, j.range AS slot, {rng.sql_pick(rng.sql_uniform(SEED, 't.sample_id', k, 'j.range', 0), 't.edges')} AS at FROM t{k} t, range(0, {size}) j)")
        out.append(f"f{k + 1} AS MATERIALIZED (SELECT d.sample_id, d.slot, r.slot AS parent_slot, r.transit, p.dst AS vertex FROM d{k} d JOIN r{k} r ON r.sample_id = d.sample_id AND d.at >= r.hi - r.degree AND d.at < r.hi JOIN pos p ON p.src = r.transit AND p.pos = d.at - (r.hi - r.degree))")
    return out


@_query(_sql(" UNION ALL ".join(f"SELECT sample_id, {k} AS step, slot, parent_slot, transit, vertex FROM f{k + 1}" for k in range(2)), BATCH, *collective_sql(8, 2)))
def collective_app(g):
    app = SamplingApp("collective", 2, 8, batch_seeds(passes(g.n_vertices), 32), sampling_type=SamplingType.COLLECTIVE, initial_size=32)
    return run(g, app, SEED).samples


SIZES = [("uniform", 1, [1] * 100), ("khop", 1, [25, 10]), ("layer", 1, [10, 25])]


@_query(" UNION ALL ".join(f"SELECT '{name}' AS app, {k} AS step, {math.prod(sizes[:k])} AS transits, {math.prod(sizes[: k + 1])} AS outputs, {sum(math.prod(sizes[: i + 1]) for i in range(len(sizes)))} AS final_size" for name, _, sizes in SIZES for k in range(len(sizes))))
def step_sizes(g):
    made = {name: apps.APPS[name]() for name, *_ in SIZES}
    rows = [(name, k, a.transits_at(k), a.outputs_until(k), a.final_size()) for name, a in made.items() for k in range(a.steps)]
    return g.spark.createDataFrame(rows, "app string, step int, transits int, outputs int, final_size int")


@_query(_sql("SELECT v AS vertex, v BETWEEN 0 AND (SELECT n FROM n) - 1 AS has_vertex FROM (SELECT id * 2 - 50 AS v FROM vertices)"))
def has_vertex_probe(g):
    return g.vertices.select((F.col("id") * 2 - 50).alias("vertex")).withColumn("has_vertex", g.has_vertex("vertex"))


@_query(_sql("SELECT id, degree, row_number() OVER (ORDER BY degree, id) - 1 AS place FROM vertices"))
def vertices_by_degree(g):
    return numbered(g.vertices.select("id", "degree"), "place", "degree", "id")


@_query(_sql("SELECT v.id, count(*) FILTER (WHERE e.dst = CAST((v.id * 7 + 3) % (SELECT n FROM n) AS INTEGER)) > 0 AS found, CAST(count(DISTINCT e.dst) FILTER (WHERE e.dst < CAST((v.id * 7 + 3) % (SELECT n FROM n) AS INTEGER)) AS INTEGER) AS before, sum(e.dst + 0.0) AS total FROM vertices v JOIN edges e ON e.src = v.id GROUP BY v.id"))
def array_search(g):
    probe = F.pmod(F.col("vertex").cast("long") * 7 + 3, F.lit(g.n_vertices)).cast("int")
    lists = edges_to_adjacency(g.edges).withColumn("probe", probe)
    before = F.coalesce(arrays.place("nbrs", F.col("probe")), F.size(F.filter("nbrs", lambda x: x < F.col("probe"))))
    total = F.element_at(arrays.prefix_sums(F.transform("nbrs", lambda x: x.cast("double"))), -1)
    return lists.select(F.col("vertex").alias("id"), arrays.contains("nbrs", F.col("probe")).alias("found"), before.alias("before"), total.alias("total"))


@_query(_sql("SELECT id, CAST(CASE WHEN degree <= 1 THEN 1 ELSE pow(2, ceil(log2(degree))) END AS BIGINT) AS width, CAST(ceil(degree / 32.0) * 32 AS BIGINT) AS rounded FROM vertices"))
def sub_warp_widths(g):
    return g.vertices.select("id", arrays.next_power_of_two(F.col("degree")).alias("width"), arrays.round_up(F.col("degree"), F.lit(32)).alias("rounded"))


@_query(_sql("SELECT sample_id, layer, col, dst FROM drawn", *LAYER_SQL))
def layer_vertices_drawn(g):
    """All drawn vertices, those without an entry in a matrix too."""
    return apps.layer_vertices(g, LAYERS, LAYER_SIZE, LAYER_SAMPLES, SEED)[1]


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["uniform_walk"](spark, sf_dir)
