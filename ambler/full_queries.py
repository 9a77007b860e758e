"""The samplers as queries over the purchase graph with their own defaults: 100 steps,
100 walks from each vertex, 100 roots, 5 layers of 64 drawn ids for 10,000 samples.

The queries of ``queries`` with the same names but for ``_full`` have fewer steps and
samples. Results of tens of millions of rows are returned as digests: a row for each
sample (and layer) with its number of rows and the sum of a hash of all their columns. All
have a SQL twin for DuckDB; all samplers are tested against plain Python on small graphs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import validate
from .plans import apps
from .plans.engine import run
from .functions import rng
from .queries import BROKEN, SEED, _broken, _plain, _sql, layer_sql, node2vec_sql, roots_replayed_sql
from .sources.graphs import purchase_graph


def uniform_walk(g):
    return _plain(run(g, apps.uniform_walk(), SEED).samples)


def deepwalk(g):
    return _plain(run(g, apps.deepwalk(), SEED).samples)


def ppr_walk(g):
    return _plain(run(g, apps.ppr(), SEED).samples)


def node2vec_walk(g):
    return _plain(apps.node2vec(g, seed=SEED))


def multirw_walk(g):
    return _plain(apps.multirw(g, seed=SEED))


def fastgcn_coo(g):
    return apps.fastgcn(g, seed=SEED)


def ladies_coo(g):
    return apps.ladies(g, seed=SEED)


def coo_violations(g):
    return apps.layer_violations(g, apps.fastgcn(g, seed=SEED).filter("(row + col) % 2 = 0"), seed=SEED)


def root_violations(g):
    return validate.root_violations(_broken(apps.multirw(g, seed=SEED)), apps.root_table(g, g.n_vertices, apps.ROOTS, SEED), g)


def layer_vertices_drawn(g):
    return apps.layer_vertices(g, seed=SEED)[1]


def not_edge_coo_violations(g):
    moved = apps.fastgcn(g, seed=SEED).withColumn("col", F.col("col") + 1000)
    return apps.layer_violations(g, moved, seed=SEED)


#: Name to sampler of a graph.
SAMPLERS: dict[str, Callable] = {
    f"{f.__name__}_full": f
    for f in (uniform_walk, deepwalk, ppr_walk, node2vec_walk, multirw_walk, fastgcn_coo, ladies_coo, coo_violations, root_violations, layer_vertices_drawn, not_edge_coo_violations)
}


#: What a digest is hashed with, and the columns whose values it takes, by the columns of a result.
SALT = 7
HASHED = {"vertex": ("step", "transit", "vertex"), "src": ("row", "col", "src", "dst"), "kind": ("row", "col", "length(kind)"), "dst": ("col", "dst")}


def _hashed(columns) -> tuple[str, ...]:
    return next(of for name, of in HASHED.items() if name in columns)


def digest(found: DataFrame) -> DataFrame:
    """(sample_id, layer if there is one, n, digest): rows, and the sum of hashes of their columns."""
    own = [c for c in ("sample_id", "layer") if c in found.columns]
    return found.groupBy(*own).agg(F.count("*").alias("n"), F.sum(rng.draw(SALT, *_hashed(found.columns))).alias("digest"))


def _digest_sql(table: str, layered: bool, columns: str, where: str = "") -> str:
    own = "sample_id, layer" if layered else "sample_id"
    return f"SELECT {own}, count(*) AS n, CAST(sum({rng.sql_draw(SALT, *HASHED[columns])}) AS BIGINT) AS digest FROM {table} {where} GROUP BY ALL"


#: Queries whose result is too large as it is.
DIGESTS = {f"{n}_full" for n in ("deepwalk", "ppr_walk", "node2vec_walk", "fastgcn_coo", "ladies_coo", "coo_violations", "layer_vertices_drawn", "not_edge_coo_violations")}

#: Cells of equal weight of each vertex, with the edges they touch.
CELLS = """span AS (SELECT c.src, c.dst, c.hi - c.weight AS lo, c.hi, d.degree, d.total FROM cum c JOIN deg d ON d.id = c.src),
cells AS MATERIALIZED (SELECT src, unnest(range(CAST(least(floor(lo * degree / total), degree - 1) AS BIGINT), CAST(least(floor(hi * degree / total), degree - 1) AS BIGINT) + 1)) AS cell, lo, hi, dst FROM span)"""


def _weighted(end: float | None = None) -> list[str]:
    stop = f" AND NOT ({rng.sql_uniform(SEED, 'w.sample_id', 'w.step', 0, 1)} < {end})" if end is not None else ""
    return [
        CELLS,
        f"""w AS (SELECT s.range AS sample_id, 0 AS step, CAST(NULL AS INTEGER) AS transit, CAST(s.range % (SELECT n FROM n) AS INTEGER) AS vertex FROM range(0, 100 * (SELECT n FROM n)) s
UNION ALL SELECT o.sample_id, o.step + 1, o.vertex, c.dst FROM (SELECT w.*, d.degree, d.total, {rng.sql_uniform(SEED, "w.sample_id", "w.step", 0, 0)} * d.total AS x FROM w JOIN deg d ON d.id = w.vertex WHERE w.step < {apps.STEPS}{stop}) o
JOIN cells c ON c.src = o.vertex AND c.cell = CAST(least(floor(o.x * o.degree / o.total), o.degree - 1) AS BIGINT) AND o.x > c.lo AND o.x <= c.hi)""",
    ]


UNIFORM = f"""w AS (SELECT CAST(id AS BIGINT) AS sample_id, 0 AS step, CAST(NULL AS INTEGER) AS transit, id AS vertex FROM vertices
UNION ALL SELECT w.sample_id, w.step + 1, w.vertex, p.dst FROM w JOIN deg d ON d.id = w.vertex JOIN pos p ON p.src = w.vertex AND p.pos = {rng.sql_pick(rng.sql_uniform(SEED, "w.sample_id", "w.step", 0, 0), "d.degree")} WHERE w.step < {apps.STEPS})"""
ROOTS = apps.ROOTS
MANY_ROOTS = [
    f"""given AS MATERIALIZED (SELECT sample_id, list(v ORDER BY i) AS roots FROM (SELECT s.range AS sample_id, i.range AS i, CAST({rng.sql_draw(SEED, "s.range", -1, "i.range", 0)} % (SELECT n FROM n) AS INTEGER) AS v FROM range(0, (SELECT n FROM n)) s, range(0, {ROOTS}) i) GROUP BY 1)""",
    f"""w AS (SELECT sample_id, 0 AS step, roots, CAST(NULL AS INTEGER) AS transit, CAST(NULL AS INTEGER) AS vertex FROM given
UNION ALL SELECT o.sample_id, o.step + 1, CASE WHEN o.step = 0 OR p.dst IS NULL THEN o.roots ELSE list_concat(o.roots[1 : o.x], [p.dst], o.roots[o.x + 2 : {ROOTS}]) END, o.v, p.dst
FROM (SELECT *, roots[x + 1] AS v FROM (SELECT *, CASE WHEN step = 0 THEN 0 ELSE {rng.sql_pick(rng.sql_uniform(SEED, "w.sample_id", "w.step", 0, 1), str(ROOTS))} END AS x FROM w WHERE step < {apps.STEPS})) o
LEFT JOIN deg d ON d.id = o.v LEFT JOIN pos p ON p.src = o.v AND p.pos = {rng.sql_pick(rng.sql_uniform(SEED, "o.sample_id", "o.step", 0, 0), "d.degree")})""",
]
WALKED = "SELECT sample_id, step - 1 AS step, transit, vertex FROM w WHERE step > 0 AND vertex IS NOT NULL"
STEPPED = "(SELECT sample_id, step - 1 AS step, transit, vertex FROM w WHERE step > 0)"
LAYERS = layer_sql(apps.LAYERS, apps.LAYER_SIZE, apps.LAYER_SAMPLES)
COO = "(SELECT DISTINCT sample_id, layer, row, col, 'missing' AS kind FROM coo)"
SQL = {
    "uniform_walk_full": _sql(WALKED, UNIFORM),
    "deepwalk_full": _sql(_digest_sql(STEPPED, False, "vertex"), *_weighted()),
    "ppr_walk_full": _sql(_digest_sql(STEPPED, False, "vertex"), *_weighted(0.01)),
    "node2vec_walk_full": _sql(_digest_sql("(SELECT sample_id, step - 1 AS step, t AS transit, vertex FROM w WHERE moved)", False, "vertex"), *node2vec_sql(apps.STEPS, per_vertex=100)),
    "multirw_walk_full": _sql(WALKED, *MANY_ROOTS),
    "fastgcn_coo_full": _sql(_digest_sql("coo", True, "src"), *LAYERS),
    "ladies_coo_full": _sql(_digest_sql("coo", True, "src"), *LAYERS),
    "coo_violations_full": _sql(_digest_sql(COO, True, "kind", "WHERE (row + col) % 2 = 1"), *LAYERS),
    "layer_vertices_drawn_full": _sql(_digest_sql("drawn", True, "dst"), *LAYERS),
    "not_edge_coo_violations_full": _sql(_digest_sql(f"(SELECT sample_id, layer, row, col + 1000 AS col, 'not_edge' AS kind FROM coo UNION ALL SELECT * FROM {COO})", True, "kind"), *LAYERS),
    "root_violations_full": _sql("SELECT * FROM wrong", *MANY_ROOTS, *roots_replayed_sql(f"{BROKEN} ({WALKED})", "SELECT sample_id, unnest(roots) AS v, unnest(range(0, 100)) AS i FROM given")),
}


def _on_purchases(f: Callable, short: bool) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: (digest if short else lambda found: found)(f(purchase_graph(spark, sf_dir)))


def queries() -> dict:
    return {name: _on_purchases(f, name in DIGESTS) for name, f in SAMPLERS.items()}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
