"""The samplers at their own defaults, on small graphs, against plain Python."""

import collections
import itertools

import duckdb
import pandas
import pytest

import __spark_entry__ as entry
from ambler import full_queries
from ambler.functions import rng
from ambler.operators.graph import EDGE_SCHEMA, Graph

#: Four vertices, one pair twice, unequal weights, a dead end (3) and a vertex of one edge (2);
#: and two that walks never leave.
EDGES = [(0, 1, 1.0), (0, 1, 2.5), (0, 2, 1.25), (1, 0, 3.0), (1, 2, 1.0), (2, 0, 1.0), (1, 3, 0.25), (4, 5, 1.0), (4, 4, 0.5), (5, 4, 2.0), (5, 4, 1.0)]
N, STEPS = 6, 100
SLICE = {v: sorted((d, w) for s, d, w in EDGES if s == v) for v in range(N)}


@pytest.fixture(scope="module")
def graph(spark):
    return Graph(spark.createDataFrame(EDGES, EDGE_SCHEMA), N)


def draw(*of):
    """The draw as the module describes it, on plain integers."""
    low, lanes = 2**32 - 1, []
    turn = lambda x, by: (z := (x * by & low) ^ rng.MASK) + (z >> 16) & low
    for upper, begin, counters, last in zip(rng.UPPER, rng.BEGIN, rng.COUNTERS, rng.LAST, strict=True):
        h = turn(turn(42 ^ begin, counters[0]), counters[1])
        for c, by in zip(of, counters, strict=False):
            h = turn(h ^ (c + (c >> 32) * upper & low), by)
        for by in last:
            h = turn(h, by)
        lanes.append(h)
    return lanes[0] ^ lanes[1]


def u(*of):
    return (draw(*of) + 1) / 2**32


def first_at_least(weights, x):
    total = 0.0
    for k, w in enumerate(weights):
        total += w
        if x <= total:
            return k


def place(sample, step, n):
    return min(int(u(sample, step, 0, 0) * n), n - 1)


def uniform(samples):
    for s in range(samples):
        v = s % N
        for k in range(STEPS):
            if not SLICE[v]:
                break
            d = SLICE[v][place(s, k, len(SLICE[v]))][0]
            yield s, k, v, d
            v = d


def weighted(samples, end=0.0):
    for s in range(samples):
        v = s % N
        for k in range(STEPS):
            if not SLICE[v] or u(s, k, 0, 1) < end:
                break
            w = [x for _, x in SLICE[v]]
            d = SLICE[v][first_at_least(w, u(s, k, 0, 0) * sum(w))][0]
            yield s, k, v, d
            v = d


def second_order(samples, p=2.0, q=0.5):
    pairs = {(s, d) for s, d, _ in EDGES}
    for s in range(samples):
        v, t = s % N, None
        for k in range(STEPS):
            if not SLICE[v]:
                break
            if k == 0 or len(SLICE[v]) == 1:
                d = SLICE[v][0][0]
            else:
                for r in itertools.count():
                    d = SLICE[v][min(int(u(s, k, 0, 2 * r) * len(SLICE[v])), len(SLICE[v]) - 1)][0]
                    if u(s, k, 0, 2 * r + 1) * max(p, 1 / q) <= (p if d == t else 1 / q if (t, d) in pairs else 1.0):
                        break
            yield s, k, v, d
            v, t = d, v


def many_roots(samples, n_roots=100):
    for s in range(samples):
        roots = [draw(s, -1, i, 0) % N for i in range(n_roots)]
        for k in range(STEPS):
            x = 0 if k == 0 else min(int(u(s, k, 0, 1) * n_roots), n_roots - 1)
            v = roots[x]
            if SLICE[v]:
                d = SLICE[v][place(s, k, len(SLICE[v]))][0]
                yield s, k, v, d
                roots[x] = d if k else v


WANT = {
    "uniform_walk_full": lambda: uniform(N),
    "deepwalk_full": lambda: weighted(100 * N),
    "ppr_walk_full": lambda: weighted(100 * N, 0.01),
    "node2vec_walk_full": lambda: second_order(100 * N),
    "multirw_walk_full": lambda: many_roots(N),
}


@pytest.mark.parametrize("name", sorted(WANT))
def test_walks_at_their_defaults(graph, name):
    want = sorted(WANT[name]())
    assert max(k for _, k, *_ in want) >= 0.9 * STEPS
    assert sorted(map(tuple, full_queries.SAMPLERS[name](graph).collect())) == want


@pytest.mark.parametrize("name", ["fastgcn_coo_full", "ladies_coo_full"])
def test_layers_at_their_defaults(spark, name):
    n = 700
    edges = [(v, (v * k + k) % n, 1.0) for v in range(n) for k in (1, 2, 3, 7)]
    near = collections.defaultdict(set)
    for s, d, _ in edges:
        near[s].add(d)
    want = []
    for s in range(10_000):
        rows = [(s * 64 + i) % n for i in range(64)]
        for layer in range(5):
            cols = [min(int(u(s, layer, c, 0) * n), n - 1) for c in range(64)]
            at = collections.defaultdict(list)
            for c, d in enumerate(cols):
                at[d].append(c)
            want += [(s, layer, r, c, v, d) for r, v in enumerate(rows) for d in near[v] & at.keys() for c in at[d]]
            rows = cols
    got = full_queries.SAMPLERS[name](Graph(spark.createDataFrame(edges, EDGE_SCHEMA), n)).toPandas()
    assert sorted(got.itertuples(index=False, name=None)) == sorted(want)
    assert {v for _, layer, _, _, v, _ in want if layer == 0} == set(range(n))


def test_every_full_query_has_sql_and_digests_see_all_columns(spark):
    assert set(full_queries.queries()) == set(full_queries.oracle_sql())
    walk = "sample_id long, step int, transit int, vertex int"
    make = lambda *steps: full_queries.digest(spark.createDataFrame([(0, k, t, v) for k, (t, v) in enumerate(steps)], walk)).first().digest
    assert len({make((1, 5), (5, 5)), make((1, 7), (7, 4)), make((1, 7), (5, 4)), make((1, 5), (4, 5)), make((5, 5), (1, 5))}) == 5


@pytest.mark.parametrize("name", sorted(full_queries.oracle_sql()))
def test_full_query_equals_its_sql(spark, name):
    duck = duckdb.connect()
    duck.execute("CREATE VIEW lineitem AS SELECT * FROM read_parquet('/root/testdata/sf0.001/lineitem.parquet')")
    a = full_queries.queries()[name](spark, "/root/testdata/sf0.001").toArrow()
    b = duck.execute(full_queries.oracle_sql()[name]).to_arrow_table()
    columns = sorted(a.column_names)
    assert columns == sorted(b.column_names) and a.num_rows == b.num_rows
    same = lambda t: t.select(columns).to_pandas().sort_values(columns).reset_index(drop=True)
    pandas.testing.assert_frame_equal(same(a), same(b), check_dtype=False)


def test_every_sampler_is_registered_at_its_defaults():
    assert set(full_queries.queries()) <= set(entry.queries())
    assert {f"{x}_full" for x in "fastgcn_coo ladies_coo coo_violations deepwalk ppr_walk multirw_walk root_violations node2vec_walk uniform_walk".split()} <= set(entry.queries())
