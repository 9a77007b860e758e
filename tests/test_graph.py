import numpy as np
import pytest
from pyspark.sql import functions as F

from ambler.functions import arrays, rng
from ambler.operators import frontier as fr
from ambler.operators import graph as gr
from ambler.operators import validate
from ambler.operators.graph import EDGE_SCHEMA, Graph
from ambler.operators.scan import exclusive_scan
from ambler.plans import apps
from ambler.plans.app import ALL_NEIGHBORS, SEEDS, SamplingApp, SamplingType, batch_seeds, batches, one_seed_per_vertex
from ambler.plans.engine import run

CHAIN = [(0, 1, 1.0), (1, 2, 1.0), (2, 3, 1.0)]
STAR = [(0, i, 1.0) for i in range(1, 5)] + [(i, 0, 1.0) for i in range(1, 5)]
WEIGHTED = [(0, 1, 1.0), (0, 2, 3.0), (1, 0, 1.0), (2, 0, 1.0)]
MULTI = [(0, 1, 1.0), (0, 1, 2.0), (0, 2, 1.0), (1, 0, 1.0), (2, 0, 1.0)]
LOOP = [(0, 0, 1.0), (0, 1, 1.0), (1, 0, 1.0)]
RING = [(i, (i + 1) % 32, 1.0) for i in range(32)]
ZERO = [(0, 1, 0.0), (0, 2, 0.0), (1, 0, 1.0), (2, 0, 1.0)]


@pytest.fixture
def graph(spark):
    return lambda edges, n=None: Graph(spark.createDataFrame(edges, EDGE_SCHEMA), n)


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_csr_of_a_chain_and_of_isolated_vertices(graph):
    assert rows(graph(CHAIN).csr(), "id", "start_edge", "end_edge", "degree") == [(0, 0, 0, 1), (1, 1, 1, 1), (2, 2, 2, 1), (3, 3, -1, 0)]
    g = graph([(0, 1, 1.0), (1, 0, 1.0)], 4)
    assert rows(g.csr(), "id", "end_edge") == [(0, 0), (1, 1), (2, -1), (3, -1)]
    assert g.n_vertices == 4 and g.n_edges == 2


def test_parallel_edges_and_loops_stay(graph):
    assert rows(graph(MULTI).positions.filter("src = 0"), "pos", "dst", "weight") == [(0, 1, 1.0), (1, 1, 2.0), (2, 2, 1.0)]
    assert graph(MULTI).without_parallel().n_edges == 5
    assert rows(graph(LOOP).pairs, "src", "dst") == [(0, 0), (0, 1), (1, 0)]


def test_empty_graph(graph):
    g = graph([])
    assert g.n_vertices == 0 and g.csr().count() == 0
    assert run(g, apps.uniform_walk(3)).samples.count() == 0


def test_edge_offsets_name_their_source(graph):
    assert rows(graph(STAR).edge_vertices(), "edge", "src") == [(0, 0), (1, 0), (2, 0), (3, 0), (4, 1), (5, 2), (6, 3), (7, 4)]


def test_has_edge_and_vertex(spark, graph):
    g = graph(MULTI)
    probes = spark.createDataFrame([(0, 1), (0, 0), (9, 1)], "src int, dst int")
    assert rows(g.has_edge(probes), "src", "dst", "has_edge") == [(0, 0, False), (0, 1, True), (9, 1, False)]
    ids = spark.createDataFrame([(0,), (3,), (None,)], "v int")
    assert [r[0] for r in ids.select(g.has_vertex("v")).collect()] == [True, False, False]


def test_exclusive_scan_over_many_blocks(spark):
    df = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") % 7).alias("v"))
    got = dict(exclusive_scan(df, "k", "v", "before", block=64).select("k", "before").collect())
    assert got == {k: sum(i % 7 for i in range(k)) for k in range(1000)}


@pytest.mark.parametrize("budget", [48, 49, 100, 257, 10_000])
def test_parts_hold_their_budget(graph, budget):
    """Every edge once, hubs cut, no part above its budget, and none left half empty but by a cut."""
    edges = RING + [(7, k % 32, float(k)) for k in range(60)] + [(40, 0, 1.0)]
    g = graph(edges)
    parts = rows(gr.partition_by_bytes(g, budget), "part", "id", "first", "last")
    size, seen = {}, []
    for part, v, first, last in parts:
        size[part] = size.get(part, 0) + 16 + 8 * (last - first + 1)
        seen += [(v, p) for p in range(first, last + 1)]
    assert max(size.values()) <= budget
    assert sorted(seen) == rows(g.positions, "src", "pos") and {v for _, v, *_ in parts} == set(range(41))
    assert all(size[p] > budget - 16 - 2 * 8 - 16 for p in list(size)[:-1])
    with pytest.raises(ValueError):
        gr.partition_by_bytes(g, 47)


def test_bfs(graph):
    assert rows(gr.bfs(graph(CHAIN), [0]), "id", "depth") == [(0, 0), (1, 1), (2, 2), (3, 3)]


def test_array_functions(spark):
    df = spark.createDataFrame([([1.0, 2.0, 0.5], 5)], "a array<double>, n int")
    got = df.select(arrays.prefix_sums("a").alias("p"), arrays.contains("a", 2.0), arrays.place("a", 0.5), arrays.place("a", 9.0), arrays.next_power_of_two(F.col("n")), arrays.round_up(F.col("n"), F.lit(4))).first()
    assert list(got) == [[1.0, 3.0, 3.5], True, 2, None, 8, 8]


def test_draws_do_not_depend_on_partitions(spark):
    df = spark.range(200).withColumn("u", rng.uniform(1, "id", 0))
    a, b = dict(df.collect()), dict(df.repartition(7).collect())
    assert a == b and all(0 < u <= 1 for u in a.values()) and len(set(a.values())) > 190


def test_sizes():
    app = apps.khop()
    assert (app.outputs_until(0), app.outputs_until(1), app.transits_at(1), app.final_size()) == (25, 250, 25, 275)
    assert apps.layer().final_size() == 260 and apps.uniform_walk().final_size() == 100
    both = SamplingApp("c", 5, 64, sampling_type=SamplingType.COLLECTIVE, initial_size=64)
    assert both.final_size() == 320 and both.outputs_until(1) == 128
    assert batches(1000, 10) == 250 and batches(10, 10**8 + 1) == 800_000 and apps.walk_count(10) == 1000 and apps.walk_count(300_000) == 300_000


def test_walk_ends_at_a_dead_end(graph):
    assert rows(run(graph(CHAIN), apps.uniform_walk(5)).samples, "sample_id", "step", "vertex") == [(0, 0, 1), (0, 1, 2), (0, 2, 3), (1, 0, 2), (1, 1, 3), (2, 0, 3)]


def test_dense_pads_what_ended(graph):
    got = dict(run(graph(CHAIN), apps.uniform_walk(3)).dense().collect())
    assert got == {0: [1, 2, 3], 1: [2, 3, 4], 2: [3, 4, 4]}


@pytest.mark.parametrize("strategy", ["sample", "transit"])
def test_strategies_and_partitions_agree(spark, graph, strategy):
    want = rows(run(graph(STAR + WEIGHTED), apps.deepwalk(8, 40)).samples, "sample_id", "step", "vertex")
    for parts in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            assert rows(run(graph(STAR + WEIGHTED), apps.deepwalk(8, 40), strategy=strategy, checkpoint_every=3).samples, "sample_id", "step", "vertex") == want
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
    with pytest.raises(ValueError):
        run(graph(STAR), apps.uniform_walk(1), strategy="other")


@pytest.mark.parametrize("app", [apps.uniform_walk(7), apps.deepwalk(6, 30), apps.ppr(6, 60, end=0.2), apps.khop((3, 2)), apps.layer((2, 4))], ids=lambda a: a.name)
@pytest.mark.parametrize("edges", [STAR + WEIGHTED, MULTI, CHAIN, ZERO, LOOP], ids=["star", "multi", "chain", "zero", "loop"])
def test_tasks_draw_what_joins_draw(graph, app, edges):
    columns = ("sample_id", "step", "slot", "parent_slot", "transit", "vertex")
    a, b = run(graph(edges), app, strategy="sample").samples, run(graph(edges), app, strategy="transit").samples
    assert a.dtypes == b.select(*a.columns).dtypes
    assert rows(a, *columns) == rows(b, *columns)


def chi2(found, chances):
    n = sum(found.values())
    return sum((found.get(k, 0) - n * p) ** 2 / (n * p) for k, p in chances.items())


def test_weighted_choice_has_the_weights_distribution(graph):
    g = graph([(0, i, float(i)) for i in range(1, 9)])
    app = SamplingApp("w", 1, 1, lambda g: g.spark.range(8000).select(F.col("id").alias("sample_id"), F.lit(0).alias("slot"), F.lit(0).alias("transit")), weighted=True)
    got = dict(run(g, app).samples.groupBy("vertex").count().collect())
    assert chi2(got, {i: i / 36 for i in range(1, 9)}) < 24.3  # 0.1 % with 7 degrees of freedom


def test_uniform_choice_and_parallel_edges(graph):
    app = SamplingApp("u", 1, 1, lambda g: g.spark.range(6000).select(F.col("id").alias("sample_id"), F.lit(0).alias("slot"), F.lit(0).alias("transit")))
    got = dict(run(graph(MULTI), app).samples.groupBy("vertex").count().collect())
    assert chi2(got, {1: 2 / 3, 2: 1 / 3}) < 10.9


def test_zero_weights_fall_back_to_uniform(graph):
    app = SamplingApp("z", 1, 1, lambda g: g.spark.range(4000).select(F.col("id").alias("sample_id"), F.lit(0).alias("slot"), F.lit(0).alias("transit")), weighted=True)
    got = dict(run(graph(ZERO), app).samples.groupBy("vertex").count().collect())
    assert chi2(got, {1: 0.5, 2: 0.5}) < 10.9


def test_ppr_ends_with_its_chance(graph):
    n = run(graph(RING), apps.ppr(1, 20_000, end=0.25)).samples.count()
    assert abs(n - 15_000) < 300


def test_custom_choice_and_stop(graph):
    app = SamplingApp("last", 2, 1, one_seed_per_vertex(), next=lambda c: c.degree - 1, stop=lambda c: c.transit == 3)
    assert rows(run(graph(STAR), app).samples, "sample_id", "step", "vertex") == [(0, 0, 4), (0, 1, 0), (1, 0, 0), (1, 1, 4), (2, 0, 0), (2, 1, 4), (4, 0, 0), (4, 1, 4)]


def test_walk_with_state(graph):
    """A walk that goes back to its seed after every choice, and counts its choices."""
    seeds = lambda g: one_seed_per_vertex()(g).withColumn("home", F.col("transit")).withColumn("n", F.lit(0))
    app = SamplingApp("home", 3, 1, seeds, update=lambda c: {"n": c.state["n"] + 1}, transits=lambda c: F.when(c.state["n"] < 2, c.state["home"]))
    found = run(graph(RING), app).samples
    assert rows(found, "sample_id", "step", "transit", "vertex") == [(s, k, s, (s + 1) % 32) for s in range(32) for k in range(2)]
    with pytest.raises(ValueError):
        run(graph(RING), SamplingApp("x", 1, 2, seeds, transits=lambda c: c.transit))


def test_run_reports_its_violations(graph):
    assert run(graph(STAR), apps.khop((2, 2))).violations().count() == 0


def test_khop_slots_and_validity(graph):
    g = graph(STAR)
    app = apps.khop((3, 2))
    found = run(g, app).samples
    assert found.count() == 5 * (3 + 6)
    assert found.filter("step = 1 AND parent_slot != floor(slot / 2)").count() == 0
    assert validate.vertex_violations(found, app.seeds(g), g).count() == 0
    wrong = found.withColumn("vertex", F.when(F.col("sample_id") == 1, F.lit(2)).otherwise(F.col("vertex")))
    assert validate.vertex_violations(wrong, app.seeds(g), g).count() > 0


def test_all_neighbors(graph):
    app = SamplingApp("all", 2, [ALL_NEIGHBORS, ALL_NEIGHBORS], one_seed_per_vertex())
    assert rows(run(graph(CHAIN), app).samples, "sample_id", "step", "vertex") == [(0, 0, 1), (0, 1, 2), (1, 0, 2), (1, 1, 3), (2, 0, 3)]


def test_node2vec_first_steps(graph):
    found = apps.node2vec(graph(STAR), 3, 5)
    first = rows(found.filter("step = 0"), "sample_id", "vertex")
    assert first == [(0, 1), (1, 0), (2, 0), (3, 0), (4, 0)]
    assert validate.chain_violations(found, one_seed_per_vertex(5)(graph(STAR)), graph(STAR), 3).count() == 0


def test_node2vec_distribution(graph):
    # from 1 to 0 (one edge), then from 0: back to 1 weighs 2, to 2 (edge 1 -> 2) 1/q = 2, to 3 and 4 1
    g = graph([(1, 0, 1.0), (0, 1, 1.0), (0, 2, 1.0), (0, 3, 1.0), (0, 4, 1.0), (1, 2, 1.0)])
    found = apps.node2vec(g, 2, 25_000).filter("step = 1 AND transit = 0 AND sample_id % 5 = 1")
    got = dict(found.groupBy("vertex").count().collect())
    assert chi2(got, {1: 2 / 6, 2: 2 / 6, 3: 1 / 6, 4: 1 / 6}) < 16.3


def test_multirw_moves_roots(graph):
    g = graph(RING)
    found = apps.multirw(g, 6, 10, roots=3)
    assert found.count() == 60 and validate.root_violations(found, apps.root_table(g, 10, 3, 42), g).count() == 0
    held = np.zeros((10, 3), int)
    for s, i, v in g.spark.range(10).select("id", F.explode(F.array(*map(F.lit, range(3)))).alias("i")).select("id", "i", (rng.draw(42, "id", -1, "i", 0) % 32)).collect():
        held[s, i] = v
    for s, step, transit, vertex in sorted(tuple(r) for r in found.select("sample_id", "step", "transit", "vertex").collect()):
        assert transit in held[s] and vertex == (transit + 1) % 32
        if step == 0:
            assert transit == held[s, 0]
        else:
            held[s, list(held[s]).index(transit)] = vertex


def test_layer_matrix_is_sound_and_complete(graph):
    g = graph(STAR)
    found = apps.layer_matrices(g, 2, 4, 6)
    n, pairs = g.n_vertices, set(map(tuple, g.pairs.collect()))
    drawn = {(s, layer, c): v for s, layer, c, v in g.spark.range(6).select("id", F.explode(F.array(F.lit(0), F.lit(1))).alias("l")).select("id", "l", F.explode(F.array(*map(F.lit, range(4)))).alias("c")).select("id", "l", "c", rng.pick(rng.uniform(42, "id", "l", "c", 0), n)).collect()}
    before = lambda s, layer, r: (s * 4 + r) % n if layer == 0 else drawn[s, layer - 1, r]
    want = {(s, layer, r, c) for s in range(6) for layer in range(2) for r in range(4) for c in range(4) if (before(s, layer, r), drawn[s, layer, c]) in pairs}
    assert set(rows(found, "sample_id", "layer", "row", "col")) == want


def test_mvs_and_clusters_of_a_ring(graph):
    g = graph(RING)
    assert apps.mvs(g, 32, 2).count() == 64
    assert apps.clustergcn(g, 2).count() == 64
    assert validate.subgraph_violations(apps.clustergcn(g, 2), apps.cluster_seeds(g, 2), g).count() == 0
    assert validate.batch_violations(apps.mvs(g, 32, 2), batch_seeds(2, 32)(g), g).count() == 0


def test_a_task_has_a_bounded_number_of_walks(graph):
    g = graph(RING)
    seeds = one_seed_per_vertex(100 * SEEDS)(g)
    assert seeds.rdd.getNumPartitions() >= 100
    assert one_seed_per_vertex(5)(g).select("sample_id", "transit").collect() == [(s, s % g.n_vertices) for s in range(5)]


def joined_rows(df):
    """The most rows that a join of the plan gave."""
    df.collect()
    most, left = 0, [df._jdf.queryExecution().executedPlan()]
    while left:
        p = left.pop()
        name = p.nodeName()
        if "Join" in name:
            most = max(most, p.metrics().apply("numOutputRows").value())
        if name == "AdaptiveSparkPlan":
            left.append(p.executedPlan())
        elif "QueryStage" in name:
            left.append(p.plan())
        else:
            left += [p.children().apply(k) for k in range(p.children().size())]
    return most


@pytest.mark.parametrize("at_once", [256, 3])
def test_induced_edges_equal_brute_force(graph, monkeypatch, at_once):
    monkeypatch.setattr(validate, "SAMPLES", at_once)
    edges = [(a, b, 1.0) for a in range(12) for b in range(12) if (a * 5 + b * 3) % 4]
    g = graph(edges)
    own = {(s, v) for s in range(40) for v in range(12) if (s + v * v) % 5}
    members = g.spark.createDataFrame([*own, (0, 1)], "sample_id long, vertex int")
    found = validate.induced(members, g)
    want = sorted((s, a, b) for a, b, _ in edges for s in range(40) if (s, a) in own and (s, b) in own)
    assert sorted(map(tuple, found.collect())) == want
    if at_once == 256:  # a row an edge, not one for each sample of its source
        assert joined_rows(found) == len(edges)


def test_cluster_edges_meet_pairs_of_clusters_only(graph):
    g = graph([(a, (a + d) % 96, 1.0) for a in range(96) for d in (1, 50)])
    found = apps.clustergcn(g, 30)
    clusters = lambda s: [(s * 2 + k) % 6 for k in (0, 1)]
    want = sorted((s, a, (a + d) % 96) for s in range(30) for a in range(96) for d in (1, 50) if a // 16 in clusters(s) and (a + d) % 96 // 16 in clusters(s))
    assert sorted(map(tuple, found.collect())) == want
    assert joined_rows(found) == len(want)


def test_mvs_keeps_parallel_edges_clusters_do_not(graph):
    g = graph(MULTI)
    assert apps.mvs(g, 3, 1).count() == 5
    h = graph(MULTI, 16)
    assert apps.clustergcn(h, 1, each=1).count() == 4


def test_frontier_operators(spark, graph):
    f = spark.createDataFrame([(s, t) for s in range(40) for t in ((0,) if s < 38 else (1, None))], "sample_id long, transit int")
    assert rows(fr.positions(f), "transit", "n_samples", "start") == [(0, 38, 0), (1, 2, 38)]
    assert rows(fr.kernel_classes(f), "transit", "class") == [(0, "block"), (1, "identity")]
    assert fr.valid(f, 1).count() == 38
    assert rows(fr.sample_parts(spark.range(10).withColumnRenamed("id", "sample_id"), 10, 3), "sample_id", "part") == [(i, min(i // 3, 2)) for i in range(10)]
    assert rows(fr.degree_histogram(graph(CHAIN)), "bucket", "n_vertices") == [(-1, 1), (0, 3)]


def test_collective(graph):
    g = graph(STAR)
    seeds = batch_seeds(2, 2)(g)  # (0, 1) and (2, 3)
    assert rows(fr.collective_size(seeds, g), "sample_id", "size", "start") == [(0, 5, 0), (1, 2, 5)]
    assert rows(fr.collective_edges(seeds, g), "sample_id", "place", "dst") == [(0, 0, 1), (0, 1, 2), (0, 2, 3), (0, 3, 4), (0, 4, 0), (1, 0, 0), (1, 1, 0)]


def test_without_replacement_takes_different_edges(graph):
    g = graph(STAR)
    found = fr.without_replacement(one_seed_per_vertex()(g), g, 3)
    assert found.filter("sample_id = 0").count() == 3 == found.filter("sample_id = 0").select("pos").distinct().count()
    assert found.filter("sample_id = 1").count() == 1


def test_places_without_replacement_are_all_sets_alike(spark):
    df = spark.range(12_000).select(F.col("id").alias("sample_id"), F.lit(0).alias("slot"), F.lit(5).alias("degree"))
    got = dict(df.select(F.array_sort(fr.different_places(1, 0, "slot", F.col("degree"), 2)).cast("string").alias("s")).groupBy("s").count().collect())
    assert len(got) == 10 and chi2(got, {k: 0.1 for k in got}) < 27.9


@pytest.mark.parametrize("edges", [STAR + WEIGHTED, MULTI, CHAIN, LOOP, RING], ids=["star", "multi", "chain", "loop", "ring"])
def test_hops_of_different_edges(graph, edges):
    """Tasks and joins agree; a transit's edges are different ones, as many as there are or are asked for."""
    g, app = graph(edges), apps.khop_distinct((3, 2))
    columns = ("sample_id", "step", "slot", "parent_slot", "transit", "vertex")
    found = rows(run(g, app, strategy="sample").samples, *columns)
    assert found == rows(run(g, app, strategy="transit").samples, *columns) and found
    degree, taken = dict(g.degrees.select("id", "degree").collect()), {}
    for s, step, _, parent, transit, vertex in found:
        taken.setdefault((s, step, parent, transit), []).append(vertex)
    for (_, step, _, transit), ends in taken.items():
        assert len(ends) == min((3, 2)[step], degree[transit])
        assert all(ends.count(v) <= sum((a, b) == (transit, v) for a, b, _ in edges) for v in ends)


def test_different_edges_join_no_others(graph):
    """A hub of 3,000 edges, three of which are asked for by each of its walkers."""
    g = graph([(0, k + 1, 1.0) for k in range(3000)])
    app = SamplingApp("d", 1, 3, lambda g: g.spark.range(50).select(F.col("id").alias("sample_id"), F.lit(0).alias("slot"), F.lit(0).alias("transit")), distinct=True)
    found = run(g, app, strategy="transit").samples
    assert found.count() == 150
    plan = found._jdf.queryExecution().executedPlan()
    assert "posexplode" in plan.toString().lower() and "Window" not in plan.toString().split("InMemoryTableScan")[0]


WEB = [(a, b, float(1 + (a * 7 + b) % 3)) for a in range(12) for b in range(12) if (a * b + a + 2 * b) % 3] + [(20, b % 12, 1.0 + b % 4) for b in range(700)] + [(b, 20, 2.0) for b in range(12)]


def plain_choice(walker, step, slot, edges, weight, number=rng):
    """Two draws a range of 256 edges: where in the range, and the race of ranges."""
    import math

    draws, best = rng.Draws(42), None
    own = np.array([walker])
    for first in range(0, len(edges), gr.RANGE):
        part, upto = edges[first : first + gr.RANGE], []
        for e in part:
            upto.append((upto[-1] if upto else 0.0) + weight(e))
        if upto[-1] > 0:
            r = first // gr.RANGE
            x = draws(own, step, slot, 2 * r + 3)[0] * upto[-1]
            key = -math.log(draws(own, step, slot, 2 * r + 2)[0]) / upto[-1], r
            if best is None or key < best[0]:
                best = key, part[next(k for k, t in enumerate(upto) if t >= x)]
    return best and best[1]


@pytest.mark.parametrize("strategy", ["sample", "transit"])
def test_weighted_second_order_walks_by_brute_force(graph, strategy):
    g, pairs = graph(WEB), {(a, b) for a, b, _ in WEB}
    slices = {v: sorted((b, w) for a, b, w in WEB if a == v) for v in range(21)}
    want = []
    for s in range(42):
        v, t = s % 21, None
        for step in range(3):
            weigh = lambda e: e[1] * (1.0 if t is None else 2.0 if e[0] == t else 2.0 if (t, e[0]) in pairs else 1.0)  # noqa: B023, E731
            got = plain_choice(s, step, 0, slices[v], weigh)
            if got is None:
                break
            want.append((s, step, v, got[0]))
            v, t = got[0], v
    app = apps.weighted_node2vec(3, 42)
    result = run(g, app, strategy=strategy)
    assert rows(result.samples, "sample_id", "step", "transit", "vertex") == want and len(want) > 70
    assert result.violations().count() == 0


def test_a_function_of_edges_with_state_end_and_stop(graph):
    """It sees the state; a walk stops where it says; transits come from the state."""
    seeds = lambda g: one_seed_per_vertex()(g).withColumn("home", F.col("transit"))
    far = lambda b: (np.abs(b.vertex - b.state["home"]) == 1).astype(float)
    app = SamplingApp("near home", 3, 1, seeds, choose=far, edge_columns=("home",), transits=lambda c: c.state["home"], stop=lambda c: c.transit == 5)
    both = RING + [(b, a, 1.0) for a, b, _ in RING]
    found = rows(run(graph(both), app).samples, "sample_id", "step", "transit", "vertex")
    assert all(t == s and abs(v - s) == 1 for s, _, t, v in found) and {s for s, *_ in found} == set(range(32)) - {5} and len(found) == 31 * 3
    none = SamplingApp("none", 2, 1, one_seed_per_vertex(), choose=lambda b: np.zeros(len(b.vertex)))
    assert run(graph(both), none).samples.count() == 0
    with pytest.raises(ValueError):
        run(graph(both), SamplingApp("x", 1, 2, one_seed_per_vertex(), choose=far))


def test_layers_by_importance_by_brute_force(graph):
    import math
    from collections import Counter

    g, app = graph(WEB, 24), apps.ladies_app(2, 4, 9)
    draws, want, links = rng.Draws(42), [], []
    for s in range(9):
        layer = {(s * 4 + i) % 24 for i in range(4)}
        for step in range(2):
            n = Counter(b for a, b, _ in WEB if a in layer)
            keys = sorted((-math.log(draws(np.array([s]), step, v, 0)[0]) / n[v] ** 2, v) for v in n)[:4]
            want += [(s, step, k, v) for k, (_, v) in enumerate(keys)]
            links += [(s, step, a, b, sum((a, b) == e[:2] for e in WEB)) for a in layer for _, b in keys if any((a, b) == e[:2] for e in WEB)]
            layer = {v for _, v in keys}
    result = run(g, app)
    assert rows(result.samples, "sample_id", "step", "slot", "vertex") == sorted(want)
    assert rows(result.output(), "sample_id", "step", "row", "col", "n") == sorted(links)
    assert result.violations().count() == 0


def test_a_walk_that_ends_early_runs_no_more_steps(spark, graph):
    """A walk of 100 steps through a chain of four, by joins, with a look at every second step."""
    g = graph(CHAIN)
    group = spark.sparkContext
    group.setJobGroup("early", "early")
    try:
        found = run(g, apps.uniform_walk(100), strategy="transit", checkpoint_every=2).samples
        assert found.count() == 6
        jobs = len(group.statusTracker().getJobIdsForGroup("early"))
    finally:
        group._jsc.clearJobGroup()
    assert jobs < 40  # 50 looks would be 100 jobs at least


def test_hot_keys_are_joined_apart(spark, graph, monkeypatch):
    """Half of the walkers stand at a vertex with one edge: they leave the shuffle."""
    from ambler.plans import engine

    edges = RING + [(40, 0, 1.0)]
    seeds = lambda g: g.spark.range(4000).select(F.col("id").alias("sample_id"), F.lit(0).alias("slot"), F.when(F.col("id") % 2 == 0, 40).otherwise(F.col("id") % 32).cast("int").alias("transit"))
    app, g = SamplingApp("hot", 3, 1, seeds), graph(edges)
    columns = ("sample_id", "step", "transit", "vertex")
    want = rows(run(g, app, strategy="transit").samples, *columns)
    left, real = [], engine._joined

    def counted(frontier, index, how, weighted):
        found = engine.hot_keys(frontier, 4)
        rest = frontier.join(found, ["__vertex", "__cell"], "left_anti")
        left.append((found.count(), rest.groupBy("__vertex", "__cell").count().agg(F.max("count")).first()[0]))
        return real(frontier, index, how, weighted)

    monkeypatch.setattr(engine, "_joined", counted)
    assert rows(run(g, app, strategy="transit", balance=True).samples, *columns) == want
    assert left[0][0] == 1 and all((most or 0) <= 4000 // 16 + 1 for _, most in left)


def test_the_smaller_side_is_hashed(spark, graph):
    plan = lambda app: run(graph(STAR), app, strategy="transit").samples._jdf.queryExecution().toString()
    assert "rightHint=(strategy=shuffle_hash)" not in plan(apps.uniform_walk(1, 2)) and "leftHint=(strategy=shuffle_hash)" in plan(apps.uniform_walk(1, 2))
    assert "rightHint=(strategy=shuffle_hash)" in plan(apps.uniform_walk(1, 50))


def test_fabricated_walks_are_reported(spark, graph):
    """A walk from 0 to 1 and then from 2 to 3, and an empty result."""
    g = graph(CHAIN)
    made = spark.createDataFrame([(0, 0, 0, 0, 1), (0, 1, 0, 2, 3)], "sample_id long, step int, slot long, transit int, vertex int")
    seeds = one_seed_per_vertex(1)(g)
    assert rows(validate.chain_violations(made, seeds, g, 2), "sample_id", "step", "vertex", "kind") == [(0, 1, 3, "not_held")]
    roots = spark.createDataFrame([(0, 0, 0), (0, 1, 1)], "sample_id long, i int, v int")
    assert rows(validate.root_violations(made, roots, g), "sample_id", "step", "vertex", "kind") == [(0, 1, 3, "not_held")]
    again = spark.createDataFrame([(0, 0, 0, 0, 1), (0, 1, 0, 1, 2), (0, 2, 0, 1, 2)], made.schema)
    assert rows(validate.root_violations(again, roots, g), "step", "kind") == [(2, "not_held")]
    other = spark.createDataFrame([(0, 0, 0, 1, 2)], made.schema)
    assert rows(validate.root_violations(other, roots, g), "step", "kind") == [(0, "not_held")]
    assert rows(validate.root_violations(made.limit(0), roots, g), "sample_id", "kind") == [(0, "empty_step")]
    for name, due in (("uniform", 3), ("node2vec", 300), ("multirw", None), ("khop", 3), ("khop-distinct", 3)):
        wrong = apps.violations(g, name, made.limit(0))
        assert {r.kind for r in wrong.collect()} == {"empty_step"} and (due is None or wrong.count() == due)
    late = spark.createDataFrame([(0, 0, 0, 0, 1)], made.schema)
    assert rows(validate.chain_violations(late, seeds, g, 3), "step", "kind") == [(1, "empty_step")]


@pytest.mark.parametrize("name", sorted(apps.APPS))
def test_every_sampler_runs_by_name_and_checks_itself(graph, name, monkeypatch):
    monkeypatch.setattr(apps, "STEPS", 100)
    g = graph(RING + STAR)
    options = {"samples": 40} if name not in ("fastgcn", "ladies", "ladies-importance", "mvs", "clustergcn") else {"samples": 5}
    if name in ("deepwalk", "ppr", "uniform", "node2vec", "node2vec-weighted", "multirw"):
        options["steps"] = 3
    if name == "multirw":
        options["roots"] = 3
    result = run(g, apps.app_of(name, 7, **options), 7)
    assert result.samples.count() > 0 and result.violations(7).isEmpty()
    assert "sample_id" in result.output().columns


@pytest.mark.parametrize("weighted", [False, True])
def test_a_stored_index_is_not_shuffled(spark, graph, tmp_path, weighted):
    from ambler.plans import engine

    app = apps.deepwalk(3, 40) if weighted else apps.uniform_walk(3)
    columns, path = ("sample_id", "step", "transit", "vertex"), str(tmp_path / "index")
    want = rows(run(graph(STAR + WEIGHTED), app).samples, *columns)
    buckets = engine.store_index(graph(STAR + WEIGHTED), path, weighted)
    g = graph(STAR + WEIGHTED)
    engine.stored_index(g, path, buckets, weighted)
    found = run(g, app, strategy="transit").samples
    assert rows(found, *columns) == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    scans = [k for k, line in enumerate(plan.splitlines()) if "FileScan parquet" in line]
    above = ["".join(plan.splitlines()[k - 3 : k]) for k in scans]
    assert len(scans) >= 3 and not any("Exchange" in lines for lines in above)


def test_release_frees_what_runs_kept(spark, graph):
    g = graph(STAR)
    run(g, apps.uniform_walk(2), strategy="transit").samples.count()
    run(g, apps.uniform_walk(2)).samples.count()
    held = list(g.kept.values())
    assert held and g.shared and all(t.storageLevel.useMemory for t in held)
    g.release()
    assert not g.kept and not g.shared and not any(t.storageLevel.useMemory for t in held)
    assert run(g, apps.uniform_walk(2)).samples.count() == 10


def test_inverted_frontier(spark):
    f = spark.createDataFrame([(3, 5), (1, 5), (2, 0), (4, None)], "sample_id long, transit int")
    assert rows(fr.invert(f), "place", "transit", "sample_id") == [(0, 0, 2), (1, 5, 1), (2, 5, 3), (3, None, 4)]


def test_walk_joins_do_not_shuffle_a_kept_index_again(graph):
    plan = run(graph(STAR), apps.uniform_walk(2), strategy="transit").samples._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan


def test_second_order_and_many_roots_agree_in_tasks_and_joins(graph):
    columns = ("sample_id", "step", "slot", "transit", "vertex")
    for edges in (STAR + WEIGHTED, MULTI):
        for make in (lambda g, s: apps.node2vec(g, 3, 6, strategy=s), lambda g, s: apps.multirw(g, 3, 4, roots=3, strategy=s)):
            assert rows(make(graph(edges), "sample"), *columns) == rows(make(graph(edges), "transit"), *columns)


def test_large_graphs_are_not_shared(graph, monkeypatch):
    from ambler.plans import engine

    monkeypatch.setattr(engine, "BROADCAST_VERTICES", 3)
    assert engine.chosen(graph(CHAIN), "auto") == "transit"
    with pytest.raises(ValueError, match="up to"):
        engine.chosen(graph(CHAIN), "sample")


def test_hubs_are_ordered_in_ranges(graph, monkeypatch):
    edges = [(0, d * 50_000 % 400_000, float(w)) for d in range(8) for w in range(1, 4)] + STAR
    want = [rows(graph(edges).positions, "src", "pos", "dst", "weight"), rows(graph(edges).weighted_index, "vertex", "cell", "lo", "hi", "dst")]
    monkeypatch.setattr(gr, "HUB_EDGES", 5)
    g = graph(edges)
    assert g.has_hubs and g.positions.dtypes == graph(STAR).positions.dtypes
    assert [rows(g.positions, "src", "pos", "dst", "weight"), rows(g.weighted_index, "vertex", "cell", "lo", "hi", "dst")] == want


def test_layers_by_probes_and_by_joins_agree(graph, monkeypatch):
    from ambler.plans import engine

    want = rows(apps.layer_matrices(graph(STAR), 2, 4, 6), "sample_id", "layer", "row", "col", "src", "dst")
    monkeypatch.setattr(engine, "BROADCAST_ROWS", 0)
    assert rows(apps.layer_matrices(graph(STAR), 2, 4, 6), "sample_id", "layer", "row", "col", "src", "dst") == want and want


def test_collective_app_draws_from_all_edges_of_a_sample(graph):
    app = SamplingApp("c", 2, 50, batch_seeds(40, 3), sampling_type=SamplingType.COLLECTIVE, initial_size=3)
    g = graph(STAR)
    found = run(g, app).samples
    assert found.count() == 40 * 100 and validate.edge_violations(found, g).count() == 0
    got = dict(found.filter("step = 0 AND sample_id % 5 = 0").groupBy("transit").count().collect())  # transits 0, 1, 2 of 4, 1, 1 edges
    assert chi2(got, {0: 4 / 6, 1: 1 / 6, 2: 1 / 6}) < 13.8
    with pytest.raises(ValueError):
        run(g, SamplingApp("c", 1, 2, batch_seeds(1, 1), weighted=True, sampling_type=SamplingType.COLLECTIVE))


def test_a_rule_that_looks_at_the_edge(graph):
    """Walks that never go straight back, and prefer larger vertices two to one."""
    both = RING + [(b, a, 1.0) for a, b, _ in RING]
    app = SamplingApp("on", 2, 1, one_seed_per_vertex(1600), weigh=lambda c: F.when(c.vertex == c.previous, 0.0).when(c.vertex > c.transit, 1.0).otherwise(0.5))
    found = run(graph(both), app).samples
    walks = found.groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("step", "vertex"))).alias("w")).select("sample_id", "w.vertex").collect()
    assert len(walks) == 1600 and all((w[0] - s) % 32 == (w[1] - w[0]) % 32 for s, w in walks)
    up = sum((w[0] - s) % 32 == 1 for s, w in walks if 0 < s % 32 < 31)
    assert abs(up / (1600 * 30 / 32) - 2 / 3) < 0.05
    with pytest.raises(ValueError):
        run(graph(both), SamplingApp("x", 2, 2, one_seed_per_vertex(), weigh=lambda c: F.lit(1.0)))


def test_planner_knows_how_many_seeds_there_are(graph):
    g = graph(STAR)
    size = lambda df: int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    tables = [batch_seeds(50_000, 32)(g), apps.cluster_seeds(g, 50_000), apps.root_table(g, 50_000, 100, 1), *apps.layer_vertices(g, 5, 64, 10_000)]
    assert all(size(t) > 10 << 20 for t in tables)  # none of them is broadcast by itself


def test_edges_are_computed_once(spark):
    reads = spark.sparkContext.accumulator(0)

    def noted(batches):
        for b in batches:
            reads.add(b.num_rows)
            yield b

    edges = spark.createDataFrame([(a, b, 1.0) for a, b, _ in STAR], "src int, dst int, weight double").mapInArrow(noted, "src int, dst int, weight double")
    g = Graph(edges)
    run(g, apps.uniform_walk(2), strategy="transit").samples.count()
    assert g.pairs.count() == len(STAR) and reads.value == len(STAR)
    g.release()


def test_tasks_take_more_edges_than_joins_broadcast(graph, monkeypatch):
    from ambler.plans import engine

    want = {s: rows(run(graph(STAR), apps.deepwalk(5, 40), strategy=s).samples, "sample_id", "step", "transit", "vertex") for s in ("sample", "transit")}
    monkeypatch.setattr(engine, "BROADCAST_ROWS", 2)  # STAR has 8 edges
    g = graph(STAR)
    assert engine.chosen(g, "auto") == "transit" and engine.chosen(g, "auto", packed=True) == "sample"
    assert rows(run(g, apps.deepwalk(5, 40)).samples, "sample_id", "step", "transit", "vertex") == want["sample"] == want["transit"] and g.shared


#: Hubs of more edges than a row of the index has, an uneven weight each, and edges back.
HUBS = [(h, 2 + (k * 7 + h) % 2500, 0.25 * (k % 5)) for h in (0, 1) for k in range(2500)] + [(2 + k, (k + s) % (2 if s else 2502), 1.0 + k % 3) for k in range(2500) for s in (0, 1)]


def test_rows_of_many_edges_give_what_tasks_give(graph):
    """Index rows of up to 1,024 edges (64 by weight): every choice is that of the packed graph."""
    columns = ("sample_id", "step", "slot", "transit", "vertex")
    makers = [apps.uniform_walk(3, 600), apps.khop((6, 3), 40), apps.khop_distinct((6, 3), 40), apps.deepwalk(3, 600), apps.node2vec_app(3, 300)]
    makers.append(SamplingApp("ends", 2, [4, 2], one_seed_per_vertex(60), end=0.2))
    one, other = graph(HUBS), graph(HUBS)
    for app in makers:
        found = run(one, app, strategy="transit").samples
        assert rows(found, *columns) == rows(run(other, app, strategy="sample").samples, *columns), app.name
    assert one.uniform_spans.count() == 2 * 3 + 2500 and one.uniform_spans.agg(F.max(F.size("ends"))).first()[0] == 1024
    assert 0 < one.weighted_spans.agg(F.max(F.size("ends"))).first()[0] <= 64


def test_a_fan_out_meets_the_row_of_its_transit_once(graph):
    """No row for each of 25 choices is joined: they are made after it."""
    found = run(graph(RING), apps.khop((25,), 32), strategy="transit").samples
    assert found.count() == 800
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan.split("Join", 1)
    assert "Generate explode" in above


def test_a_violation_is_looked_for_among_pairs_not_all_edges(graph):
    """400 walkers at a hub of 2,500 edges: the join of steps and edges has a row for each walker."""
    g = graph(HUBS)
    seeds = g.spark.range(400).select(F.col("id").alias("sample_id"), F.lit(0).alias("slot"), F.lit(0).alias("transit"))
    made = g.spark.range(400).select(F.col("id").alias("sample_id"), F.lit(0).alias("step"), F.when(F.col("id") < 3, 1).otherwise(F.col("id") + 2).cast("int").alias("vertex"))
    found = validate.vertex_violations(made, seeds, g)
    assert rows(found, "sample_id", "kind") == [(k, "not_neighbor") for k in range(3)]
    assert "LeftSemi" in found._jdf.queryExecution().optimizedPlan().toString().split("LeftAnti")[1]


def test_importance_in_tasks_and_by_joins_agree(graph):
    """Hubs of more edges than an index row has; no task of the joins counts more than its share."""
    from ambler.plans import engine

    app, found = apps.ladies_app(3, 8, 30), {}
    for strategy in ("sample", "transit"):
        g = graph(HUBS)
        result = run(g, app, strategy=strategy)
        found[strategy] = rows(result.samples, "sample_id", "step", "slot", "vertex"), rows(result.output(), "sample_id", "step", "row", "col", "n")
        assert bool(g.shared) == (strategy == "sample")
    assert found["sample"] == found["transit"] and found["sample"][0]
    every = one_seed_per_vertex(100)(g).join(g.degrees.select(F.col("id").alias("transit"), "degree"), "transit")
    counted, flat = engine._counted_layer(every, g), engine._layer(every, g)
    assert rows(counted, "sample_id", "dst", "n") == rows(flat, "sample_id", "dst", "n")
    plan = counted._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate explode(i_ends") < plan.index("REPARTITION_BY_NUM")


def test_index_is_put_in_order_in_tasks_without_a_window(spark, graph, monkeypatch):
    """Sources cut by batches, parallel edges, loops, weights of 0 and a missing source, as by ranges."""
    edges = [(0, k % 90, float(k % 4)) for k in range(3000)] + [(v, (v * 7) % 50, 0.0) for v in range(1, 40)] + [(5, 5, 1.5), (None, 3, 1.0)] + [(41, k, float(k)) for k in range(70)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        one = graph(edges, 91)
        assert one.n_edges > 0 and "Window" not in one.uniform_spans._jdf.queryExecution().executedPlan().toString()
        uniform, weighted = rows(one.uniform_spans, "vertex", "cell", "ends", "far"), rows(one.weighted_spans, "vertex", "cell", "lo", "hi", "upto", "ends", "far", "far_total")
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    one.release()  # what was kept is made anew
    assert rows(one.uniform_spans, "vertex", "cell", "ends", "far") == uniform and one.arrays
    one.release()
    monkeypatch.setattr(gr, "ARRAY_VERTICES", 0)
    one = graph(edges, 91)
    assert rows(one.uniform_spans, "vertex", "cell", "ends", "far") == uniform
    one.release()
    monkeypatch.setattr(gr, "HUB_EDGES", 5)
    two = graph(edges, 91)
    assert two.has_hubs
    assert rows(two.uniform_spans.filter("vertex IS NOT NULL"), "vertex", "cell", "ends", "far") == uniform
    assert rows(two.weighted_spans.filter("vertex IS NOT NULL"), "vertex", "cell", "lo", "hi", "upto", "ends", "far", "far_total") == weighted
    two.release()


def test_a_walk_row_carries_few_vertices_and_steps_shared_are_found_in_one_pass(graph):
    from ambler.plans import engine

    g, app = graph(WEB), apps.uniform_walk(17)
    found = run(g, app, strategy="transit").samples
    assert rows(found, "sample_id", "step", "slot", "parent_slot", "transit", "vertex") == rows(run(g, app, strategy="sample").samples, "sample_id", "step", "slot", "parent_slot", "transit", "vertex")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Union") and plan.count("parquet") >= 17 // engine.CARRIED - 1
    shared = fr.step_overlap(found, 2)
    held = {(r.sample_id, r.step, r.vertex) for r in found.collect()}
    want = {}
    for s, k, v in held:
        if (s, k - 2, v) in held:
            want[s, k] = want.get((s, k), 0) + 1
    assert {(r.sample_id, r.step): r.n_shared for r in shared.collect()} == want
    assert shared._jdf.queryExecution().optimizedPlan().toString().count("Intersect") == 0 and "LeftSemi" not in shared._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name, each", [("deepwalk", 100), ("ppr", 100), ("node2vec", 100), ("ladies-importance", 8), ("mvs", 8), ("clustergcn", 8)])
def test_no_count_of_samples_is_cut_on_large_graphs(graph, name, each):
    """As many walks a vertex, and passes over the vertices, on graphs of more vertices and edges than any bound."""
    g = graph(RING, 1 << 23)
    g.__dict__["n_edges"] = 10**8 + 1
    app = apps.app_of(name)
    assert app.seeds(g).count() == each * (1 << 23)


def test_queries_draw_as_many_batches_as_their_sql(graph):
    from ambler import queries

    g = graph(RING, 1 << 23)
    g.__dict__["n_edges"] = 10**8 + 1
    assert queries._batch(g).count() == queries._members(g).count() == 8 * (1 << 23)


def test_many_roots_by_joins_take_as_many_rounds_as_one_root_has_steps(graph, monkeypatch):
    """Equal to the walks in tasks, with dead ends, in far fewer joins than steps; no row carries the roots."""
    from ambler.plans import engine

    g = graph([*RING, *STAR, (3, 40, 1.0)])
    joined, made = engine._joined, []
    monkeypatch.setattr(engine, "_joined", lambda rows, *a: made.append(rows.columns) or joined(rows, *a))
    by_joins, in_tasks = (rows(apps.multirw(g, 40, 50, roots=30, strategy=s), "sample_id", "step", "slot", "parent_slot", "transit", "vertex") for s in ("transit", "sample"))
    assert by_joins == in_tasks and len(by_joins) > 1000
    assert len(made) < 12 and not any("roots" in columns for columns in made)


def test_a_root_stays_at_an_edge_without_an_end(graph):
    g = graph([(0, None, 1.0), (0, 1, 1.0), (1, 0, 1.0)])
    found = rows(apps.multirw(g, 30, 20, roots=2, strategy="transit"), "sample_id", "step", "transit", "vertex")
    assert all(v is not None for *_, v in found) and 300 < len(found) < 600
    # a root's next transit is its vertex, or where it stayed: steps from 0 and 1 take turns but for those
    assert {(t, v) for *_, t, v in found} == {(0, 1), (1, 0)}


def _tangle():
    """Two hubs that share ends with each other, parallel edges and small vertices, weighted."""
    edges = [(0, k, 1.0 + k % 3) for k in range(1, 600)] + [(k, 0, 1.0) for k in range(1, 600)]
    edges += [(600, k, 1.0 + k % 4) for k in range(1, 600, 2)] + [(k, 600, 2.0) for k in range(1, 600, 2)]
    return edges + [(k, k + 1, 0.5) for k in range(1, 599)] + [(0, 600, 50.0), (600, 0, 50.0), (0, 3, 2.0)]


def test_weighted_second_order_walks_send_lists_not_edges(graph, monkeypatch):
    """Where previous has few edges no edge has a row of its own; with many, by keys, the walks are the same."""
    from ambler.plans import edges

    g = graph(_tangle())
    columns, taken = ("sample_id", "step", "transit", "vertex"), {}
    for span in (1024, 2, 100):  # all vertices are few, none is, or all but the hubs
        monkeypatch.setattr(edges, "SPAN", span)
        g.release()
        for strategy in ("transit", "sample"):
            taken[span, strategy] = rows(run(g, apps.weighted_node2vec(5), 7, strategy).samples, *columns)
    first = taken[1024, "transit"]
    assert len(first) == 601 * 5 and all(found == first for found in taken.values())
    monkeypatch.setattr(edges, "SPAN", 1024)
    g.release()
    made = run(g, apps.weighted_node2vec(3), 7, "transit").samples
    seen, step = [], edges._with_near
    monkeypatch.setattr(edges, "_with_near", lambda *a: seen.append(step(*a)) or seen[-1])
    run(g, apps.weighted_node2vec(3), 7, "transit").samples.count()
    assert made.count() == 601 * 3
    # a row for each range of a transit's edges, three of a hub's 601 and 300, not for each edge
    assert all(s.count() < 601 * 4 for s in seen) and len(seen) == 2


@pytest.mark.parametrize("span, samples", [(1024, 256), (1024, 1), (1, 256), (1, 1)])
def test_batch_violations_by_lists_and_by_pairs(spark, graph, monkeypatch, span, samples):
    """All ways of looking up a pair and a sample, with rows twice, wrong sources and missing ends; no row of the result is twice."""
    monkeypatch.setattr(validate, "SPAN", span)
    monkeypatch.setattr(validate, "SAMPLES", samples)
    edges = [(a, b, 1.0) for a in range(6) for b in range(6) if (a * b + a) % 3 != 1] + [(0, 0, 2.0), (5, 0, 3.0)]
    members = {s: {s % 6, (s + 1) % 6, (s * s) % 6} for s in range(8)}
    seeds = spark.createDataFrame([(s, v) for s, vs in members.items() for v in vs], "sample_id long, transit int")
    found = [(s, a, b) for s in range(9) for a in range(6) for b in range(6) if (s + a + b) % 2] * 2 + [(0, 0, None), (0, None, 1), (1, 77, 0)]
    pairs = {(a, b) for a, b, _ in edges}
    due = {(s, a, b, "missing") for s, vs in members.items() for a, b in pairs if a in vs and b in vs and (s, a, b) not in found}
    due |= {(s, a, b, "not_edge") for s, a, b in found if a not in members.get(s, ()) or (a, b) not in pairs}
    got = validate.batch_violations(spark.createDataFrame(found, "sample_id long, src int, dst int"), seeds, graph(edges)).collect()
    assert len(got) == len(due) and {tuple(r) for r in got} == due


def test_batch_edges_are_not_dealt_by_sample(graph, monkeypatch):
    """Edges of batches, of which there are many times those of the graph, meet what they are checked against where they are made."""
    g = graph(RING, 32)
    g.spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    g.spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        wrong = validate.batch_violations(apps.mvs(g, 4), batch_seeds(64, 4)(g), g)
        plan = wrong.filter("kind = 'not_edge'")._jdf.queryExecution().executedPlan().toString()
    finally:
        g.spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        g.spark.conf.unset("spark.sql.adaptive.enabled")
    dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning(" in line and "sample_id" in line and "src" in line]
    assert not dealt, plan


@pytest.mark.parametrize("span", [1024, 3])
def test_roots_are_replayed_sample_by_sample(spark, graph, monkeypatch, span):
    """Against plain Python, on walks with wrong, missing and null steps, and without a shuffle by sample and vertex."""
    monkeypatch.setattr(validate, "SPAN", span)
    monkeypatch.setattr(validate, "REPLAYED", 50)
    g = graph([*STAR, (0, 1, 2.0), (5, 0, 1.0), (2, 3, 1.0)], 8)
    pairs = {(a, b) for a, b, *_ in g.edges.collect()}
    table = apps.root_table(g, 40, 4, 3)
    roots = {}
    for s, i, v in table.select("sample_id", "i", "v").collect():
        roots.setdefault(s, {})[i] = v
    walks = [tuple(r) for r in apps.multirw(g, 12, 40, roots=4, seed=3).select("sample_id", "step", "transit", "vertex").collect()]
    walks = [(s, k, t, None if (s, k) == (7, 4) else v + (s * k) % 2) for s, k, t, v in walks if (s * 5 + k) % 11 and not (s % 6 == 1 and k == 0)]
    due = [(s, k, v, "not_neighbor") for s, k, t, v in walks if (t, v) not in pairs]
    for s, own in roots.items():
        held, moves = list(own.values()), sorted((w for w in walks if w[0] == s), key=lambda w: w[1])
        for _, k, t, v in moves:
            if t not in held and held.count(t) < 1 or k == 0 and t != own[0]:
                due.append((s, k, v, "not_held"))
            if k > 0:
                held.append(v)
                held.remove(t) if t in held else held.append(("owed", t))
                while ("owed", v) in held and v in held:
                    held.remove(("owed", v)), held.remove(v)
        if not any(k == 0 for _, k, *_ in moves) and any(a == own[0] for a, _ in pairs):
            due.append((s, 0, None, "empty_step"))
    samples = spark.createDataFrame(walks, "sample_id long, step int, transit int, vertex int")
    found = validate.root_violations(samples, table, g)
    order = lambda r: tuple(-9 if x is None else x for x in r)
    assert sorted(map(tuple, found.collect()), key=order) == sorted(due, key=order) and {d[3] for d in due} == {"not_neighbor", "not_held", "empty_step"}
    assert "Window" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_importance_by_parts_of_the_graph(spark, graph, monkeypatch):
    """Many parts, small chunks and batches, missing ends: as in tasks; no edge of a sample is shuffled."""
    from ambler.plans import engine, local

    app = apps.ladies_app(3, 8, 30)
    columns = ("sample_id", "step", "slot", "vertex")
    want = rows(run(graph(HUBS), app, strategy="sample").samples, *columns)
    monkeypatch.setattr(engine, "PART_EDGES", 700)
    monkeypatch.setattr(local, "EDGES", 900)
    monkeypatch.setattr(local, "ROWS", 500)
    monkeypatch.setattr(engine, "_counted_layer", None)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        g = graph([*HUBS, (None, 1, 1.0), (0, None, 1.0)])
        assert g.n_edges > 3 * engine.PART_EDGES
        assert rows(run(g, app, strategy="transit").samples, *columns) == want and want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
