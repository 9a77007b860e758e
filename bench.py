"""Times headline queries and prints one JSON line.

BENCH_SF_DIR: folder of tables (default /root/testdata/sf0.1); BENCH_CPUS: cores of the
local master (default 8). Every query runs once to warm up; then graph queries are timed
three times, of which the median counts, the others once. A result is consumed whole, by a
count and a sum over hashes of its rows. ``scaling`` has the seconds of a walk and of k-hop
on fewer cores.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])


def main() -> None:
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from ambler.plans import apps
    from ambler.plans.engine import run
    from ambler.sources.graphs import purchase_graph

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")

    def session(cores):
        found = (
            SparkSession.builder.master(f"local[{cores}]")
            .config("spark.sql.shuffle.partitions", cores)
            .config("spark.driver.memory", "8g")
            .config("spark.ui.enabled", "false")
            .config("spark.ui.showConsoleProgress", "false")
            .config("spark.sql.session.timeZone", "UTC")
            .getOrCreate()
        )
        found.sparkContext.setLogLevel("ERROR")
        return found

    def load(spark):
        graph = purchase_graph(spark, sf_dir)
        graph.edges = graph.edges.cache()  # the reference's figure leaves out loading too
        graph.n_vertices, graph.n_edges  # noqa: B018
        return graph

    def consume(df) -> int:
        return df.agg(F.count("*"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)"))).first()[0]

    def timed(make, times):
        taken = []
        for _ in range(times + 1):  # the first run warms up
            began = time.time()
            n = consume(make())
            taken.append(time.time() - began)
        return n, round(statistics.median(taken[1:]), 3)

    spark = session(cpus)
    graph = load(spark)
    work = {
        "uniform_walk_100": lambda: run(graph, apps.uniform_walk(100)).samples,
        "uniform_walk_10": lambda: run(graph, apps.uniform_walk(10)).samples,
        "uniform_walk_10_shuffled": lambda: run(graph, apps.uniform_walk(10), strategy="transit").samples,
        "deepwalk_10": lambda: run(graph, apps.deepwalk(10, graph.n_vertices)).samples,
        "ppr_10": lambda: run(graph, apps.ppr(10, graph.n_vertices)).samples,
        "khop_25_10": lambda: run(graph, apps.khop()).samples,
        "khop_distinct_25_10": lambda: run(graph, apps.khop_distinct()).samples,
        "layer_10_25": lambda: run(graph, apps.layer()).samples,
        "node2vec_20": lambda: apps.node2vec(graph, 20, graph.n_vertices),
        "multirw_20": lambda: apps.multirw(graph, 20, graph.n_vertices),
        "mvs": lambda: apps.mvs(graph),
        "clustergcn": lambda: apps.clustergcn(graph),
        "fastgcn": lambda: apps.layer_matrices(graph, samples=1000),
    }
    plain = set(work)
    try:
        from ambler.llm import queries
    except ImportError:
        pass
    else:
        work |= {name: lambda q=q: q(spark, sf_dir) for name, q in queries.queries().items()}
    seconds, rows = {}, {}
    for name, make in work.items():
        rows[name], seconds[name] = timed(make, 3 if name in plain and name != "uniform_walk_10_shuffled" else 1)
    scaling = {}
    for cores in ("1", "2", "4"):
        spark.stop()
        spark = session(cores)
        graph = load(spark)
        scaling[cores] = {"uniform_walk_100": timed(lambda: run(graph, apps.uniform_walk(100)).samples, 1)[1], "khop_25_10": timed(lambda: run(graph, apps.khop()).samples, 1)[1]}  # noqa: B023
    print(json.dumps({"metric": "total seconds of headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "rows": rows, "walk_slots_per_second": round(rows["uniform_walk_100"] / seconds["uniform_walk_100"]), "scaling": scaling, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
