"""Command line: samples a graph file and prints or checks the result."""

from __future__ import annotations

import argparse
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .plans import apps
from .plans.engine import run
from .sources.graphs import read_graph

STRATEGY = {"TransitParallel": "transit", "SampleParallel": "sample", "auto": "auto"}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="ambler", description=__doc__)
    p.add_argument("-g", "--graph", required=True, help="path of the graph")
    p.add_argument("-t", "--graph-type", default="edge-list", choices=("edge-list", "adj-list", "table"))
    p.add_argument("-f", "--graph-format", default="binary", choices=("binary", "text", "parquet", "orc", "json", "csv"))
    p.add_argument("-a", "--app", default="uniform", choices=sorted(apps.APPS))
    p.add_argument("-n", "--nruns", type=int, default=1)
    p.add_argument("-c", "--check-results", action="store_true")
    p.add_argument("-p", "--print-samples", action="store_true")
    p.add_argument("-G", "--print-graph", type=int, default=0, metavar="N", help="show the first N adjacency lists")
    p.add_argument("-k", "--kernel", default="auto", choices=sorted(STRATEGY))
    p.add_argument("-l", "--load-balancing", action="store_true", help="join apart the keys at which many samples meet")
    p.add_argument("-o", "--output", help="folder for the samples as parquet")
    p.add_argument("-s", "--seed", type=int, default=42)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("ambler").getOrCreate()
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", str(args.load_balancing).lower())
    graph = read_graph(spark, args.graph, args.graph_type, args.graph_format)
    ok, app = True, apps.app_of(args.app, args.seed)
    for _ in range(args.nruns):
        began = time.time()
        result = run(graph, app, args.seed, STRATEGY[args.kernel], balance=args.load_balancing).samples
        column = "vertex" if "vertex" in result.columns else "dst"
        print(f"{args.app}: {result.agg(F.count(column)).first()[0]} vertices in {time.time() - began:.3f} s")
    if args.check_results:
        wrong = apps.violations(graph, args.app, result, args.seed).groupBy("kind").count().orderBy("kind").collect()
        ok = not wrong
        print("valid" if ok else "not valid: " + ", ".join(f"{n} {kind}" for kind, n in wrong))
    if args.print_graph:
        graph.adjacency().orderBy("vertex").show(args.print_graph, truncate=False)
    if args.print_samples:
        order = [c for c in ("step", "layer", "slot", "src", "dst", "vertex") if c in result.columns]
        result.groupBy("sample_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(*order))), lambda x: x[column]).alias("sample")).orderBy("sample_id").show(truncate=False)
    if args.output:
        result.write.parquet(args.output)
    return 0 if ok else 1


if __name__ == "__main__":
    raise SystemExit(main())
