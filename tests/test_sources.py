import numpy as np
import pytest
from pyspark.sql import functions as F

from ambler.__main__ import main
from ambler.api import Sampler
from ambler.operators.graph import EDGE_SCHEMA, Graph
from ambler.plans import apps
from ambler.sources import graphs
from ambler.streaming.seeds import sample_stream

EDGES = [(0, 1, 1.5), (0, 2, 2.0), (1, 0, 1.0), (2, 1, 4.25)]


def write_binary(path):
    np.array(EDGES, graphs.RECORD).tofile(path)
    return str(path)


def edges(df):
    return sorted(tuple(r) for r in df.select("src", "dst", "weight").collect())


def test_binary_edges(spark, tmp_path):
    path = write_binary(tmp_path / "g.data")
    assert edges(graphs.read_graph(spark, path).edges) == EDGES
    assert edges(graphs.read_binary_folder(spark, path)) == EDGES


def test_text_edges(spark, tmp_path):
    p = tmp_path / "g.txt"
    p.write_text("# c\n0 1 1.5\n0\t2 2\n\n1 0 0\n2 1\n")
    assert edges(graphs.read_graph(spark, str(p), "edge-list", "text").edges) == [(0, 1, 1.5), (0, 2, 2.0), (1, 0, 0.0), (2, 1, 1.0)]
    assert len(edges(graphs.read_text_edges(spark, str(p), "drop"))) == 3
    with pytest.raises(Exception, match="weight 0"):
        graphs.read_text_edges(spark, str(p), "error").collect()
    with pytest.raises(ValueError):
        graphs.read_text_edges(spark, str(p), "other")


def test_adjacency_lists_relabel_by_line(spark, tmp_path):
    p = tmp_path / "a.txt"
    p.write_text("7 3 1.5 9 2\n3 7 1\n9 3 4.25 8 1\n")
    assert edges(graphs.read_adjacency(spark, str(p))) == [*EDGES, (2, 3, 1.0)]
    p.write_text("7 3 1.5 9 2 100 1\n3 7 1 50 2\n")
    assert edges(graphs.read_adjacency(spark, str(p))) == [(0, 1, 1.5), (0, 2, 2.0), (0, 4, 1.0), (1, 0, 1.0), (1, 3, 2.0)]
    assert (7, 3, 1.5) in edges(graphs.read_adjacency(spark, str(p), relabel=False))


def test_round_trips(spark, tmp_path):
    g = Graph(spark.createDataFrame(EDGES, EDGE_SCHEMA), 4)
    graphs.write_adjacency(g, str(tmp_path / "adj"))
    back = graphs.read_adjacency(spark, str(tmp_path / "adj"), relabel=False)
    assert edges(back) == EDGES
    graphs.write_text_edges(g, str(tmp_path / "txt"))
    assert edges(graphs.read_text_edges(spark, str(tmp_path / "txt"))) == EDGES
    g.edges.write.parquet(str(tmp_path / "t"))
    assert edges(graphs.read_graph(spark, str(tmp_path / "t"), "table", "parquet").edges) == EDGES


def test_unknown_formats_are_errors(spark):
    with pytest.raises(ValueError):
        graphs.read_graph(spark, "x", "adj-list", "binary")


def test_edges_to_adjacency_counts_the_first_edge(spark):
    got = dict(graphs.edges_to_adjacency(spark.createDataFrame(EDGES + EDGES[:1], EDGE_SCHEMA)).collect())
    assert got == {0: [1, 2], 1: [0], 2: [1]}


def test_sampler_object(spark, tmp_path):
    s = Sampler(spark, write_binary(tmp_path / "g.data"), app=apps.uniform_walk(4))
    m = s.final_samples_array()
    assert m.shape == (3, 4) == (s.n_samples(), s.sample_length()) and s.total_length() == 12
    assert s.final_samples() == m.ravel().tolist()
    pairs = {(a, b) for a, b, _ in EDGES}
    assert all((a, b) in pairs for row in np.column_stack([range(3), m]).tolist() for a, b in zip(row, row[1:]))
    s.close()


def test_command_line(spark, tmp_path, capsys):
    path = write_binary(tmp_path / "g.data")
    assert main(["-g", path, "-a", "khop", "-c", "-p", "-l", "-k", "TransitParallel", "-o", str(tmp_path / "out")], spark) == 0
    assert "valid" in capsys.readouterr().out and spark.read.parquet(str(tmp_path / "out")).count() == 3 * 275
    for app in ("mvs", "clustergcn", "multirw"):
        assert main(["-g", path, "-a", app, "-c", "-G", "2"], spark) == 0
        assert "not valid" not in (out := capsys.readouterr().out) and "valid" in out and "nbrs" in out


def test_stream_of_seeds(spark, tmp_path):
    g = Graph(spark.createDataFrame(EDGES, EDGE_SCHEMA))
    seeds = spark.createDataFrame([(5, 0), (6, 2)], "sample_id long, vertex int")
    seeds.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(seeds.schema).parquet(str(tmp_path / "in"))
    sample_stream(stream, g, apps.uniform_walk(3), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).groupBy("sample_id").count().count() == 2


def test_one_binary_file_is_read_by_several_tasks(spark, tmp_path):
    many = np.zeros(1000, graphs.RECORD)
    many["src"], many["dst"], many["weight"] = np.arange(1000), np.arange(1000)[::-1], np.arange(1000) / 4
    path = str(tmp_path / "one.data")
    many.tofile(path)
    found = graphs.read_binary_edges(spark, path, 300)
    assert found.withColumn("t", F.spark_partition_id()).groupBy("t").count().orderBy("t").select("count").collect() == [(300,), (300,), (300,), (100,)]
    assert sorted(map(tuple, found.collect())) == [(k, 999 - k, k / 4) for k in range(1000)]
    assert "file:" not in path and graphs.read_binary_edges(spark, f"file://{path}").count() == 1000
    with open(path, "ab") as f:
        f.write(b"cut")
    with pytest.raises(Exception, match="cut"):
        graphs.read_binary_edges(spark, path).count()
    with pytest.raises(Exception, match="missing.data"):
        graphs.read_binary_edges(spark, str(tmp_path / "missing.data")).count()


def test_binary_files_round_trip(spark, tmp_path):
    g = Graph(spark.createDataFrame([(k, (k * 7) % 50, k / 8) for k in range(50)], EDGE_SCHEMA).repartition(3))
    path = str(tmp_path / "folder")
    graphs.write_binary_edges(g, path)
    assert len([f for f in (tmp_path / "folder").iterdir() if f.name.startswith("part-")]) == 3 and not [f for f in (tmp_path / "folder").iterdir() if f.name.startswith(".")]
    assert edges(graphs.read_binary_edges(spark, path)) == edges(g.edges)
    graphs.write_binary_edges(Graph(g.edges.limit(0)), str(tmp_path / "none"))
    assert graphs.read_binary_edges(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(Exception, match="(?i)exist|fail|interrupt|zero|raise"):
        broken = g.edges.withColumn("weight", F.when(F.col("src") == 49, F.raise_error(F.lit("zero")).cast("double")).otherwise(F.col("weight")))
        graphs.write_binary_edges(Graph(broken), str(tmp_path / "broken"))
    assert not [f for f in (tmp_path / "broken").iterdir() if f.name.startswith("part-")]
