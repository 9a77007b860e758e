"""Graph files: binary and text edge lists, adjacency lists, tables; and converters.

Readers run on executors through Spark's own file sources, so a path may be in any
store Spark reads. A missing path is an error.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import EDGE_SCHEMA, Graph
from ..operators.scan import numbered
from . import binary

#: Records decoded at once.
BLOCK_RECORDS = 1 << 18
#: Rows of ``lineitem`` that a task makes edges of.
ITEMS = 250_000
RECORD = np.dtype([("src", "<i4"), ("dst", "<i4"), ("weight", "<f4")])


def _decoded(batches):
    for b in batches:
        for data in b.column(0).to_pylist():
            e = np.frombuffer(data, RECORD)
            yield pa.RecordBatch.from_arrays([pa.array(e["src"]), pa.array(e["dst"]), pa.array(e["weight"].astype(np.float64))], ["src", "dst", "weight"])


def read_binary_edges(spark: SparkSession, path: str, records: int | None = None) -> DataFrame:
    """Edges from files of 12-byte little-endian records (int32, int32, float32). One large
    file is split over tasks, ``records`` each; a partial last record is an error. In a store that
    Arrow can't open, Spark reads the records, which are joined to blocks and decoded by columns."""
    if binary.arrow_opens(path):
        binary.register(spark)
        return spark.read.format(binary.NAME).options(**({"records": records} if records else {})).load(path)

    def blocks(records):
        while block := b"".join(itertools.islice(records, BLOCK_RECORDS)):
            yield (bytearray(block),)

    records = spark.sparkContext.binaryRecords(path, RECORD.itemsize)
    return spark.createDataFrame(records.mapPartitions(blocks), "content binary").mapInArrow(_decoded, EDGE_SCHEMA)


def write_binary_edges(graph: Graph, path: str) -> None:
    """Files of such records, one for each task; weights are rounded to 32 bits."""
    binary.register(graph.spark)
    graph.edges.write.format(binary.NAME).mode("append").save(path)


def read_binary_folder(spark: SparkSession, path: str) -> DataFrame:
    """The same from many moderate files, each decoded whole in one Arrow batch."""
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(_decoded, EDGE_SCHEMA)


def read_text_edges(spark: SparkSession, path: str, zero_weight: str = "keep") -> DataFrame:
    """Edges from lines ``src dst [weight]``; # starts a comment, the weight defaults to 1.
    ``zero_weight``: keep, drop or error for edges of weight 0."""
    parts = F.split(F.trim("value"), r"\s+")
    lines = spark.read.text(path).filter(~F.col("value").rlike(r"^\s*(#|$)"))
    edges = lines.select(F.get(parts, 0).cast("int").alias("src"), F.get(parts, 1).cast("int").alias("dst"), F.coalesce(F.get(parts, 2).cast("double"), F.lit(1.0)).alias("weight"))
    if zero_weight == "drop":
        return edges.filter("weight != 0")
    if zero_weight == "error":
        return edges.withColumn("weight", F.when(F.col("weight") == 0, F.raise_error(F.lit("an edge has weight 0")).cast("double")).otherwise(F.col("weight")))
    if zero_weight != "keep":
        raise ValueError("zero_weight must be keep, drop or error")
    return edges


def read_adjacency(spark: SparkSession, path: str, weighted: bool = True, relabel: bool = True) -> DataFrame:
    """Edges from lines ``id (nbr weight)*``, or ``id nbr*`` where not ``weighted``.

    With ``relabel`` vertices are numbered 0, 1, … in order of their ids' first lines
    (files in name order), and after those neighbours without a line of their own, by id.
    The order doesn't depend on how files are split."""
    line = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    lines = spark.read.text(path).select("value", line.alias("line")).filter(F.trim("value") != "")
    parts = F.split(F.trim("value"), r"\s+")
    rows = lines.select("line", parts.alias("p")).select("line", F.get("p", 0).cast("long").alias("id"), "p")
    width = 2 if weighted else 1
    at = F.sequence(F.lit(0), F.floor((F.size("p") - 1) / width).cast("int") - 1)
    edge = F.transform(at, lambda k: F.struct(F.get("p", 1 + k * width).cast("long").alias("dst"), (F.get("p", 2 + k * width).cast("double") if weighted else F.lit(1.0)).alias("weight")))
    flat = rows.filter(F.size("p") > width).select("id", F.explode(edge).alias("e")).select(F.col("id").alias("src"), "e.dst", "e.weight")
    if not relabel:
        return flat.select(F.col("src").cast("int").alias("src"), F.col("dst").cast("int").alias("dst"), "weight")
    names = rows.groupBy("id").agg(F.min("line").alias("line"))
    ends = flat.select(F.col("dst").alias("id")).distinct().join(names, "id", "left_anti").withColumn("line", F.lit(None).cast(names.schema["line"].dataType))
    names = numbered(names.unionByName(ends), "n", F.asc_nulls_last("line"), "id").select("id", F.col("n").cast("int").alias("n"))
    flat = flat.join(names.withColumnsRenamed({"id": "src", "n": "s"}), "src").join(names.withColumnsRenamed({"id": "dst", "n": "d"}), "dst")
    return flat.select(F.col("s").alias("src"), F.col("d").alias("dst"), "weight")


def read_graph(spark: SparkSession, path: str, kind: str = "edge-list", fmt: str = "binary", **options) -> Graph:
    """A graph by kind (edge-list, adj-list, table) and format (binary, text, parquet, orc, json, csv)."""
    if (kind, fmt) == ("edge-list", "binary"):
        return Graph(read_binary_edges(spark, path))
    if (kind, fmt) == ("edge-list", "text"):
        return Graph(read_text_edges(spark, path, **options))
    if (kind, fmt) == ("adj-list", "text"):
        return Graph(read_adjacency(spark, path, **options))
    if kind == "table" and fmt in ("parquet", "orc", "json", "csv"):
        reader = spark.read.schema(EDGE_SCHEMA) if fmt in ("json", "csv") else spark.read
        return Graph(reader.format(fmt).load(path))
    raise ValueError(f"no reader for {kind} as {fmt}")


def write_text_edges(graph: Graph, path: str) -> None:
    graph.edges.select(F.concat_ws(" ", "src", "dst", "weight").alias("value")).write.text(path)


def write_adjacency(graph: Graph, path: str) -> None:
    """Lines ``id (nbr weight)*`` for every vertex, those without edges too."""
    flat = F.concat_ws(" ", F.transform("nbrs", lambda e: F.concat_ws(" ", e["dst"], e["weight"])))
    rows = graph.vertices.select(F.col("id").alias("vertex")).join(graph.adjacency(), "vertex", "left")
    rows.select(F.concat_ws(" ", F.col("vertex"), F.when(F.size("nbrs") > 0, flat)).alias("value")).write.text(path)


def edges_to_adjacency(edges: DataFrame) -> DataFrame:
    """(vertex, nbrs): each source's distinct neighbours in order, all edges counted."""
    return edges.groupBy(F.col("src").alias("vertex")).agg(F.array_sort(F.collect_set("dst")).alias("nbrs"))


def purchase_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """A bipartite graph from ``lineitem``: suppliers and parts, both directions; an edge's
    weight is 1 plus a quarter for each of the largest quantity's units mod 16."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_suppkey", "l_partkey", "l_quantity")
    last, n = items.agg(F.max("l_suppkey"), F.count("*")).first()
    # hardly a pair comes twice, so rows are dealt to tasks as they are, of a bounded number each
    parts = max(spark.sparkContext.defaultParallelism, -(-n // ITEMS))
    rows = items.select(F.col("l_suppkey").cast("int").alias("a"), (F.col("l_partkey") + last + 1).cast("int").alias("b"), F.col("l_quantity").alias("q")).repartition(parts, "a", "b")
    pairs = rows.groupBy("a", "b").agg(F.max("q").alias("q"))
    weight = 1 + (F.floor("q").cast("int") % 16) / F.lit(4.0)
    both = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst")))).alias("e"), weight.alias("weight"))
    return Graph(both.select("e.src", "e.dst", "weight"))
