"""Operators on a frontier: (sample_id, transit) rows of one step."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import rng
from .graph import Graph
from .scan import exclusive_scan, numbered

#: Output slots of a transit from which a hotter kernel class would take it.
GRID, BLOCK, SUB_WARP = 256, 32, 8


def valid(frontier: DataFrame, n_vertices: int) -> DataFrame:
    """Rows whose transit is a vertex; null, negative and too large ids go."""
    return frontier.filter(F.col("transit").between(0, n_vertices - 1))


def invert(frontier: DataFrame) -> DataFrame:
    """Adds ``place``: a row's number in the order of transits, then samples, so that those at one
    transit stand together; rows without one come last."""
    return numbered(frontier, "place", F.asc_nulls_last("transit"), "sample_id")


def histogram(frontier: DataFrame) -> DataFrame:
    """(transit, n_samples)."""
    return frontier.filter("transit IS NOT NULL").groupBy("transit").agg(F.count("*").alias("n_samples"))


def positions(frontier: DataFrame) -> DataFrame:
    """(transit, n_samples, start): where each transit's group begins in the inverted order."""
    return exclusive_scan(histogram(frontier), "transit", "n_samples", "start")


def kernel_classes(frontier: DataFrame, sub_warp: int = 1) -> DataFrame:
    """(transit, n_samples, class) by how many samples share a transit."""
    work = F.col("n_samples") * sub_warp
    name = F.when(work >= GRID, "grid").when(work >= BLOCK, "block").when(work >= SUB_WARP, "sub_warp").otherwise("identity")
    return histogram(frontier).withColumn("class", name)


def class_report(frontier: DataFrame, graph: Graph, sub_warp: int = 1) -> DataFrame:
    """(class, n_transits, n_samples, max_degree): how the work of a step is spread."""
    own = graph.counted.select(F.col("id").alias("transit"), "degree")
    rows = kernel_classes(frontier, sub_warp).join(own, "transit", "left")
    return rows.groupBy("class").agg(F.count("*").alias("n_transits"), F.sum("n_samples").alias("n_samples"), F.coalesce(F.max("degree"), F.lit(0)).alias("max_degree"))


def sample_parts(seeds: DataFrame, n_samples: int, parts: int) -> DataFrame:
    """Adds ``part``: contiguous ranges of equal size, what is left to the last."""
    width = max(n_samples // parts, 1)
    return seeds.withColumn("part", F.least(F.floor(F.col("sample_id") / width), F.lit(parts - 1)).cast("int"))


def degree_histogram(graph: Graph) -> DataFrame:
    """(bucket, n_vertices): vertices by the power of two below their degree; -1 for none."""
    bucket = F.when(F.col("degree") > 0, F.floor(F.log2("degree"))).otherwise(-1).cast("int")
    return graph.vertices.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n_vertices"))


# ----------------------------------------------------------------- collective

def collective_size(frontier: DataFrame, graph: Graph) -> DataFrame:
    """(sample_id, size, start): edges of all transits of a sample, and those of samples before it."""
    own = graph.degrees.select(F.col("id").alias("transit"), "degree")
    size = frontier.join(own, "transit", "left").groupBy("sample_id").agg(F.coalesce(F.sum("degree"), F.lit(0)).cast("long").alias("size"))
    return exclusive_scan(size, "sample_id", "size", "start")


def collective_edges(frontier: DataFrame, graph: Graph) -> DataFrame:
    """(sample_id, slot, pos, dst, place): a sample's transits' edges one after another;
    ``place`` is the edge's number within the sample."""
    own = graph.degrees.select(F.col("id").alias("transit"), "degree")
    rows = frontier.join(own, "transit")
    before = Window.partitionBy("sample_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("first", F.coalesce(F.sum("degree").over(before), F.lit(0)))
    joined = rows.join(graph.positions, rows["transit"] == graph.positions["src"])
    return joined.select("sample_id", "slot", "pos", "dst", (F.col("first") + F.col("pos")).cast("long").alias("place"))


# ------------------------------------------------------------------- variants

def hop_distinct(samples: DataFrame) -> DataFrame:
    """Each vertex once for each sample and step."""
    return samples.select("sample_id", "step", "vertex").distinct()


def step_overlap(samples: DataFrame, apart: int = 1) -> DataFrame:
    """(sample_id, step, n_shared): vertices of a step that its sample had ``apart`` steps before."""
    # the samples are made and shuffled once: a vertex's steps meet in one row
    steps = samples.groupBy("sample_id", "vertex").agg(F.collect_set("step").alias("steps"))
    shared = steps.select("sample_id", F.explode(F.array_intersect("steps", F.transform("steps", lambda k: k + apart))).alias("step"))
    return shared.groupBy("sample_id", "step").agg(F.count("*").alias("n_shared"))


def without_replacement(frontier: DataFrame, graph: Graph, size: int, seed: int = 42, step: int = 0) -> DataFrame:
    """(sample_id, slot, transit, vertex, pos): ``size`` different edges of each transit, or all. Their
    places are drawn from the degree, so that only they join the edges, and no other edge does."""
    own = graph.degrees.select(F.col("id").alias("transit"), "degree")
    rows = frontier.join(own, "transit").withColumnRenamed("slot", "__slot")
    rows = rows.select("*", F.posexplode(different_places(seed, step, "__slot", F.col("degree"), size)).alias("__j", "pos"))
    found = rows.join(graph.positions.withColumnRenamed("src", "transit"), ["transit", "pos"])
    return found.select("sample_id", (F.col("__slot") * size + F.col("__j")).alias("slot"), "transit", F.col("dst").alias("vertex"), "pos")


def different_places(seed: int, step: int, slot: str, degree: Column, size: int) -> Column:
    """``size`` different places of 0 .. degree - 1, or all, each set as likely: of m places the
    i-th is drawn from the first degree - m + i + 1, and is the last of those if it was taken
    before."""
    m = F.least(F.lit(size), degree)
    drawn = F.array(*[rng.pick(rng.uniform(seed, "sample_id", step, slot, i), degree - m + i + 1) for i in range(size)])
    put = lambda taken, t: F.concat(taken, F.array(F.when(F.array_contains(taken, t), degree - m + F.size(taken)).otherwise(t).cast("int")))
    return F.aggregate(F.slice(drawn, F.lit(1), m), F.array().cast("array<int>"), put)
