"""Samples for a stream of seeds over a static graph.

Each micro-batch of (sample_id, vertex) rows is sampled like a batch; draws depend on
sample_id alone, so a replayed batch gives the same rows, and the sink, partitioned by
batch, is overwritten rather than doubled.
"""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.graph import Graph
from ..plans.app import SamplingApp
from ..plans.engine import run


def sample_stream(seeds: DataFrame, graph: Graph, app: SamplingApp, path: str, checkpoint: str, seed: int = 42, strategy: str = "auto", **trigger) -> StreamingQuery:
    """Starts a query that writes the samples of each micro-batch to ``path/batch=k``."""

    def each(batch: DataFrame, number: int) -> None:
        own = batch.select(F.col("sample_id").cast("long").alias("sample_id"), F.lit(0).alias("slot"), F.col("vertex").cast("int").alias("transit"))
        found = run(graph, dataclasses.replace(app, seeds=lambda _: own), seed, strategy).samples
        found.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return seeds.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
