"""A sampler as an object: load once, sample, fetch in the form that is needed."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .plans.app import SamplingApp
from .plans.apps import uniform_walk
from .plans.engine import SamplingRun, run
from .sources.graphs import read_graph


class Sampler:
    def __init__(self, spark: SparkSession, path: str, kind: str = "edge-list", fmt: str = "binary", app: SamplingApp | None = None, seed: int = 42, strategy: str = "auto"):
        self.graph = read_graph(spark, path, kind, fmt)
        self.app = app or uniform_walk()
        self.seed, self.strategy = seed, strategy
        self._run: SamplingRun | None = None

    def sample(self) -> "Sampler":
        self._run = run(self.graph, self.app, self.seed, self.strategy)
        return self

    @property
    def samples(self) -> DataFrame:
        if self._run is None:
            self.sample()
        return self._run.samples

    def n_samples(self) -> int:
        return self.app.seeds(self.graph).select("sample_id").distinct().count()

    def final_samples(self) -> list[int]:
        """All samples' vertices in one list, for small results: padded with the number of vertices."""
        self.samples  # noqa: B018
        return [v for r in self._run.dense().orderBy("sample_id").toLocalIterator() for v in r.vertices]

    def final_samples_array(self) -> np.ndarray:
        """The same as a matrix, a row for each sample that has vertices."""
        self.samples  # noqa: B018
        got = self._run.dense().orderBy("sample_id").toArrow()
        return got["vertices"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, self.sample_length())

    def sample_length(self) -> int:
        return self.app.final_size()

    def total_length(self) -> int:
        return self.n_samples() * self.app.final_size()

    def close(self) -> None:
        """Frees what the graph's runs have kept; results that aren't computed yet are lost."""
        self.graph.release()
        self._run = None
