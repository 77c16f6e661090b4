"""Points where callers can bring their own parts: columns for scalars, tables for the rest."""

from __future__ import annotations

from typing import Protocol

import numpy as np
from pyspark.sql import Column, DataFrame


class DistanceMetric(Protocol):
    """``functions.vectors.l2`` is one."""

    def __call__(self, a: Column, b: Column) -> Column: ...


class EvictionPolicy(Protocol):
    """Keeps the rows of a cache that stay at a generation; ``operators.select.ttl`` is one."""

    def __call__(self, cache: DataFrame, generation: int) -> DataFrame: ...


class Evaluator(Protocol):
    """Adds ``fitness`` to rows with ``g``; ``operators.evolution.landscape`` is one."""

    def __call__(self, rows: DataFrame) -> DataFrame: ...


class NeighbourStore(Protocol):
    """Nearest stored points of queries; ``operators.neighbors.knn`` is one."""

    def __call__(self, queries: DataFrame, store: DataFrame, k: int) -> DataFrame: ...


class MigrantSelector(Protocol):
    """Who leaves an island; ``operators.select.top_per`` makes one."""

    def __call__(self, population: DataFrame, k: int) -> DataFrame: ...


class TelemetrySink(Protocol):
    """Takes one generation's record; ``sources.files.write_telemetry`` makes one."""

    def __call__(self, record: DataFrame, path: str) -> None: ...


class Surrogate(Protocol):
    """A regression model; ``models.surrogates`` holds four."""

    def fit(self, x: np.ndarray, y: np.ndarray) -> Surrogate: ...

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]: ...
