"""Tiers of evaluation: cached, predicted or simulated, and what that costs."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import ship
from .neighbors import knn, lookup_exact, usable

#: Distances up to which a neighbour stands for a point, or a prediction does.
EPSILON, RADIUS = 0.005, 0.15


def partition(queries: DataFrame, store: DataFrame, epsilon: float = EPSILON, radius: float = RADIUS) -> DataFrame:
    """``query_id, tier, nn_id, d``: rows see the store as it was before any of them."""
    exact = lookup_exact(queries, store)
    near = knn(queries, store, 1).select("query_id", F.col("store_id").alias("nn_id"), "d")
    tier = F.when(F.col("exact_id").isNotNull() | (F.col("d") < epsilon), "T1").when(F.col("d") <= radius, "T2").otherwise("T3")
    return exact.join(near, "query_id", "left").select("query_id", tier.alias("tier"), "nn_id", "d")


class SeenPoints:
    """The stored points of one run in a hash grid: cells as wide as the radius over the first
    ``dims`` components, so that a point within the radius is in a cell's neighbourhood. Points of
    generations that have aged out are dropped in the order they came."""

    def __init__(self, epsilon: float, radius: float, max_age: int, dims: int = 3):
        self.epsilon, self.radius, self.max_age, self.dims = epsilon, radius, max_age, dims
        self.width = radius * (1 + 1e-9)
        self.cells: dict[tuple, list[np.ndarray]] = {}
        self.order: deque = deque()

    def tier(self, point: np.ndarray, generation: int) -> str:
        """The tier of a point, which is stored if it is the third."""
        while self.order and generation - self.order[0][0] > self.max_age:
            held = self.cells[self.order[0][1]]
            held.pop(0)
            if not held:
                del self.cells[self.order[0][1]]
            self.order.popleft()
        own = tuple(np.floor(point[: self.dims] / self.width).astype(np.int64).tolist())
        near = [p for step in product((-1, 0, 1), repeat=len(own)) for p in self.cells.get(tuple(map(sum, zip(own, step))), ())]
        if near:
            stored, d = np.array(near), np.zeros(len(near))
            for dim in range(stored.shape[1]):  # in order, as a plain loop sums
                d += (stored[:, dim] - point[dim]) ** 2
            least = d.min()
            if least <= self.radius**2:
                return "T1" if least < self.epsilon**2 else "T2"
        self.cells.setdefault(own, []).append(point)
        self.order.append((generation, own))
        return "T3"


def replay(points: DataFrame, run: str, generation: str, tie: str, vector: str, dims: int, max_age: int, epsilon: float = EPSILON, radius: float = RADIUS) -> DataFrame:
    """``run, tie, tier`` when every point of a run sees the stored ones before it, in the order of
    generation and ``tie``, of which those more than ``max_age`` generations old are gone.

    Runs are dealt out by hash and sorted, and a task reads them batch by batch: what it holds are
    the stored points of one run's last generations. A vector that is null, not finite or not of
    ``dims`` components is of the third tier and isn't stored.
    """
    ship(points.sparkSession)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, seen = object(), None
        for batch in batches:
            ok = batch.column("ok").to_numpy(zero_copy_only=False)
            vectors = np.full((batch.num_rows, dims), np.nan)
            vectors[ok] = batch.column("v").filter(batch.column("ok")).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            tiers = []
            for key, gen, good, point in zip(batch.column("run").to_pylist(), batch.column("gen").to_pylist(), ok.tolist(), vectors):
                if key != current:
                    current, seen = key, SeenPoints(epsilon, radius, max_age)
                tiers.append(seen.tier(point, gen) if good else "T3")
            yield pa.record_batch([batch.column("run"), batch.column("tie"), pa.array(tiers, pa.string())], [run, tie, "tier"])

    ok = (usable(vector) & (F.size(vector) == dims)).alias("ok")
    rows = points.select(F.col(run).alias("run"), F.coalesce(F.col(generation), F.lit(0)).cast("long").alias("gen"), F.col(tie).alias("tie"), F.col(vector).cast("array<double>").alias("v"), ok)
    ordered = rows.repartition("run").sortWithinPartitions("run", "gen", "tie")
    types = dict(points.dtypes)
    return ordered.mapInArrow(fold, f"{run} {types[run]}, {tie} {types[tie]}, tier string")


def ratio(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, 0.0).otherwise(part / whole)


def metrics(tiers: DataFrame) -> DataFrame:
    """Counts and shares of the tiers; shares are 0 when there is nothing."""
    counts = tiers.agg(*(F.count_if(F.col("tier") == t).alias(t.lower()) for t in ("T1", "T2", "T3")), F.count("*").alias("total"))
    shares = [ratio(F.col(t), F.col("total")).alias(f"{t}_ratio") for t in ("t1", "t2", "t3")]
    return counts.select("*", *shares, ratio(F.col("t1") + F.col("t2"), F.col("total")).alias("bypass_ratio"))


def deltas(counters: DataFrame, order: str, columns: list[str], partition: list[str]) -> DataFrame:
    """Growth of cumulative counters per step, never negative."""
    w = Window.partitionBy(*partition).orderBy(order)
    return counters.select(*partition, order, *(F.greatest(F.col(c) - F.coalesce(F.lag(c).over(w), F.lit(0)), F.lit(0)).alias(f"{c}_delta") for c in columns))


def cost_model(counts: DataFrame, t1_us: float = 80.0, t2_us: float = 20.0, t3_ms: float = 200.0) -> DataFrame:
    """Milliseconds of a run with one, two or three tiers, from its counts."""
    one = F.col("total") * t3_ms
    two = F.col("total") * t1_us / 1000 + (F.col("t2") + F.col("t3")) * t3_ms
    three = F.col("total") * t1_us / 1000 + F.col("t2") * t2_us / 1000 + F.col("t3") * t3_ms
    return counts.select(one.alias("one_tier_ms"), two.alias("two_tier_ms"), three.alias("three_tier_ms"), ratio(one, three).alias("speedup"))


def cumulative(counts: DataFrame, order: str) -> DataFrame:
    """Evaluations run so far against the naive number, and the share saved."""
    w = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    run = counts.select(order, F.sum("t3").over(w).alias("actual"), F.sum("total").over(w).alias("naive"))
    return run.select("*", (100.0 * (1.0 - ratio(F.col("actual").cast("double"), F.col("naive").cast("double")))).alias("saved_percent"))
