"""A random forest and a perceptron that are trained where the rows are.

The driver holds the models alone: trees with their cuts, or weights. Rows stay with the
executors, whose tasks send sums: histograms of a level's nodes for the forest, gradients for the
perceptron. Rows with a null target, or a vector that is null, of another length than the
commonest or not finite, aren't trained on.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.neighbors import usable
from ..operators.stats import scaler
from ..session import ship, stored
from .surrogates import Adam, Perceptron, Scaler

#: Sums that a task holds for the nodes of one pass over the rows.
SUMS = 1 << 20
#: Tasks whose gradients the driver adds up itself; those of more are first added up by Spark.
TASKS = 32
#: The distribution function of a Poisson variable of mean 1: how often a row is drawn for a tree.
POISSON = np.cumsum(np.exp(-1.0) / np.cumprod(np.concatenate(([1.0], np.arange(1.0, 16.0)))))


def _training(df: DataFrame, vector: str, target: str, key: str) -> tuple[DataFrame, int]:
    """``v, y, h`` of the rows that can be trained on, and the vectors' length."""
    ship(df.sparkSession)
    rows = df.filter(F.col(target).isNotNull() & ~F.isnan(F.col(target).cast("double")) & usable(vector)).select(F.col(vector).cast("array<double>").alias("v"), F.col(target).cast("double").alias("y"), F.xxhash64(key).alias("h"))
    common = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if common is None:
        raise ValueError("no row can be trained on")
    return rows.filter(F.size("v") == common["n"]), common["n"]


def _matrix(batch: pa.RecordBatch, name: str, width: int) -> np.ndarray:
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width)


def _mixed(x: np.ndarray) -> np.ndarray:
    """Uniform 64-bit values from distinct ones (xor-shift and multiply)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class TableForest:
    """Variance-reduction trees over a table of any size, grown level by level.

    Features are cut at quantiles of the whole table. In every tree a row counts as often as a
    Poisson variable, made of a hash of its key, says. A pass sums weight, target and its square
    by node, feature and bin in each task, and Spark adds up the tasks' sums; the best cut of each node
    comes to the driver, which is as large as the forest. A level whose sums are many takes more
    than one pass, a share of its nodes each.
    """

    trees: int = 150
    depth: int = 12
    features: int = 3
    bins: int = 32
    seed: int = 42
    least: int = 4

    def fit(self, df: DataFrame, vector: str, target: str, key: str) -> TableForest:
        rows, self.width = _training(df, vector, target, key)
        shares = [i / self.bins for i in range(1, self.bins)]
        cuts = rows.select(F.posexplode("v").alias("dim", "x")).groupBy("dim").agg(F.percentile_approx("x", shares, 10_000).alias("e")).collect()  # a row a feature
        self.edges = [np.unique(r["e"]) for r in sorted(cuts, key=lambda r: r["dim"])]
        edges, width = self.edges, self.width

        def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                codes = self.codes(_matrix(batch, "v", width)) if batch.num_rows else np.zeros((0, width), np.uint8)
                yield pa.record_batch([pa.array([c.tobytes() for c in codes], pa.binary()), batch.column("y"), batch.column("h")], ["codes", "y", "h"])

        assert len(edges) == width and self.bins <= 256
        coded = stored(rows.mapInArrow(code, "codes binary, y double, h long"), "forest-rows")
        # of each tree's nodes: feature (-1 for a leaf), last bin of the left side, left child, mean
        self.feature, self.cut, self.left, self.value = ([[x] for _ in range(self.trees)] for x in (-1, 0, 0, 0.0))
        frontier = [(t, 0) for t in range(self.trees)]
        each = max(1, SUMS // (min(self.features, width) * self.bins * 3))
        for level in range(self.depth):
            following = []
            self._pack()
            for at in range(0, len(frontier), each):
                following += self._grow(coded, frontier[at : at + each], level)
            frontier = following
            if not frontier:
                break
        self._pack()
        return self

    def codes(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(self.edges)], 1).astype(np.uint8)

    def _pack(self) -> None:
        """The trees as arrays, one row each."""
        n = max(map(len, self.feature))
        kinds = ((self.feature, -1, np.int16 if self.width < 1 << 15 else np.int32), (self.cut, 0, np.uint8), (self.left, 0, np.int32), (self.value, 0.0, np.float64))
        self.nodes = [np.array([t + [fill] * (n - len(t)) for t in lists], kind) for lists, fill, kind in kinds]

    def __getstate__(self) -> dict:
        """What tasks get: the packed trees. The lists that the driver grows would take several
        times the room in every worker, an object for each number."""
        return {k: v for k, v in self.__dict__.items() if k not in ("feature", "cut", "left", "value")}

    def _node(self, codes: np.ndarray, trees: np.ndarray, levels: int) -> np.ndarray:
        """The node of every row in each of some trees."""
        feature, cut, left, _ = self.nodes
        at, t, rows = np.zeros((len(trees), len(codes)), np.int64), trees[:, None], np.arange(len(codes))
        for _ in range(levels):
            f = feature[t, at]
            right = codes[rows, np.maximum(f, 0)] > cut[t, at]
            at = np.where(f >= 0, left[t, at] + right, at)
        return at

    def _chosen(self, tree: np.ndarray, node: np.ndarray) -> np.ndarray:
        """The features that a node may be cut by."""
        ids = (np.uint64(self.seed) << np.uint64(56)) ^ (tree.astype(np.uint64) << np.uint64(40)) ^ (node.astype(np.uint64) << np.uint64(16))
        order = _mixed(ids[:, None] + np.arange(1, self.width + 1, dtype=np.uint64))
        return np.argsort(order, axis=1)[:, : min(self.features, self.width)]

    def _grow(self, coded: DataFrame, frontier: list[tuple[int, int]], level: int) -> list[tuple[int, int]]:
        tree, node = (np.array(x) for x in zip(*frontier))
        chosen, bins, width = self._chosen(tree, node), self.bins, self.width
        trees = np.unique(tree)
        place = np.full((len(trees), self.nodes[0].shape[1]), -1, np.int32)
        place[np.searchsorted(trees, tree), node] = np.arange(len(tree))
        salt = _mixed(np.uint64(self.seed) + trees.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        k = chosen.shape[1]

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((3, len(tree) * k * bins))
            for batch in batches:
                step = max(1, (1 << 18) // len(trees))
                for at in range(0, batch.num_rows, step):
                    part = batch.slice(at, step)
                    codes = np.frombuffer(b"".join(part.column("codes").to_pylist()), np.uint8).reshape(-1, width)
                    y, h = part.column("y").to_numpy(), part.column("h").to_numpy().view(np.uint64)
                    drawn = np.searchsorted(POISSON, _mixed(h[None, :] ^ salt[:, None]) / 2.0**64, side="right")
                    own = place[np.arange(len(trees))[:, None], self._node(codes, trees, level)]
                    _, row = np.nonzero((own >= 0) & (drawn > 0))
                    on = (own >= 0) & (drawn > 0)
                    own, w = own[on], drawn[on].astype(float)
                    for j in range(k):
                        cell = (own * k + j) * bins + codes[row, chosen[own, j]]
                        for i, v in enumerate((w, w * y[row], w * y[row] ** 2)):
                            total[i] += np.bincount(cell, v, total.shape[1])
            cell = np.flatnonzero(total[0])
            for at in range(0, len(cell), 10_000):
                c = cell[at : at + 10_000]
                yield pa.record_batch([pa.array(c // (k * bins)), pa.array(c // bins % k), pa.array(c % bins), *(pa.array(t[c]) for t in total)], ["place", "j", "bin", "w", "wy", "wyy"])

        cells = coded.mapInArrow(sums, "place long, j long, bin long, w double, wy double, wyy double").groupBy("place", "j", "bin").agg(*(F.sum(c).alias(c) for c in ("w", "wy", "wyy")))
        own = Window.partitionBy("place", "j")
        below = own.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)  # bins at most
        lists = cells.select("place", "j", "bin", *(F.sum(c).over(below).alias(f"l_{c}") for c in ("w", "wy", "wyy")), *(F.sum(c).over(own).alias(f"t_{c}") for c in ("w", "wy", "wyy")))
        ratio = lambda wy, w: F.when(w > 0, wy * wy / w).otherwise(0.0)
        gain = ratio(F.col("l_wy"), F.col("l_w")) + ratio(F.col("t_wy") - F.col("l_wy"), F.col("t_w") - F.col("l_w")) - ratio(F.col("t_wy"), F.col("t_w"))
        both = (F.col("l_w") > 0) & (F.col("l_w") < F.col("t_w"))
        order = F.struct(F.when(both, gain).otherwise(-1.0), -F.col("j"), -F.col("bin"))
        best = lists.groupBy("place").agg(F.max_by(F.struct("*", gain.alias("gain"), both.alias("both")), order).alias("b")).select("b.*").collect()  # a row a node
        following = []
        for r in sorted(best, key=lambda r: r["place"]):
            t, n = frontier[r["place"]]
            self.value[t][n] = r["t_wy"] / r["t_w"]
            if r["both"] and r["gain"] > 1e-12:
                at = len(self.feature[t])
                self.feature[t][n], self.cut[t][n], self.left[t][n] = int(chosen[r["place"], r["j"]]), int(r["bin"]), at
                for side in ("l", "r"):
                    w, wy, wyy = ((r["l_" + c] if side == "l" else r["t_" + c] - r["l_" + c]) for c in ("w", "wy", "wyy"))
                    for lists_, x in ((self.feature, -1), (self.cut, 0), (self.left, 0), (self.value, wy / w)):
                        lists_[t].append(x)
                    if w >= self.least and wyy / w - (wy / w) ** 2 > 1e-12:
                        following.append((t, at + (side == "r")))
        return following

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        trees = np.arange(self.trees)
        each = self.nodes[3][trees[:, None], self._node(self.codes(x), trees, self.depth)]
        return each.mean(0), each.var(0)


@dataclass
class TablePerceptron(Perceptron):
    """The perceptron by full-batch Adam over a table of any size: each step, tasks sum their rows'
    gradients, Spark adds up the tasks' sums, and the driver moves the weights."""

    def fit(self, df: DataFrame, vector: str, target: str, key: str, losses: list[float] | None = None) -> TablePerceptron:
        rows, width = _training(df, vector, target, key)
        stats = sorted(scaler(rows, "v").collect(), key=lambda r: r["dim"])  # a row a feature
        self.x_scaler = Scaler(np.array([r["mean"] for r in stats]), np.array([r["std"] for r in stats]))
        own = scaler(rows.select(F.array("y").alias("y")), "y").first()
        self.y_scaler = Scaler(np.array(own["mean"]), np.array(own["std"]))
        self.begin(width, np.random.default_rng(self.seed))
        step, shapes = Adam([*self.w, *self.b], self.rate), [p.shape for p in (*self.w, *self.b)]
        ends = np.cumsum([int(np.prod(s)) for s in shapes])
        held = stored(rows.select("v", "y"), "perceptron-rows")

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(ends[-1] + 2)
            for batch in batches:
                if batch.num_rows:
                    x, y = self.x_scaler.transform(_matrix(batch, "v", width)), self.y_scaler.transform(batch.column("y").to_numpy())
                    error = self._forward(x)[0][-1][:, 0] - y
                    total += np.concatenate([*(g.ravel() for g in self.gradients(x, y)), [error @ error, len(y)]])
            yield pa.record_batch([pa.array(np.arange(len(total))), pa.array(total)], ["i", "g"])

        few = held.rdd.getNumPartitions() <= TASKS
        for _ in range(self.epochs):
            parts = held.mapInArrow(sums, "i long, g double")
            added = (parts if few else parts.groupBy("i").agg(F.sum("g").alias("g"))).toArrow()  # a row a weight, of TASKS at most
            g = np.bincount(added.column("i").to_numpy(), added.column("g").to_numpy(), ends[-1] + 2)
            if losses is not None:
                losses.append(g[-2] / g[-1])
            parts = [p.reshape(s) for p, s in zip(np.split(g[:-2], ends[:-1]), shapes)]
            step([p / g[-1] + d for p, d in zip(parts, self.shrinkage())])
        return self
