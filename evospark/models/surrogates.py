"""Gaussian process, k-nearest neighbours, random forest and multi-layer perceptron.

Training sets of the online models and of every Gaussian process are bounded by the sliding window
(a thousand rows); a fit runs on the driver, or in one task for each candidate of a search, and
predictions run over tables of any size in Arrow batches. Every model offers ``fit(x, y)`` and ``predict(x) -> (mean, variance)``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship, stored


@dataclass
class Scaler:
    """Mean and population deviation; a deviation of up to 1e-8 becomes 1."""

    mean: np.ndarray = field(default_factory=lambda: np.zeros(1))
    std: np.ndarray = field(default_factory=lambda: np.ones(1))

    def fit(self, x: np.ndarray) -> Scaler:
        s = x.std(axis=0)
        self.mean, self.std = x.mean(axis=0), np.where(s > 1e-8, s, 1.0)
        return self

    def transform(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) / self.std


def matern52(a: np.ndarray, b: np.ndarray, scales: np.ndarray, variance: float) -> np.ndarray:
    a, b = a / scales, b / scales
    squares = (a * a).sum(1)[:, None] + (b * b).sum(1) - 2.0 * a @ b.T  # no table of differences
    s = np.sqrt(5.0 * np.maximum(squares, 0.0))
    return variance * (1.0 + s + s * s / 3.0) * np.exp(-s)


def cholesky(a: np.ndarray) -> np.ndarray:
    """Lower factor; a pivot of up to 1e-14 is an error."""
    try:
        low = np.linalg.cholesky(a)
    except np.linalg.LinAlgError as e:
        raise ValueError("the matrix isn't positive definite") from e
    if (np.diag(low) ** 2 <= 1e-14).any():
        raise ValueError("the matrix isn't positive definite")
    return low


#: Rows whose kernel with the training set is held at once for means alone.
MEANS = 128


@dataclass
class GaussianProcess:
    scales: np.ndarray | None = None
    variance: float = 1.0
    noise: float = 1e-3

    def fit(self, x: np.ndarray, y: np.ndarray) -> GaussianProcess:
        self.width = x.shape[1]
        self.x_scaler, self.y_scaler = Scaler().fit(x), Scaler().fit(y)
        self.x, z = self.x_scaler.transform(x), self.y_scaler.transform(y)
        if self.scales is None:
            self.scales = np.full(x.shape[1], np.sqrt(x.shape[1]))
        k = matern52(self.x, self.x, self.scales, self.variance) + self.noise * np.eye(len(x))
        self.low = cholesky(k)
        half = np.linalg.solve(self.low, z)
        self.alpha = np.linalg.solve(self.low.T, half)
        self.log_likelihood = float(-0.5 * half @ half - np.log(np.diag(self.low)).sum() - 0.5 * len(x) * np.log(2 * np.pi))
        return self

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k = matern52(self.x_scaler.transform(x), self.x, self.scales, self.variance)
        v = np.linalg.solve(self.low, k.T)
        var = np.maximum(self.variance - (v * v).sum(0), 0.0)
        return k @ self.alpha * self.y_scaler.std + self.y_scaler.mean, var * self.y_scaler.std**2

    def mean(self, x: np.ndarray) -> np.ndarray:
        """``predict``'s mean alone: the variance costs a solve of n squared a row. The kernel is made in
        place, a piece that stays in the processor's cache at a time."""
        b = self.x / self.scales
        # one product with [a, a a, 1] gives 5 times the squared distances
        ends = 5.0 * np.vstack([-2.0 * b.T, np.ones(len(b)), (b * b).sum(1)])
        out = np.empty(len(x))
        for at in range(0, len(x), MEANS):
            a = self.x_scaler.transform(x[at : at + MEANS]) / self.scales
            s = np.column_stack([a, (a * a).sum(1), np.ones(len(a))]) @ ends
            np.sqrt(np.maximum(s, 0.0, out=s), out=s)
            k = s / 3.0
            k += 1.0
            k *= s
            k += 1.0
            k *= np.exp(np.negative(s, out=s), out=s)
            out[at : at + MEANS] = k @ self.alpha
        return out * (self.variance * self.y_scaler.std) + self.y_scaler.mean


@dataclass
class Neighbours:
    k: int = 5

    def fit(self, x: np.ndarray, y: np.ndarray) -> Neighbours:
        self.scaler, self.width = Scaler().fit(x), x.shape[1]
        self.x, self.y = self.scaler.transform(x), y
        return self

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        step = max(1, 4_000_000 // self.x.size)  # differences of 32 MB at once
        if len(x) > step:
            each = [self.predict(x[at : at + step]) for at in range(0, len(x), step)]
            return np.concatenate([m for m, _ in each]), np.concatenate([v for _, v in each])
        d = np.sqrt(((self.scaler.transform(x)[:, None, :] - self.x[None]) ** 2).sum(-1))
        near = np.argsort(d, axis=1, kind="stable")[:, : self.k]
        dist = np.take_along_axis(d, near, 1)
        w = 1.0 / (dist + 1e-12)
        return (w * self.y[near]).sum(1) / w.sum(1), dist.mean(1)


@dataclass
class RandomForest:
    """Bootstrapped variance-reduction trees; the variance is that between trees."""

    trees: int = 150
    depth: int = 12
    features: int = 3
    thresholds: int = 32
    seed: int = 42

    def _grow(self, x, y, rng, depth):
        if depth == 0 or len(y) < 4 or y.std() < 1e-12:
            return float(y.mean())
        z = y - y.mean()
        best, found = z @ z - 1e-12, None
        for f in rng.choice(x.shape[1], min(self.features, x.shape[1]), replace=False):
            order = np.argsort(x[:, f], kind="stable")
            cuts = np.unique(np.quantile(x[:, f], np.linspace(0.03, 0.97, self.thresholds)))
            n = np.searchsorted(x[order, f], cuts, side="right")
            cuts, n = cuts[(n > 0) & (n < len(y))], n[(n > 0) & (n < len(y))]
            if len(n):
                low = np.cumsum(z[order])[n - 1]  # the rest sums to minus this
                sse = z @ z - low * low / n - low * low / (len(y) - n)
                if sse.min() < best:
                    best, found = sse.min(), (f, cuts[sse.argmin()])
        if found is None:
            return float(y.mean())
        f, cut = found
        low = x[:, f] <= cut
        return (int(f), float(cut), self._grow(x[low], y[low], rng, depth - 1), self._grow(x[~low], y[~low], rng, depth - 1))

    def fit(self, x: np.ndarray, y: np.ndarray) -> RandomForest:
        rng, self.width = np.random.default_rng(self.seed), x.shape[1]
        self.roots = []
        for _ in range(self.trees):
            own = rng.integers(0, len(y), len(y))
            self.roots.append(self._grow(x[own], y[own], rng, self.depth))
        return self

    def _walk(self, node, x):
        if not isinstance(node, tuple):
            return np.full(len(x), node)
        f, cut, low, high = node
        left = x[:, f] <= cut
        out = np.empty(len(x))
        out[left], out[~left] = self._walk(low, x[left]), self._walk(high, x[~left])
        return out

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        each = np.stack([self._walk(r, x) for r in self.roots])
        return each.mean(0), each.var(0)


class Adam:
    """Steps of the parameters, in place, from their gradients."""

    def __init__(self, params: list[np.ndarray], rate: float):
        self.params, self.rate, self.t = params, rate, 0
        self.m, self.v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]

    def __call__(self, gradients: list[np.ndarray]) -> None:
        self.t += 1
        for k, (p, g) in enumerate(zip(self.params, gradients)):
            self.m[k] = 0.9 * self.m[k] + 0.1 * g
            self.v[k] = 0.999 * self.v[k] + 0.001 * g * g
            p -= self.rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.999**self.t)) + 1e-8)


@dataclass
class Perceptron:
    """Two hidden layers with SiLU, trained by Adam with an L2 term in the gradient."""

    hidden: tuple[int, ...] = (64, 32)
    epochs: int = 300
    rate: float = 1e-2
    decay: float = 1e-4
    batch: int = 64
    seed: int = 42

    def fit(self, x: np.ndarray, y: np.ndarray) -> Perceptron:
        rng, self.width = np.random.default_rng(self.seed), x.shape[1]
        self.x_scaler, self.y_scaler = Scaler().fit(x), Scaler().fit(y)
        x, y = self.x_scaler.transform(x), self.y_scaler.transform(y)
        self.begin(x.shape[1], rng)
        step = Adam([*self.w, *self.b], self.rate)
        for _ in range(self.epochs):
            order = rng.permutation(len(y))
            for at in range(0, len(y), self.batch):
                own = order[at : at + self.batch]
                step([g / len(own) + d for g, d in zip(self.gradients(x[own], y[own]), self.shrinkage())])
        return self

    def begin(self, width: int, rng: np.random.Generator) -> None:
        sizes = [width, *self.hidden, 1]
        self.width = width
        self.w = [rng.normal(0, np.sqrt(2 / a), (a, b)) for a, b in zip(sizes, sizes[1:])]
        self.b = [np.zeros(n) for n in sizes[1:]]

    def gradients(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        """Sums over rows of the squared error's gradient, weights first."""
        hs, zs = self._forward(x)
        delta = 2 * (hs[-1][:, 0] - y)[:, None]
        gw, gb = [], []
        for k in range(len(self.w) - 1, -1, -1):
            gw.append(hs[k].T @ delta)
            gb.append(delta.sum(0))
            if k:
                s = 1 / (1 + np.exp(-zs[k - 1]))
                delta = (delta @ self.w[k].T) * (s * (1 + zs[k - 1] * (1 - s)))
        return [*gw[::-1], *gb[::-1]]

    def shrinkage(self) -> list[np.ndarray | float]:
        """What the L2 term adds to each gradient: biases aren't shrunk."""
        return [*(self.decay * w for w in self.w), *(0.0 for _ in self.b)]

    def _forward(self, x):
        hs, zs = [x], []
        for k, (w, b) in enumerate(zip(self.w, self.b)):
            z = hs[-1] @ w + b
            zs.append(z)
            hs.append(z / (1 + np.exp(-z)) if k < len(self.w) - 1 else z)
        return hs, zs

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        out = self._forward(self.x_scaler.transform(x))[0][-1][:, 0]
        return out * self.y_scaler.std + self.y_scaler.mean, np.zeros(len(x))


MODELS = {"gp": GaussianProcess, "knn": Neighbours, "rf": RandomForest, "mlp": Perceptron}


def metrics(y: np.ndarray, p: np.ndarray) -> dict[str, float]:
    """R2, RMSE, MAE and the largest residual; zeros without rows, R2 0 without variation."""
    if not len(y):
        return {"r2": 0.0, "rmse": 0.0, "mae": 0.0, "max_residual": 0.0}
    e, total = y - p, ((y - y.mean()) ** 2).sum()
    return {"r2": float(1 - (e**2).sum() / total) if total > 1e-12 else 0.0, "rmse": float(np.sqrt((e**2).mean())), "mae": float(np.abs(e).mean()), "max_residual": float(np.abs(e).max())}


def split(n: int, seed: int = 42) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.random.default_rng(seed).permutation(n)
    a, b = n * 6 // 10, n * 2 // 10
    return order[:a], order[a : a + b], order[a + b :]


def train(model, x: np.ndarray, y: np.ndarray):
    """With 15 rows or more on 60 %, with metrics of the validation fifth; with 5 or more on all;
    fewer are an error."""
    if len(y) < 5:
        raise ValueError("at least five rows are needed")
    if len(y) < 15:
        return model.fit(x, y), None
    a, b, _ = split(len(y))
    model.fit(x[a], y[a])
    return model, metrics(y[b], model.predict(x[b])[0])


# Fixed values of the search: isotropic starts, factors of a step for scales and signal and for the
# noise, bounds of each, and the gain in likelihood that counts.
STARTS = (0.5, 1.0, 2.0, 3.5, 5.0)
FACTORS = (0.5, 0.72, 0.88, 0.96, 1.04, 1.14, 1.38, 2.0)
NOISE_FACTORS = (0.3, 0.6, 0.85, 1.15, 1.6, 3.0)
SCALE_BOUNDS, SIGNAL_BOUNDS, NOISE_BOUNDS = (0.05, 50.0), (0.05, 30.0), (1e-6, 0.5)
LEAST_GAIN = 1e-4


def likelihoods(spark: SparkSession, points: list[list[float]], x: np.ndarray, y: np.ndarray) -> list[tuple[list[float], float]]:
    """Points (a scale a dimension, signal variance, noise variance) with their log likelihood, best
    first; minus infinity where the matrix isn't positive definite. One job, two points a task."""
    ship(spark)

    def score(point: list[float]) -> float:
        try:
            return GaussianProcess(np.array(point[:-2]), point[-2], point[-1]).fit(x, y).log_likelihood
        except ValueError:
            return -np.inf

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scored = [score(p) for p in batch.column("point").to_pylist()]
            yield pa.record_batch([batch.column("at"), pa.array(scored, pa.float64())], ["at", "ll"])

    table = spark.createDataFrame(list(enumerate(points)), "at int, point array<double>").repartition(max(1, len(points) // 2))
    rows = table.mapInArrow(run, "at int, ll double").orderBy(F.desc("ll"), "at").collect()
    return [(points[r["at"]], r["ll"]) for r in rows]


def moves(point: list[float], tuned: tuple[str, ...]) -> list[tuple[int, list[float]]]:
    """Each tuned parameter times each of its factors, within its bounds, with the parameter's number."""
    d = len(point) - 2
    kinds = [("scales", FACTORS, SCALE_BOUNDS)] * d + [("signal", FACTORS, SIGNAL_BOUNDS), ("noise", NOISE_FACTORS, NOISE_BOUNDS)]
    out = []
    for k, (kind, factors, (low, high)) in enumerate(kinds):
        if kind in tuned:
            out += [(k, [*point[:k], min(max(point[k] * f, low), high), *point[k + 1 :]]) for f in factors]
    return out


def optimize_gp(spark: SparkSession, x: np.ndarray, y: np.ndarray, starts: tuple[float, ...] = STARTS, sweeps: int = 15, tuned: tuple[str, ...] = ("scales", "signal", "noise")) -> GaussianProcess:
    """Length scales, signal variance and noise variance by likelihood, as one space.

    Isotropic starts are a table of points. A sweep is two: every factor of every parameter from the
    best point so far; then the best moves of the parameters that gain, taken together, from the
    best one alone to all of them. The search ends when no single move gains, or after ``sweeps``."""
    width = x.shape[1]
    point, top = likelihoods(spark, [[s] * width + [1.0, 1e-3] for s in starts], x, y)[0]
    for _ in range(sweeps):
        tried = moves(point, tuned)
        owner = {tuple(p): k for k, p in tried}
        gains: dict[int, float] = {}  # parameter to its best value, best parameter first
        single = likelihoods(spark, [p for _, p in tried], x, y)
        for p, ll in single:
            if ll > top + LEAST_GAIN:
                gains.setdefault(owner[tuple(p)], p[owner[tuple(p)]])
        if not gains:
            break
        joint, together = list(point), []
        for k, value in gains.items():
            joint[k] = value
            together.append(list(joint))
        point, top = max([single[0], *likelihoods(spark, together[1:], x, y)] if together[1:] else [single[0]], key=lambda r: r[1])
    return GaussianProcess(np.array(point[:-2]), point[-2], point[-1]).fit(x, y)


def predict(df: DataFrame, model, vector: str = "g", keep: tuple[str, ...] = ()) -> DataFrame:
    """``df``'s ``keep`` columns with ``mean`` and ``variance`` for every vector; both are null where
    the vector is null, of another length than the model's or holds what isn't finite."""
    spark = ship(df.sparkSession)
    shared = spark.sparkContext.broadcast(model)  # a window of a thousand rows, or its weights
    fields = df.select(*keep).schema.simpleString()[len("struct<") : -1].replace(":", " ")
    width = getattr(model, "width", None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                known, x = matrix(part.column(vector), width)
                mean, var = np.zeros(part.num_rows), np.zeros(part.num_rows)
                if len(x):
                    mean[known], var[known] = shared.value.predict(x)
                yield pa.record_batch([*(part.column(c) for c in keep), pa.array(mean, mask=~known), pa.array(var, mask=~known)], [*keep, "mean", "variance"])

    return df.select(*dict.fromkeys([*keep, vector])).mapInArrow(run, f"{fields}, mean double, variance double")


def matrix(column: pa.Array, width: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Which rows hold a finite vector of ``width`` (of the first row that has one, if None), and these."""
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # a null component is NaN
    finite = np.add.reduceat(np.append(~np.isfinite(flat), False), np.minimum(np.cumsum(lengths) - lengths, len(flat))) == 0
    known = (lengths > 0) & finite
    width = width or (int(lengths[known][0]) if known.any() else 0)
    known &= lengths == width
    starts = (np.cumsum(lengths) - lengths)[known]
    return known, flat[starts[:, None] + np.arange(width)] if known.any() else np.zeros((0, width))


#: Copies of equal rows that a task numbers at once.
COPIES = 4_096


def permuted(df: DataFrame, target: str, vector: str, repeats: int) -> DataFrame:
    """``target, vector, rep, other``: every row with its donor in each repeat. Rows get ranks in the
    order of their hash, equal ones a number each so that they spread; a repeat turns the ranks by
    an offset of its own, so each row gives its values once and no task holds a table. The number of
    partitions is given, because scoring costs more than the bytes say, by which Spark puts small
    partitions together."""
    from ..operators.stats import running

    spark = df.sparkSession
    own = df.groupBy(target, vector).agg(F.count("*").alias("w")).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(w - 1) div {COPIES}"))).alias("part")).repartition(vector, "part")
    own = own.select(target, vector, F.explode(F.sequence(F.col("part") * COPIES + 1, F.least("w", (F.col("part") + 1) * COPIES))).alias("copy"))
    rows = own.select(target, vector, F.xxhash64(vector, target, "copy").cast("double").alias("at"), F.lit(1).alias("one"))
    ranked = stored(running(rows, "at", {"rank": "one"}).select(target, vector, "rank"), "ranks")
    n = ranked.count()
    turn = F.pmod(F.xxhash64("rep", F.lit(42)), F.lit(max(1, n - 1))) + min(1, n - 1)
    placed = ranked.select("*", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("rep")).withColumn("donor", F.pmod(F.col("rank") - 1 + turn, F.lit(n)) + 1)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    donors = ranked.select(F.col("rank").alias("donor"), F.col(vector).alias("other"))
    return placed.repartition(parts, "donor").join(donors.repartition(parts, "donor"), "donor").select(target, vector, "rep", "other")


def padded(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The length of every list, and its first ``width`` components; what is null or missing is NaN."""
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    held = np.arange(width) < lengths[:, None]
    out = np.full(held.shape, np.nan)
    out[held] = flat[((np.cumsum(lengths) - lengths)[:, None] + np.arange(width))[held]]
    return lengths, out


def permutation_importance(df: DataFrame, model, target: str, vector: str = "g", repeats: int = 5) -> DataFrame:
    """Loss of R2 when a feature's values are permuted over all rows, averaged over repeats. A repeat's
    features share donors, so a row goes to a task once a repeat, with its donor; the task exchanges
    one feature after the other and sends sums of squared errors, 16 bytes by feature and repeat."""
    from ..operators.stats import regression_metrics

    spark = ship(df.sparkSession)
    dims = getattr(model, "width", None) or df.select(F.max(F.size(vector))).first()[0] or 0
    rows = df.select(target, F.col(vector).cast("array<double>").alias(vector))
    shared = spark.sparkContext.broadcast(model)

    def errors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        means = getattr(model, "mean", None) or (lambda x: model.predict(x)[0])
        total, known_rows, reps = np.zeros((dims, repeats)), np.zeros((dims, repeats), np.int64), np.zeros(repeats, bool)
        for batch in batches:
            if not batch.num_rows:
                continue
            lengths, x = padded(batch.column(vector), dims)
            other = padded(batch.column("other"), dims)[1]
            rep = batch.column("rep").to_numpy()
            reps[rep] = True
            y = batch.column(target).cast(pa.float64())
            usable, y = (lengths == dims) & ~y.is_null().to_numpy(zero_copy_only=False), y.to_numpy(zero_copy_only=False)
            bad = ~np.isfinite(x)
            others_bad = bad.sum(1)[:, None] - bad
            for dim in range(dims):
                known = np.flatnonzero(usable & (others_bad[:, dim] == 0) & np.isfinite(other[:, dim]))
                if len(known):
                    mixed = x[known]
                    mixed[:, dim] = other[known, dim]
                    e = y[known] - means(mixed)
                    total[dim] += np.bincount(rep[known], e * e, repeats)
                    known_rows[dim] += np.bincount(rep[known], minlength=repeats)
        dim, rep = (a.ravel() for a in np.meshgrid(np.arange(dims, dtype=np.int32), np.flatnonzero(reps).astype(np.int32), indexing="ij"))
        yield pa.record_batch([pa.array(dim), pa.array(rep), pa.array(total[dim, rep], mask=known_rows[dim, rep] == 0)], ["dim", "rep", "res"])

    sums = permuted(rows, target, vector, repeats).mapInArrow(errors, "dim int, rep int, res double").groupBy("dim", "rep").agg(F.sum("res").alias("res"))
    y = F.col(target)
    base = regression_metrics(predict(rows, model, vector, (target,)), target, "mean").select(F.col("r2").alias("base"))
    spread = rows.agg(F.coalesce(F.var_pop(y) * F.count(y), F.lit(0.0)).alias("tot"))
    worse = F.when(F.col("tot") <= 1e-12, F.lit(0.0)).otherwise(1 - F.col("res") / F.col("tot"))
    return sums.join(F.broadcast(base.join(spread))).groupBy("dim").agg(F.avg(F.col("base") - worse).alias("importance"))


def principal_components(df: DataFrame, vector: str = "g", k: int = 2) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """Centred projections on the first k components, explained ratios and loadings. Only sums and
    products per pair of dimensions come to the driver; the largest loading of each is positive."""
    sums = df.select(F.posexplode(vector).alias("i", "x"), F.col(vector).alias("v")).select("i", "x", F.posexplode("v").alias("j", "y"))
    moments = sums.groupBy("i", "j").agg(F.avg(F.col("x") * F.col("y")).alias("xy"), F.avg("x").alias("mx"), F.avg("y").alias("my")).collect()  # dims squared rows
    n = max(r["i"] for r in moments) + 1
    cov, mean = np.zeros((n, n)), np.zeros(n)
    for r in moments:
        cov[r["i"], r["j"]] = r["xy"] - r["mx"] * r["my"]
        mean[r["i"]] = r["mx"]
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values)[:k]
    loadings = vectors[:, order].T
    loadings *= np.sign(loadings[np.arange(k), np.abs(loadings).argmax(1)])[:, None]
    from ..functions.vectors import total, vec

    parts = [total(F.zip_with(F.zip_with(vector, vec(*mean), lambda a, b: a - b), vec(*row), lambda a, b: a * b)).alias(f"pc{i + 1}") for i, row in enumerate(loadings)]
    return df.select("*", *parts), values[order] / values.sum(), loadings
