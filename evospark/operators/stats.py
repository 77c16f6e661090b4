"""Aggregations, distributions and window-style operators over telemetry."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .slices import PER_SLICE, ranked, sliced


def running(df: DataFrame, order: str, sums: dict[str, str], per_slice: int = PER_SLICE) -> DataFrame:
    """Running sums over a whole table without a single-task sort: sums run within slices of the
    order column that hold about as many rows each, and are shifted by the totals of those before."""
    own = sliced(df, order, order, per_slice=per_slice)
    totals = own.groupBy("_s").agg(*(F.sum(c).alias(f"_t_{n}") for n, c in sums.items()))
    before = Window.orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)  # a row a slice
    base = totals.select(F.col("_s").alias("_z"), *(F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_b_{n}") for n in sums))
    w = Window.partitionBy("_s").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    run = own.withColumns({f"_r_{n}": F.sum(c).over(w) for n, c in sums.items()}).join(base, F.col("_s") == F.col("_z"))
    return run.select(*df.columns, *((F.col(f"_r_{n}") + F.col(f"_b_{n}")).alias(n) for n in sums))


def fitness_stats(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Best, mean, worst and population deviation; an empty table has best and worst of -inf."""
    x, low = F.col(value), F.lit(float("-inf"))
    stats = df.groupBy(*by).agg(F.max(x).alias("best"), F.avg(x).alias("avg"), F.min(x).alias("worst"), F.stddev_pop(x).alias("std"))
    return stats.select(*by, F.coalesce("best", low).alias("best"), F.coalesce("avg", F.lit(0.0)).alias("avg"), F.coalesce("worst", low).alias("worst"), F.coalesce("std", F.lit(0.0)).alias("std"))


def gene_variance(df: DataFrame, vector: str, by: Sequence[str] = ()) -> DataFrame:
    """Sample variance per dimension; 0 for a single row."""
    genes = df.select(*by, F.posexplode(vector).alias("dim", "x"))
    return genes.groupBy(*by, "dim").agg(F.coalesce(F.var_samp("x"), F.lit(0.0)).alias("variance"))


def population_entropy(df: DataFrame, vector: str, bins: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """Shannon entropy of binned genes over the largest possible, averaged over dimensions."""
    genes = df.select(*by, F.posexplode(vector).alias("dim", "x"))
    cell = F.least(F.floor(F.least(F.greatest("x", F.lit(0.0)), F.lit(1.0)) * bins), F.lit(bins - 1))
    counts = genes.groupBy(*by, "dim", cell.alias("cell")).agg(F.count("*").alias("c"))
    # ln n - (sum c ln c) / n, which needs no second pass over the counts
    dims = counts.groupBy(*by, "dim").agg(((F.log(F.sum("c")) - F.sum(F.col("c") * F.log("c")) / F.sum("c")) / math.log(bins)).alias("h"))
    return dims.groupBy(*by).agg(F.avg("h").alias("entropy"))


def best_row(df: DataFrame, value: str, tie: str, columns: Sequence[str], by: Sequence[str] = (), last: bool = True) -> DataFrame:
    """The row of the highest value; among equals the last (or first) by ``tie``. Null values are
    lowest, NaN never wins."""
    score = F.when(F.isnan(value), None).otherwise(F.col(value))
    order = F.struct(F.coalesce(score, F.lit(float("-inf"))), F.col(tie) if last else -F.col(tie))
    return df.groupBy(*by).agg(F.max_by(F.struct(*columns), order).alias("_b")).select(*by, "_b.*")


def ribbon(df: DataFrame, run: str, step: str, value: str, shortest: bool) -> DataFrame:
    """Mean, population deviation, least and most of a value per step over runs; with ``shortest``
    only the steps that every run has."""
    rows = df
    if shortest:
        limit = F.broadcast(df.groupBy(run).agg(F.max(step).alias("_last")).agg(F.min("_last").alias("_end")))
        rows = df.join(limit).filter(F.col(step) <= F.col("_end"))
    return rows.groupBy(step).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("low"), F.max(value).alias("high"), F.count("*").alias("runs"))


def percentiles(df: DataFrame, value: str, shares: dict[str, float], by: Sequence[str] = (), per_slice: int = PER_SLICE) -> DataFrame:
    """Linear interpolation between the two values around each share, exact: only the slices that
    hold them are sorted. Nulls don't count; a group of nulls has no row."""
    at = lambda n, p: F.lit(p) * (n - 1)
    wanted = lambda n: F.flatten(F.array(*(F.array(F.floor(at(n, p)), F.ceil(at(n, p))) for p in shares.values())))
    rows = ranked(df.filter(F.col(value).isNotNull()).select(*by, value), value, value, by, wanted, per_slice)
    pick = lambda r: F.max(F.when(F.col("_rank") == r, F.col(value)))
    n = F.col("_n")
    out = rows.groupBy(*by, "_n").agg(*(pick(f(at(n, p))).alias(f"_{side}_{name}") for name, p in shares.items() for side, f in (("lo", F.floor), ("hi", F.ceil))))
    share = lambda p: at(n, p) - F.floor(at(n, p))
    return out.select(*by, *((F.col(f"_lo_{name}") + share(p) * (F.col(f"_hi_{name}") - F.col(f"_lo_{name}"))).alias(name) for name, p in shares.items()))


def ecdf(df: DataFrame, value: str, tie: str, by: Sequence[str], per_slice: int = PER_SLICE) -> DataFrame:
    """i / n of every row in sorted order."""
    rows = ranked(df.select(*by, tie, value), value, tie, by, per_slice=per_slice)
    return rows.select(*by, tie, value, ((F.col("_rank") + 1) / F.col("_n")).alias("cdf"))


def jain(df: DataFrame, value: str) -> DataFrame:
    x = F.col(value).cast("double")
    return df.agg((F.sum(x) * F.sum(x) / (F.count(x) * F.sum(x * x))).alias("fairness"))


def ols(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Slope and intercept; 1 and 0 where x doesn't vary."""
    n, sx, sy, sxy, sxx = F.count("*"), F.sum(x), F.sum(y), F.sum(F.col(x) * F.col(y)), F.sum(F.col(x) * F.col(x))
    s = df.groupBy(*by).agg(n.alias("n"), sx.alias("sx"), sy.alias("sy"), sxy.alias("sxy"), sxx.alias("sxx"))
    den = F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx")
    flat = F.abs(den) < 1e-12
    s = s.withColumn("slope", F.when(flat, 1.0).otherwise((F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")) / den))
    return s.select(*by, "slope", F.when(flat, 0.0).otherwise((F.col("sy") - F.col("slope") * F.col("sx")) / F.col("n")).alias("intercept"))


def regression_metrics(df: DataFrame, actual: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """R2 (0 where the target doesn't vary), RMSE, MAE and largest residual; zeros without rows."""
    y, e = F.col(actual), F.col(actual) - F.col(predicted)
    s = df.groupBy(*by).agg(F.sum(e * e).alias("res"), F.coalesce(F.var_pop(y) * F.count(y), F.lit(0.0)).alias("tot"), F.count(y).alias("n"), F.avg(F.abs(e)).alias("mae"), F.max(F.abs(e)).alias("max_residual"))
    zero = F.lit(0.0)
    return s.select(*by, F.when(F.col("tot") <= 1e-12, zero).otherwise(1 - F.col("res") / F.col("tot")).alias("r2"), F.when(F.col("n") == 0, zero).otherwise(F.sqrt(F.col("res") / F.col("n"))).alias("rmse"), F.coalesce("mae", zero).alias("mae"), F.coalesce("max_residual", zero).alias("max_residual"))


def scaler(df: DataFrame, vector: str) -> DataFrame:
    """Mean and population deviation per dimension; a deviation of up to 1e-8 becomes 1."""
    d = df.select(F.posexplode(vector).alias("dim", "x")).groupBy("dim").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("s"))
    return d.select("dim", "mean", F.when(F.col("s") > 1e-8, F.col("s")).otherwise(1.0).alias("std"))


def histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """``cell, low, n, density`` over the data's range in bins of one width."""
    b = F.broadcast(df.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.count(value).alias("_n")))
    width = (F.col("_hi") - F.col("_lo")) / bins
    cell = F.least(F.floor((F.col(value) - F.col("_lo")) / width), F.lit(bins - 1))
    rows = df.join(b).groupBy(cell.alias("cell"), "_lo", "_hi", "_n").agg(F.count("*").alias("n"))
    return rows.select("cell", (F.col("_lo") + F.col("cell") * width).alias("low"), "n", (F.col("n") / (F.col("_n") * width)).alias("density"))


def density2d(df: DataFrame, x: str, y: str, bins: int) -> DataFrame:
    b = F.broadcast(df.agg(F.min(x).alias("_x0"), F.max(x).alias("_x1"), F.min(y).alias("_y0"), F.max(y).alias("_y1")))
    cell = lambda v, lo, hi: F.least(F.floor((F.col(v) - F.col(lo)) / (F.col(hi) - F.col(lo)) * bins), F.lit(bins - 1))
    return df.join(b).groupBy(cell(x, "_x0", "_x1").alias("cx"), cell(y, "_y0", "_y1").alias("cy")).agg(F.count("*").alias("n")).withColumn("log_n", F.log1p("n"))


def stagnation(series: DataFrame, by: Sequence[str], step: str, value: str, patience: int, min_improvement: float, min_steps: int) -> DataFrame:
    """Steps without progress after every step, and whether to stop: a fold over each run's series
    in order, whose length is the number of generations."""
    rows = series.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(step).alias("step"), F.col(value).alias("value")))).alias("s"))
    none = F.array().cast("array<struct<step:bigint,stagnant:int,stop:boolean>>")
    state = F.struct(F.lit(float("-inf")).alias("last"), F.lit(0).alias("n"), none.alias("out"))

    def fold(acc: Column, x: Column) -> Column:
        better = x["value"] > acc["last"] + min_improvement
        n = F.when(better, 0).otherwise(acc["n"] + 1)
        stop = ~better & (n >= patience) & (x["step"] >= min_steps) if patience else F.lit(False)
        row = F.struct(x["step"].cast("bigint").alias("step"), n.alias("stagnant"), stop.alias("stop"))
        return F.struct(F.when(better, x["value"]).otherwise(acc["last"]).alias("last"), n.alias("n"), F.array_append(acc["out"], row).alias("out"))

    return rows.select(*by, F.inline(F.aggregate("s", state, fold, lambda acc: acc["out"])))


def gradient(df: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    """Central differences, one-sided at the ends of each series."""
    w = Window.partitionBy(*by).orderBy(x)
    lag = lambda c: F.coalesce(F.lag(c).over(w), F.col(c))
    lead = lambda c: F.coalesce(F.lead(c).over(w), F.col(c))
    rows = df.select("*", lag(x).alias("_x0"), lead(x).alias("_x1"), lag(y).alias("_y0"), lead(y).alias("_y1"))
    return rows.select(*df.columns, F.when(F.col("_x1") != F.col("_x0"), (F.col("_y1") - F.col("_y0")) / (F.col("_x1") - F.col("_x0"))).alias("gradient"))


def queue_backlog(latencies: DataFrame, order: str, value: str, workers: int, by: Sequence[str] = ()) -> DataFrame:
    """Latency with queueing under round-robin and under the choice of the shorter of two queues,
    per trace: two folds over a trace's requests in order."""
    rows = latencies.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order), F.col(value).cast("double").alias("v")))), lambda s: s["v"]).alias("v"))
    zeros = F.array_repeat(F.lit(0.0), workers)
    out = F.array().cast("array<double>")
    replace = lambda q, t, v: F.transform(q, lambda x, k: F.when(k == t, v).otherwise(x))

    def robin(acc: Column, lat: Column) -> Column:
        t = F.size(acc["out"]) % workers
        own = F.get(acc["q"], t)
        return F.struct(replace(acc["q"], t, F.greatest(own * 0.85 + lat * 0.25 - 45.0, F.lit(0.0))).alias("q"), F.array_append(acc["out"], lat + own * 0.35).alias("out"))

    def shorter(acc: Column, lat: Column) -> Column:
        i = F.size(acc["out"])
        a = F.pmod(F.xxhash64(i, F.lit(1)), F.lit(workers)).cast("int")
        b = ((a + 1 + F.pmod(F.xxhash64(i, F.lit(2)), F.lit(workers - 1))) % workers).cast("int")
        t = F.when(F.get(acc["q"], a) <= F.get(acc["q"], b), a).otherwise(b)
        own = F.get(acc["q"], t)
        added = F.transform(replace(acc["q"], t, own + lat), lambda x: F.greatest(x - 170.0, F.lit(0.0)))
        return F.struct(added.alias("q"), F.array_append(acc["out"], lat + own * 0.12).alias("out"))

    state = F.struct(zeros.alias("q"), out.alias("out"))
    folded = rows.select(*by, F.aggregate("v", state, robin, lambda a: a["out"]).alias("rr"), F.aggregate("v", state, shorter, lambda a: a["out"]).alias("lr"))
    return folded.select(*by, F.posexplode(F.arrays_zip("rr", "lr")).alias("i", "_z")).select(*by, "i", F.col("_z.rr").alias("round_robin"), F.col("_z.lr").alias("least_request"))
