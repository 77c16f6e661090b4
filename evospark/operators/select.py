"""Sorting, top-k, sampling, retention and skylines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .slices import PER_SLICE, ranked


def top_per(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: Column | int) -> DataFrame:
    rn = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("_rn", rn).filter(F.col("_rn") <= k).drop("_rn")


def survivors(df: DataFrame, value: str, tie: str, by: Sequence[str], elite: float) -> DataFrame:
    """The best max(2, floor(n * elite)) of each group, best first, earliest first among equals."""
    n = F.count("*").over(Window.partitionBy(*by))
    sized = df.withColumn("_k", F.greatest(F.lit(2), F.floor(n * elite)))
    return top_per(sized, by, [F.desc(value), F.asc(tie)], F.col("_k")).drop("_k")


def evenly_spaced(df: DataFrame, order: str, by: Sequence[str], k: int, per_slice: int = PER_SLICE) -> DataFrame:
    """k rows of each group at even steps of its order, first and last included."""
    steps = F.sequence(F.lit(0), F.lit(k - 1))
    wanted = lambda n: F.transform(steps, lambda j: F.when(n <= k, j.cast("bigint")).otherwise(F.floor(j * (n - 1) / F.lit(max(k - 1, 1)))))
    return ranked(df, order, order, by, wanted, per_slice).select(*df.columns)


#: Slices that a sort of a whole table is dealt into.
SLICES = 256


def feasible(df: DataFrame, ld: str = "ld", rejected: str = "rejected", least: float = 4.0) -> DataFrame:
    """Designs that were flown (``ld`` is there), weren't rejected and glide better than ``least``."""
    return df.filter(F.col(ld).isNotNull() & ~F.isnan(ld) & ~F.col(rejected) & (F.col(ld) > least))


def pareto(df: DataFrame, maximize: str, minimize: str) -> DataFrame:
    """Distinct cost pairs that no other pair dominates: the least cost so far, in order of gain.

    A pair is dominated if one with a higher gain has no higher cost. Costs are first reduced to
    the least per gain; running minima are then taken within slices of about as many gains each and
    joined by the slices' own minima, so no single task sees all rows.
    """
    least = df.filter(F.col(maximize).isNotNull() & F.col(minimize).isNotNull()).groupBy(maximize).agg(F.min(minimize).alias(minimize))
    edges = least.agg(F.percentile_approx(maximize, [k / SLICES for k in range(1, SLICES)], 10 * SLICES).alias("_e"))  # one row
    sliced = least.join(F.broadcast(edges)).withColumn("_s", F.size(F.filter("_e", lambda e: e < F.col(maximize)))).drop("_e")
    slices = sliced.groupBy("_s").agg(F.min(minimize).alias("_m"))
    above = Window.orderBy(F.desc("_s")).rowsBetween(Window.unboundedPreceding, -1)
    base = slices.select("_s", F.min("_m").over(above).alias("_above"))
    before = Window.partitionBy("_s").orderBy(F.desc(maximize)).rowsBetween(Window.unboundedPreceding, -1)
    rows = sliced.withColumn("_before", F.min(minimize).over(before)).join(base, "_s")
    best = F.least("_before", "_above")
    return rows.filter(best.isNull() | (F.col(minimize) < best)).select(maximize, minimize)


def split_by_hash(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """``part``: train, validation or test with exactly n*6/10, n*2/10 and the other rows, in the
    order of a seeded hash; two counting passes over hash slices replace a single-task shuffle."""
    h = F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 20))
    own = df.withColumn("_h", h).withColumn("_s", F.expr("_h div 4096"))
    sizes = own.groupBy("_s").agg(F.count("*").alias("_c"))
    w = Window.orderBy("_s").rowsBetween(Window.unboundedPreceding, 0)
    base = sizes.select("_s", (F.sum("_c").over(w) - F.col("_c")).alias("_base"), F.sum("_c").over(Window.partitionBy()).alias("_n"))
    rank = F.row_number().over(Window.partitionBy("_s").orderBy("_h", key)) - 1
    placed = own.withColumn("_r", rank).join(base, "_s").withColumn("_r", F.col("_r") + F.col("_base"))
    a, b = F.expr("_n * 6 div 10"), F.expr("_n * 6 div 10 + _n * 2 div 10")
    part = F.when(F.col("_r") < a, "train").when(F.col("_r") < b, "validation").otherwise("test")
    return placed.select(*df.columns, part.alias("part"))


def unit_hash(*parts: Column) -> Column:
    """A number in [0, 1) that depends on its arguments alone."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 52)) / float(1 << 52)


def latin_hypercube(spark: SparkSession, n: int, dims: int, seed: int = 42) -> DataFrame:
    """``id, x``: n points with one in each of n strata of every dimension."""
    cells = spark.range(n).select("id", F.explode(F.sequence(F.lit(0), F.lit(dims - 1))).alias("dim"))
    stratum = F.row_number().over(Window.partitionBy("dim").orderBy(F.xxhash64(F.lit(seed), "dim", "id"), "id")) - 1
    placed = cells.withColumn("x", (stratum + unit_hash(F.lit(seed + 1), F.col("dim"), F.col("id"))) / n)
    return placed.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda s: s["x"]).alias("x"))


def random_population(spark: SparkSession, n: int, dims: int, seed: int = 42) -> DataFrame:
    return spark.range(n).select("id", F.array(*(unit_hash(F.lit(seed), F.lit(k), F.col("id")) for k in range(dims))).alias("g"))


def sliding_window(df: DataFrame, order: str, cap: int, by: Sequence[str] = ()) -> DataFrame:
    """The last ``cap`` rows of each group; over a whole table, a top-k that needs no full sort."""
    if by:
        return top_per(df, by, [F.desc(order)], cap)
    return df.orderBy(F.desc(order)).limit(cap)


def bulk_trim(df: DataFrame, order: str, by: Sequence[str], cap: int, per_slice: int = PER_SLICE) -> DataFrame:
    """A ring that is cut to 80 % of its capacity whenever it passes 125 % of it: what is left of
    n arrivals follows from n alone."""
    trigger, keep = int(cap * 1.25), int(cap * 0.8)
    n = F.col("_n")
    left = F.when(n <= trigger, n).otherwise(keep + (n - trigger - 1) % (trigger - keep + 1))
    return ranked(df, order, order, by, per_slice=per_slice).filter(F.col("_rank") >= n - left).select(*df.columns)


def ttl(df: DataFrame, last: str, now: Column | int, max_age: int) -> DataFrame:
    return df.filter(F.greatest(F.lit(now) - F.col(last), F.lit(0)) <= max_age)


def immigrate(population: DataFrame, immigrants: DataFrame, size: int, value: str, tie: str, as_written: bool = False) -> DataFrame:
    """Immigrants replace the worst of the population; ``as_written`` appends and cuts the tail,
    which drops them from a full population."""
    home, came = population.withColumn("_new", F.lit(0)), immigrants.withColumn("_new", F.lit(1))
    if as_written:
        return home.unionByName(came).orderBy("_new", tie).limit(size).drop("_new")
    n = immigrants.count()
    stay = home.orderBy(F.desc(value), tie).limit(max(size - n, 0))
    return stay.unionByName(came.orderBy(F.desc(value), tie).limit(size)).drop("_new")


def first_seen(df: DataFrame, key: Column, order: str) -> DataFrame:
    """The first row of every key."""
    keyed = df.withColumn("_key", key)
    best = keyed.groupBy("_key").agg(F.min_by(F.struct(*df.columns), order).alias("_r"))
    return best.select("_r.*")
