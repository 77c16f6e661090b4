"""Exact order statistics of large groups from mergeable quantile sketches.

A sketch of each group (Greenwald and Khanna's, which Spark merges from the tasks' parts) gives
edges that cut the group's values into slices of about as many rows each, whatever their
distribution. Every edge is a slice of its own besides, because a value that many rows share is an
edge: such a slice is cut further by the edges of the tie column. So no slice holds many more rows
than ``per_slice``, sorting happens within slices, and ranks are shifted by the sizes of the slices
before. Nulls come first, NaN last. The number of slices follows the rows, up to ``MOST`` a group.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import stored

#: Rows of a slice, slices of a group at most, and groups whose edges may be broadcast.
PER_SLICE, MOST, FEW_GROUPS = 65_536, 4_096, 64


def _below(edges: Column, x: Column, side: int) -> Column:
    """How many of the sorted edges are less than x, by two rounds of ``side`` comparisons or so."""
    heads = F.transform(F.sequence(F.lit(0), F.greatest(F.size(edges) - 1, F.lit(0)), F.lit(side)), lambda i: F.get(edges, i))
    whole = F.greatest(F.size(F.filter(heads, lambda e: e < x)) - 1, F.lit(0)) * side
    return whole + F.size(F.filter(F.slice(edges, whole + 1, F.lit(side)), lambda e: e < x))


def sliced(df: DataFrame, value: str, tie: str, by: Sequence[str] = (), per_slice: int = PER_SLICE) -> DataFrame:
    """``df`` with ``_s``, the slice (a pair of numbers that grow with value and tie) of each row."""
    slices = min(MOST, -(-df.count() // per_slice))
    if slices <= 1:
        return df.withColumn("_s", F.struct(F.lit(0).alias("a"), F.lit(0).alias("b")))
    shares = [i / slices for i in range(1, slices)]
    edges = lambda c: F.coalesce(F.array_distinct(F.percentile_approx(F.when(~F.isnan(F.col(c).cast("double")), F.col(c)), shares, 10 * slices)), F.array())
    names = [f"_k{i}" for i in range(len(by))]
    # Stored: sketches that are merged in another order give other edges, and all that use the slices need the same.
    found = stored(df.groupBy(*(F.col(c).alias(n) for c, n in zip(by, names))).agg(edges(value).alias("_e"), edges(tie).alias("_t")), "edges")
    few = not by or found.limit(FEW_GROUPS + 1).count() <= FEW_GROUPS
    same = F.lit(True)
    for c, n in zip(by, names):
        same = same & F.col(c).eqNullSafe(F.col(n))
    both = df.join(F.broadcast(found) if few else found, same)
    side, x = max(1, math.isqrt(slices)), F.col(value)
    less = _below(F.col("_e"), x, side)
    on_edge = F.coalesce(F.get(F.col("_e"), less) == x, F.lit(False))
    place = F.when(x.isNull(), -1).otherwise(2 * less + on_edge.cast("int"))
    within = F.when(on_edge | x.isNull(), F.coalesce(_below(F.col("_t"), F.col(tie), side), F.lit(-1))).otherwise(0)
    return both.withColumn("_s", F.struct(place.alias("a"), within.alias("b"))).drop("_e", "_t", *names)


def ranked(df: DataFrame, value: str, tie: str, by: Sequence[str] = (), wanted: Callable[[Column], Column] | None = None, per_slice: int = PER_SLICE) -> DataFrame:
    """``df`` with ``_rank`` (from 0) in the order of value and tie, and the group's size ``_n``.

    ``wanted`` makes the array of ranks that are asked for of a group's size: slices without any are
    left out before they are sorted, and so are the other rows of those that are.
    """
    own = sliced(df, value, tie, by, per_slice)
    sizes = own.groupBy(*by, "_s").agg(F.count("*").alias("_c"))
    group = Window.partitionBy(*by)  # a row a slice
    ends = F.sum("_c").over(group.orderBy("_s").rowsBetween(Window.unboundedPreceding, 0))
    bases = sizes.select(*by, "_s", "_c", (ends - F.col("_c")).alias("_base"), F.sum("_c").over(group).alias("_n"))
    if wanted is not None:
        bases = bases.filter(F.exists(wanted(F.col("_n")), lambda r: (r >= F.col("_base")) & (r < F.col("_base") + F.col("_c"))))
    names = [f"_k{i}" for i in range(len(by))]
    same = F.col("_s") == F.col("_z")
    for c, n in zip(by, names):
        same = same & F.col(c).eqNullSafe(F.col(n))
    placed = own.join(bases.select(*(F.col(c).alias(n) for c, n in zip(by, names)), F.col("_s").alias("_z"), "_base", "_n"), same)
    rank = F.row_number().over(Window.partitionBy(*by, "_s").orderBy(value, tie)) - 1
    out = placed.select(*df.columns, (rank + F.col("_base")).alias("_rank"), "_n")
    return out if wanted is None else out.filter(F.array_contains(wanted(F.col("_n")), F.col("_rank")))
