"""A learned index over keys: features, leaves fitted per bin, placement, averaging and tuning.

A model is a table of leaves: ``bin, kind, weight, bias, offset, scale, radix``; ``radix`` holds
the table of a radix leaf, and is null for a linear one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import stored
from .ring import sha1_id

RADIX = 1024
U32 = float(2**32 - 1)
#: What a double holds of 2^64 - 1, and of 2^64.
U64 = 18446744073709551615.0
#: Distinct keys, the least by hash, that give the bounds of slices, and the slices' number's root.
SAMPLED, SIDE = 16_384, 32


def _fraction(digits: Column) -> Column:
    """Up to 16 hex digits as a share of the largest number of that length."""
    head = F.substring(digits, 1, 16)
    n = F.least(F.length(digits), F.lit(16))
    top = F.when(n < 16, F.pow(F.lit(16.0), n) - 1.0).otherwise(U64)
    return F.conv(head, 16, 10).cast("double") / top


def feature(key: Column, curves: int = 3) -> Column:
    """A key's place in [0, 1]: by curve and hex digits, by hex digits, or by SHA-1."""
    bar = F.locate("|", key) > 0
    head = F.substring_index(key, "|", 1)
    is_hex = head.rlike("^[0-9a-fA-F]+$")
    digit = F.conv(F.substring(head, 1, 1), 16, 10).cast("int")
    on_curve = bar & (digit < curves) & (F.length(head) > 1)
    by_curve = (digit.cast("double") + _fraction(F.substring(head, 2, 16))) / float(curves)
    by_sha = F.conv(sha1_id(key), 16, 10).cast("double") / U64
    return F.when(is_hex, F.when(on_curve, by_curve).otherwise(_fraction(head))).otherwise(by_sha)


def bin_of(f: Column, bins: int) -> Column:
    return F.least(F.floor(f * float(bins)), F.lit(bins - 1)).cast("int")


def _slice_of(keys: DataFrame) -> Column:
    """The slice of a key ``k``: SIDE * SIDE ranges with about equal numbers of the distinct keys,
    whatever these look like. Two rounds of SIDE comparisons find it."""
    sample = sorted(r["k"] for r in keys.orderBy(F.xxhash64("k"), "k").limit(SAMPLED).collect())
    if not sample:
        return F.lit(0)
    lows = [sample[i * len(sample) // SIDE**2] for i in range(SIDE**2)]  # of each slice
    begun = lambda bounds: F.size(F.filter(bounds, lambda low: low <= F.col("k")))
    coarse = begun(F.lit(lows[SIDE::SIDE]))
    fine = F.lit([lows[i + 1 : i + SIDE] for i in range(0, SIDE**2, SIDE)])
    return coarse * SIDE + begun(F.get(fine, coarse))


def ranked(keys: DataFrame) -> DataFrame:
    """``k, f, rank, n, p``: distinct keys, nulls aside, with their 0-based rank and empirical CDF.

    Ranks are counted within slices of the keys and shifted by the slices' sums, so that no single
    task sorts all keys. The distinct keys are stored, and a slice is never null: else the join on
    slices would filter by ``slice is not null`` below ``distinct``, where ``k`` can be a digest, and
    compute that digest for each bound.
    """
    own = stored(keys.select("k").filter("k is not null").distinct(), "distinct-keys")
    own = own.withColumn("slice", F.coalesce(_slice_of(own), F.lit(0)))
    sizes = own.groupBy("slice").agg(F.count("*").alias("c"))
    w = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = sizes.select("slice", (F.sum("c").over(w) - F.col("c")).alias("base"), F.sum("c").over(Window.partitionBy()).alias("n"))
    within = own.withColumn("r", F.row_number().over(Window.partitionBy("slice").orderBy("k")) - 1)
    rows = within.join(F.broadcast(starts), "slice")  # a row for each of SIDE * SIDE slices at most
    return rows.select("k", feature(F.col("k")).alias("f"), (F.col("r") + F.col("base")).alias("rank"), "n").withColumn("p", F.col("rank") / F.col("n"))


def linear_leaves(rows: DataFrame, bins: int) -> DataFrame:
    """Least squares of rank share on feature in every bin; the identity below two keys or where
    the features don't differ."""
    f, p = F.col("f"), F.col("p")
    sums = rows.groupBy(bin_of(f, bins).alias("bin")).agg(F.count("*").alias("m"), F.sum(f).alias("sx"), F.sum(p).alias("sy"), F.sum(f * p).alias("sxy"), F.sum(f * f).alias("sxx"))
    every = rows.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    den = F.col("m") * F.col("sxx") - F.col("sx") * F.col("sx")
    flat = F.coalesce((F.col("m") < 2) | (F.abs(den) < 1e-12), F.lit(True))
    slope = (F.col("m") * F.col("sxy") - F.col("sx") * F.col("sy")) / den
    out = every.join(sums, "bin", "left").withColumn("weight", F.when(flat, 1.0).otherwise(slope))
    bias = F.when(flat, 0.0).otherwise((F.col("sy") - F.col("weight") * F.col("sx")) / F.col("m"))
    return out.select("bin", F.lit("linear").alias("kind"), "weight", bias.alias("bias"), F.lit(0.0).alias("offset"), F.lit(1.0).alias("scale"), F.lit(None).cast("array<double>").alias("radix"))


def radix_slots(rows: DataFrame, bins: int) -> DataFrame:
    """``bin, slot, value``: every slot's last key's share of 2^32 - 1; empty ones repeat the slot
    before."""
    slot = F.least(F.floor(F.col("f") * float(RADIX)), F.lit(RADIX - 1)).cast("int")
    last = rows.groupBy(bin_of(F.col("f"), bins).alias("bin"), slot.alias("slot")).agg(F.floor(F.max_by("p", "rank") * U32).cast("long").alias("value"))
    every = rows.sparkSession.range(bins * RADIX).select(F.expr(f"cast(id div {RADIX} as int)").alias("bin"), F.expr(f"cast(id % {RADIX} as int)").alias("slot"))
    w = Window.partitionBy("bin").orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)
    full = every.join(last, ["bin", "slot"], "left")
    return full.select("bin", "slot", F.coalesce(F.last(F.nullif("value", F.lit(0)), ignorenulls=True).over(w), F.lit(0)).alias("value"))


def radix_leaves(rows: DataFrame, bins: int) -> DataFrame:
    tables = radix_slots(rows, bins).groupBy("bin").agg(F.array_sort(F.collect_list(F.struct("slot", "value"))).alias("t"))
    return tables.select("bin", F.lit("radix").alias("kind"), F.lit(0.0).alias("weight"), F.lit(0.0).alias("bias"), F.lit(0.0).alias("offset"), F.lit(1.0).alias("scale"), F.transform("t", lambda s: s["value"].cast("double")).alias("radix"))


def predict(keys: DataFrame, leaves: DataFrame, bins: int) -> DataFrame:
    """``keys`` with ``cdf``: the leaf's value, scaled and shifted, 0 if not finite, in [0, 1].
    A model has at most 64 leaves of 1024 numbers: it goes to the keys."""
    f = feature(F.col("k"))
    rows = keys.withColumn("f", f).withColumn("bin", bin_of(F.col("f"), bins)).join(F.broadcast(leaves), "bin")
    slot = F.least(F.floor(F.col("f") * float(RADIX)), F.lit(RADIX - 1)).cast("int")
    raw = F.when(F.col("kind") == "radix", F.get("radix", slot) / U32).otherwise(F.col("weight") * F.col("f") + F.col("bias"))
    y = raw * F.col("scale") + F.col("offset")
    finite = ~F.isnan(y) & (F.abs(y) < float("inf"))
    return rows.withColumn("cdf", F.when(finite, F.least(F.greatest(y, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)).drop(*[c for c in leaves.columns if c != "bin"])


def position(cdf: Column) -> Column:
    """floor(cdf * 2^64) as a ring id, no more than 2^64 - 1; both halves are exact in doubles."""
    scaled = cdf * 4294967296.0
    high = F.floor(scaled)
    low = F.floor((scaled - high) * 4294967296.0)
    word = lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")
    return F.when(cdf >= 1.0, F.lit("f" * 16)).otherwise(F.concat(word(high), word(low)))


def train(keys: DataFrame, bins: int = 1) -> DataFrame:
    return linear_leaves(ranked(keys), bins)


def error_on_sketch(rows: DataFrame, leaves: DataFrame, bins: int) -> float:
    """Mean distance between prediction and feature on about a hundred evenly spaced keys."""
    sketch = rows.filter(F.col("rank") % F.greatest(F.floor(F.col("n") / 100), F.lit(1)) == 0).select("k")
    scored = predict(sketch, leaves, bins)
    return scored.agg(F.avg(F.abs(F.col("cdf") - F.col("f")))).first()[0] or 0.0


def auto(keys: DataFrame) -> tuple[int, str, DataFrame]:
    """Bins and kind of the best of four linear models and, from 16 bins on, a radix one."""
    rows = ranked(keys).cache()
    if rows.count() < 100:
        return 1, "linear", linear_leaves(rows, 1)
    errors = {b: error_on_sketch(rows, linear_leaves(rows, b), b) for b in (8, 16, 32, 64)}
    bins = min(errors, key=lambda b: (errors[b], b))
    if bins >= 16 and error_on_sketch(rows, radix_leaves(rows, bins), bins) < errors[bins]:
        return bins, "radix", radix_leaves(rows, bins)
    return bins, "linear", linear_leaves(rows, bins)


def federated_average(models: DataFrame) -> DataFrame:
    """``model, n, bin, kind, weight, bias, offset`` rows averaged by n over the sum of at least 1
    each; radix leaves add their offset alone, and scales start again at 1."""
    sizes = models.groupBy("model").agg(F.max("n").alias("n")).agg(F.sum(F.greatest("n", F.lit(1))).alias("total"))
    w = F.col("n") / F.col("total")
    own = F.when(F.col("kind") == "linear", w).otherwise(0.0)
    return models.join(F.broadcast(sizes)).groupBy("bin").agg(F.sum(F.col("weight") * own).alias("weight"), F.sum(F.col("bias") * own).alias("bias"), F.sum(F.col("offset") * w).alias("offset")).withColumn("scale", F.lit(1.0))


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Leaves whose parameters differ by more than 1e-12, or that one model lacks (then zeros)."""
    x = a.select("bin", *(F.col(c).alias(f"a_{c}") for c in ("weight", "bias", "offset")))
    y = b.select("bin", *(F.col(c).alias(f"b_{c}") for c in ("weight", "bias", "offset")))
    both = x.join(y, "bin", "full_outer")
    gap = {c: F.coalesce(F.col(f"a_{c}") - F.col(f"b_{c}"), F.lit(0.0)) for c in ("weight", "bias", "offset")}
    lacks = F.col("a_weight").isNull() | F.col("b_weight").isNull()
    differs = lacks
    for c in gap.values():
        differs = differs | (F.abs(c) > 1e-12)
    return both.filter(differs).select("bin", *(c.alias(n) for n, c in gap.items()))


def apply_difference(model: DataFrame, diff: DataFrame) -> DataFrame:
    d = diff.select("bin", *(F.col(c).alias(f"d_{c}") for c in ("weight", "bias", "offset")))
    return model.join(d, "bin", "left").select("bin", *((F.col(c) + F.coalesce(f"d_{c}", F.lit(0.0))).alias(c) for c in ("weight", "bias", "offset")))


def tune(counts: DataFrame, target: float = 0.95, high: float = 0.05, mid: float = 0.02, least: int = 20, scale_step: float = 0.05, centering: float = 0.01) -> DataFrame:
    """The two-bit controller of every leaf, folded over its steps in order.

    ``counts`` holds ``bin, step, inside, outside``. A leaf's steps are an array, bounded by the
    number of control rounds; the fold is one expression.
    """
    steps = counts.groupBy("bin").agg(F.array_sort(F.collect_list(F.struct("step", "inside", "outside"))).alias("steps"))
    state = F.struct(F.lit(0).alias("p"), F.lit(0).alias("i"), F.lit(False).alias("up"), F.lit(0).alias("d"), F.lit(1.0).alias("scale"), F.lit(0.0).alias("offset"))

    def step(s: Column, x: Column) -> Column:
        total = x["inside"] + x["outside"]
        error = x["inside"] / F.greatest(total, F.lit(1)) - target
        level = F.when(error > high, 3).when(error > mid, 2).when(error > -mid, 1).otherwise(0)
        out = level + s["i"] / 4.0 + F.when(s["up"], s["d"]).otherwise(-s["d"])
        shift = centering * F.least(F.abs(error), F.lit(1.0))
        offset = F.when(error > 0, s["offset"] - shift).otherwise(s["offset"] + shift)
        grows, shrinks = out > 2.0, out < 0.5
        reset = grows | shrinks
        following = F.struct(
            level.alias("p"),
            F.when(reset, 1).otherwise(F.least(s["i"] + 1, F.lit(15))).alias("i"),
            F.when(reset, False).otherwise(level < s["p"]).alias("up"),
            F.when(reset, 0).otherwise(F.when(level > s["p"], 1).otherwise(0)).alias("d"),
            F.when(grows, s["scale"] * (1 + scale_step)).when(shrinks, s["scale"] * (1 - scale_step)).otherwise(s["scale"]).alias("scale"),
            offset.alias("offset"),
        )
        return F.when(total < least, s).otherwise(following)

    return steps.select("bin", F.aggregate("steps", state, step).alias("s")).select("bin", "s.*")
