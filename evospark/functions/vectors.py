"""Column builders over ``array<double>`` vectors; all of them stay in generated JVM code."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def vec(*values: float) -> Column:
    return F.array(*(F.lit(float(v)) for v in values))


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda acc, v: acc + v)


def squared_l2(a: Column, b: Column) -> Column:
    """Over the shorter of the two; a null vector gives null."""
    n = F.least(F.size(a), F.size(b))
    return total(F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: (x - y) * (x - y)))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(squared_l2(a, b))


def scaled_squared(a: Column, b: Column, scales: Column) -> Column:
    """Sum of ((a - b) / scale)^2."""
    parts = F.zip_with(F.zip_with(a, b, lambda x, y: x - y), scales, lambda d, s: (d / s) * (d / s))
    return total(parts)


def clip01(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def decode(genes: Column, bounds: Sequence[tuple[str, float, float]]) -> list[Column]:
    """One column per gene: low + (high - low) * clipped gene."""
    return [(F.lit(low) + F.lit(high - low) * clip01(F.get(genes, F.lit(i)))).alias(name) for i, (name, low, high) in enumerate(bounds)]


def min_max(x: Column, low: Column, high: Column) -> Column:
    """Into [0, 1]; 0 where the range has no width."""
    return F.when(F.abs(high - low) < 1e-12, F.lit(0.0)).otherwise(clip01((x - low) / (high - low)))


def quantize(x: Column, bits: int = 16) -> Column:
    """Half-to-even onto the integers from 0 to 2^bits - 1."""
    return F.rint(clip01(x) * float((1 << bits) - 1)).cast("long")


def sphere(genes: Column) -> Column:
    """A landscape with its peak of 15 in the middle of the cube."""
    return F.lit(15.0) / (F.lit(1.0) + F.lit(3.0) * total(F.transform(genes, lambda x: (x - 0.5) * (x - 0.5))))


def matern52(r: Column, variance: float = 1.0) -> Column:
    s = F.lit(math.sqrt(5.0)) * r
    return F.lit(variance) * (F.lit(1.0) + s + s * s / 3.0) * F.exp(-s)


def rbf(r: Column, variance: float = 1.0) -> Column:
    return F.lit(variance) * F.exp(F.lit(-0.5) * r * r)


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def activations(x: Column) -> dict[str, Column]:
    """ReLU, SiLU, GELU (by tanh) and tanh with their derivatives."""
    s, c = sigmoid(x), math.sqrt(2.0 / math.pi)
    inner = F.tanh(F.lit(c) * (x + F.lit(0.044715) * x * x * x))
    t = F.tanh(x)
    return {
        "relu": F.greatest(x, F.lit(0.0)),
        "relu_d": F.when(x > 0, 1.0).otherwise(0.0),
        "silu": x * s,
        "silu_d": s * (F.lit(1.0) + x * (F.lit(1.0) - s)),
        "gelu": F.lit(0.5) * x * (F.lit(1.0) + inner),
        "gelu_d": F.lit(0.5) * (F.lit(1.0) + inner) + F.lit(0.5) * x * (F.lit(1.0) - inner * inner) * F.lit(c) * (F.lit(1.0) + F.lit(3 * 0.044715) * x * x),
        "tanh": t,
        "tanh_d": F.lit(1.0) - t * t,
    }
