"""Keys along space-filling curves: order-preserving hex strings of points in the unit cube.

A curve visits the dimensions in its own order; several curves give a point several keys. Points
are quantized half to even, turned into Hilbert indices by the method of Skilling (2004) for whole
batches at once, and written as fixed-width hex, so that string order is curve order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship

BITS = 16
SEED = 20240807


def permutations(dims: int, curves: int, seed: int = SEED) -> list[list[int]]:
    """Distinct orders of the dimensions; more curves only add to the list."""
    out: list[list[int]] = [list(range(dims))]
    rng = np.random.default_rng(seed)
    limit = 1
    for i in range(2, dims + 1):
        limit *= i
    while len(out) < min(curves, limit):
        p = rng.permutation(dims).tolist()
        if p not in out:
            out.append(p)
    return [out[i % len(out)] for i in range(curves)]


def transposed(points: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert indices in transposed form, a row for each row of ``points`` (unsigned integers)."""
    x = points.astype(np.uint64).copy()
    n = x.shape[1]
    for level in range(bits - 1, 0, -1):
        q, low = np.uint64(1 << level), np.uint64((1 << level) - 1)
        for i in range(n):
            high = (x[:, i] & q) != 0
            swap = np.where(high, np.uint64(0), (x[:, 0] ^ x[:, i]) & low)
            x[:, 0] ^= np.where(high, low, swap)
            x[:, i] ^= swap if i else np.uint64(0)
    for i in range(1, n):
        x[:, i] ^= x[:, i - 1]
    flips = np.zeros(len(x), np.uint64)
    for level in range(bits - 1, 0, -1):
        flips ^= np.where((x[:, -1] & np.uint64(1 << level)) != 0, np.uint64((1 << level) - 1), np.uint64(0))
    return x ^ flips[:, None]


def hex_keys(points: np.ndarray, bits: int = BITS) -> list[str]:
    """The bits of a transposed index, interleaved from the top, as hex digits."""
    x = transposed(points, bits)
    planes = [(x >> np.uint64(b)) & np.uint64(1) for b in range(bits - 1, -1, -1)]
    flat = np.concatenate(planes, axis=1).astype(np.uint8)
    pad = -flat.shape[1] % 4
    flat = np.hstack((np.zeros((len(flat), pad), np.uint8), flat))
    width = flat.shape[1] // 4
    packed = np.packbits(np.hstack((flat, np.zeros((len(flat), flat.shape[1] % 8), np.uint8))), axis=1)
    return [row.tobytes().hex()[:width] for row in packed]


def encode(unit: np.ndarray, order: list[int], bits: int = BITS) -> list[str]:
    top = float((1 << bits) - 1)
    return hex_keys(np.rint(np.clip(unit[:, order], 0.0, 1.0) * top).astype(np.uint64), bits)


def probe_keys(df: DataFrame, id_col: str, vector_col: str, curves: int, bits: int = BITS) -> DataFrame:
    """``curve, hkey, <id>``: a row for each point and curve; null and empty vectors have none, nor
    have those with a component that is null or not finite."""
    from ..operators.neighbors import by_length, usable

    ship(df.sparkSession)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, unit in by_length(batch):
                for c, order in enumerate(permutations(unit.shape[1], curves)):
                    yield pa.record_batch([pa.array([c] * len(ids), pa.int32()), pa.array(encode(unit, order, bits)), pa.array(ids)], ["curve", "hkey", id_col])

    rows = df.filter(F.col(id_col).isNotNull() & usable(vector_col)).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    return rows.mapInArrow(keys, f"curve int, hkey string, {id_col} long")


def curve_of(key: Column) -> Column:
    """The curve digit of a composed key ``{curve}{hkey}|{json}``."""
    return F.conv(F.substring(key, 1, 1), 16, 10).cast("int")


def key_of(key: Column) -> Column:
    return F.substring_index(key, "|", 1)


def payload_of(key: Column) -> Column:
    """What follows the first bar; null without one."""
    at = F.locate("|", key)
    return F.when(at > 0, F.substring(key, at + 1, F.length(key)))
