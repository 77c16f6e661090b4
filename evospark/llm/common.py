"""Shared helpers: tables kept in the shared folder, bounded Arrow chunks, byte-level hashing.

The operators take any DataFrame and name their id and text columns. Null text counts as the
empty text everywhere; columns that an operator does not need are dropped before its first
step, so extra columns and clashing names never reach a join.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_path, ship

#: Bytes of text that one vectorised step holds at once; a longer text is a step of its own.
CHUNK_BYTES = 500_000

try:
    _libc = ctypes.CDLL("libc.so.6")
except OSError:  # another C library
    _libc = None


def stored(df: DataFrame, name: str, options: dict[str, str] | None = None) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: lineage ends there, and a lost
    executor costs no more than the reading tasks. ``options`` are the writer's."""
    path = shared_path(df.sparkSession, name)
    df.write.options(**(options or {})).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores, if its scan would leave some idle: an input below one split a core is
    dealt out anew, which moves no more than that; a larger one stays where it is read."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if cores > 1 and size < cores * spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes() else df


def pick(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id`` and ``text`` alone, with null text as the empty text."""
    ship(df.sparkSession)
    return spread(df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")))


def chunks(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` whose ``column`` holds at most ``limit`` bytes, or one row."""
    if batch.num_rows == 0:
        return
    sizes = np.asarray(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    ends = np.cumsum(sizes)
    at = 0
    while at < batch.num_rows:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(at, to - at)
        at = to


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of a string column without nulls, and the n + 1 offsets of its rows."""
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, ends - ends[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E6C63D0876A9A47)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xD2A98B26625EEE7B)
    return x ^ (x >> np.uint64(32))


_MULT = 0x5851F42D4C957F2D
_INV = pow(_MULT, -1, 1 << 64)
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))


_powers: dict[int, np.ndarray] = {}


def powers(n: int, base: int = _MULT) -> np.ndarray:
    """The first n powers of ``base``; a worker keeps those of a chunk's length."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, CHUNK_BYTES + 1), base, dtype=np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if n <= 2 * CHUNK_BYTES:
            _powers[base] = have
    return have[:n]


def release() -> None:
    """Gives freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


def lean(f):
    """``f`` over Arrow batches; what its libraries keep of freed memory goes back at the end."""

    def run(batches):
        try:
            yield from f(batches)
        finally:
            release()

    return run


class RollingHash:
    """64-bit polynomial hashes of any substring of ``raw`` from prefix sums."""

    def __init__(self, raw: np.ndarray):
        n = len(raw)
        self.prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[raw] * powers(n), out=self.prefix[1:])
        self.inverse = powers(n + 1, _INV)

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.prefix[end] - self.prefix[start]) * self.inverse[start] + (end - start).astype(np.uint64))


#: The separators of words: space and \x09 to \x0D.
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def words_of(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every maximal run of non-separators; runs never cross rows."""
    if not len(raw):
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = ~_SPACE[raw]
    first = np.zeros(len(raw) + 1, bool)
    first[offsets[:-1]] = True
    begin = inside & (np.concatenate(([True], ~inside[:-1])) | first[:-1])
    start = np.flatnonzero(begin)
    last = inside & np.concatenate((~inside[1:] | first[1:-1], [True]))
    end = np.flatnonzero(last) + 1
    return start, end, np.searchsorted(offsets, start, side="right") - 1


def to_signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
