"""A fixed-size bit filter over ids, to spare later passes the rows that nobody asks for.

Its size doesn't depend on the data. Two ids may share a bit, so a set bit means "maybe" and costs
time only, while an unset bit means "surely not".
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean

FILTER_BITS = 1 << 24


def bits_of(ids: DataFrame) -> np.ndarray:
    """The filter of a column ``id``."""
    return set_bits(ids.select(F.pmod(F.xxhash64("id"), F.lit(FILTER_BITS)).alias("bit")))


def set_bits(bits: DataFrame) -> np.ndarray:
    """The filter of a column ``bit``: FILTER_BITS / 64 rows at most come to the driver."""
    words = bits.selectExpr("bit div 64 as word", "shiftleft(1L, cast(bit % 64 as int)) as mask").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    out = np.zeros(FILTER_BITS // 64, np.int64)
    out[words.column("word").to_numpy()] = words.column("mask").to_numpy()
    return out


def with_bit(rows: DataFrame) -> DataFrame:
    return rows.withColumn("bit", F.pmod(F.xxhash64("id"), F.lit(FILTER_BITS)))


def are_set(words: np.ndarray, bit: np.ndarray) -> np.ndarray:
    return (words[bit >> 6] >> (bit & 63)) & 1 == 1


def is_set(words: np.ndarray, batch: pa.RecordBatch) -> np.ndarray:
    return are_set(words, batch.column("bit").to_numpy())


def keep(rows: DataFrame, words: np.ndarray) -> DataFrame:
    """The rows ``id, text`` whose bit is set."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(is_set(words, batch))).select(["id", "text"])

    return with_bit(rows.select("id", "text")).mapInArrow(run, "id long, text string")
