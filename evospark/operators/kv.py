"""An ordered key/value table as DataFrames: ``k`` is compared as a string, ``v`` is the value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def get(table: DataFrame, key: str) -> DataFrame:
    return table.filter(F.col("k") == key)


def upsert(table: DataFrame, changes: DataFrame) -> DataFrame:
    """``changes`` (k, v, seq): the last write of a key wins, keys without one stay."""
    last = changes.groupBy("k").agg(F.max_by("v", "seq").alias("v"))
    return table.join(last, "k", "left_anti").select("k", "v").unionByName(last)


def delete(table: DataFrame, keys: DataFrame) -> DataFrame:
    return table.join(keys, "k", "left_anti")


def range_scan(table: DataFrame, start: str, count: int, inclusive: bool = True) -> DataFrame:
    """``count`` entries from ``start`` on, or after it, in key order."""
    from_start = F.col("k") >= start if inclusive else F.col("k") > start
    return table.filter(from_start).orderBy("k").limit(count)


def scatter_range(parts: list[DataFrame], start: str, count: int) -> DataFrame:
    """The range over several nodes' tables; of a key that several hold, the first node's."""
    rows = None
    for node, part in enumerate(parts):
        own = part.filter(F.col("k") >= start).select("k", "v", F.lit(node).alias("node"))
        rows = own if rows is None else rows.unionByName(own)
    return rows.groupBy("k").agg(F.min_by("v", "node").alias("v")).orderBy("k").limit(count)


def cluster_keys(parts: list[DataFrame]) -> DataFrame:
    rows = parts[0].select("k")
    for part in parts[1:]:
        rows = rows.union(part.select("k"))
    return rows.distinct()


def routed_put(tables: DataFrame, changes: DataFrame) -> DataFrame:
    """``k, v, node``: each change (k, v, seq, node) is written on the node that owns its key; a node
    that held the key before without owning it keeps nothing of it."""
    last = changes.groupBy("k").agg(F.max_by(F.struct("v", "node"), "seq").alias("c"))
    return tables.join(last, "k", "left_anti").select("k", "v", "node").unionByName(last.select("k", "c.v", "c.node"))


def routed_delete(tables: DataFrame, keys: DataFrame) -> DataFrame:
    """``k, v, node`` without the entries that the owners (node) of ``keys`` hold."""
    return tables.join(keys.select("k", "node"), ["k", "node"], "left_anti").select("k", "v", "node")


class Table:
    """A durable table: Parquet under ``path``, sorted by key, with metadata beside it."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def read(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/data")

    def write(self, rows: DataFrame, partitions: int | None = None) -> None:
        """Range-partitioned and sorted, so that key bounds prune files and row groups."""
        placed = rows.repartitionByRange(partitions, "k") if partitions else rows.repartitionByRange("k")
        placed.sortWithinPartitions("k").write.mode("overwrite").parquet(f"{self.path}/data")

    def put_meta(self, name: str, value: str) -> None:
        self.spark.createDataFrame([(name, value)], "name string, value string").write.mode("overwrite").parquet(f"{self.path}/meta/name={name}")

    def get_meta(self, name: str) -> str | None:
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/meta/name={name}")
        if not hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
            return None
        return self.spark.read.parquet(f"{self.path}/meta/name={name}").first()["value"]


def latest(rows: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(*keys).orderBy(order.desc())
    return rows.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")
