"""Tables and derived fixtures that the registered queries share, and their SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V

DIMS = 10


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def genomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``vec_id, label, g``: the first ten components, moved into [0, 1]."""
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", "label", F.transform(F.slice("embedding", 1, DIMS), lambda x: (x.cast("double") + 1.0) / 2.0).alias("g"))


def cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The store of evaluated points: even ids."""
    return genomes(spark, sf_dir).filter("vec_id % 2 = 0").select(F.col("vec_id").alias("store_id"), F.col("g").alias("sg"), "label")


def population(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Odd ids, exact copies of some stored points and copies shifted by 0.001."""
    g = genomes(spark, sf_dir)
    odd = g.filter("vec_id % 2 = 1").select(F.col("vec_id").alias("query_id"), "g")
    exact = g.filter("vec_id % 10 = 0").select((F.col("vec_id") + 1000000).alias("query_id"), "g")
    near = g.filter("vec_id % 10 = 2").select((F.col("vec_id") + 2000000).alias("query_id"), F.transform("g", lambda x: x + 0.001).alias("g"))
    return odd.union(exact).union(near)


def evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``vec_id, label, g, fitness, generation, island``: genomes with the landscape's fitness."""
    return genomes(spark, sf_dir).select("*", V.sphere(F.col("g")).alias("fitness"), F.expr("cast(vec_id div 50 as bigint)").alias("generation"), F.expr("cast(vec_id % 4 as bigint)").alias("island"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ordered key/value table: ``k`` a 16-digit hex key, ``v`` its value."""
    return table(spark, sf_dir, "orders").select(hex16(F.col("o_orderkey")).alias("k"), F.col("o_orderpriority").alias("v"))


def hex16(x: Column) -> Column:
    return F.lpad(F.lower(F.hex(x)), 16, "0")


def r6(x: Column | str) -> Column:
    return F.round(x, 6)


# The same fixtures for the oracle, to be put after WITH.
G_SQL = "gen AS (SELECT vec_id, label, [(x::DOUBLE + 1.0) / 2.0 FOR x IN embedding[1:10]] AS g FROM embeddings)"
CACHE_SQL = f"{G_SQL}, cache AS (SELECT vec_id AS store_id, g AS sg, label FROM gen WHERE vec_id % 2 = 0)"
POP_SQL = f"""{CACHE_SQL}, pop AS (SELECT vec_id AS query_id, g FROM gen WHERE vec_id % 2 = 1
 UNION ALL SELECT vec_id + 1000000, g FROM gen WHERE vec_id % 10 = 0
 UNION ALL SELECT vec_id + 2000000, [x + 0.001 FOR x IN g] FROM gen WHERE vec_id % 10 = 2)"""
SPHERE_SQL = "15.0::DOUBLE / (1.0 + 3.0 * list_sum([(x - 0.5) * (x - 0.5) FOR x IN g]))"
EVAL_SQL = f"{G_SQL}, ev AS (SELECT vec_id, label, g, {SPHERE_SQL} AS fitness, (vec_id // 50)::BIGINT AS generation, (vec_id % 4)::BIGINT AS island FROM gen)"
KV_SQL = "kv AS (SELECT lpad(lower(to_hex(o_orderkey)), 16, '0') AS k, o_orderpriority AS v FROM orders)"
