"""The generational loop: immigrate, evaluate by tiers, evict, record, emigrate, stop or go on."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.vectors import clip01, sphere
from ..models import surrogates
from ..protocols import Evaluator, Surrogate
from ..session import shared_path
from . import select as S
from . import stats
from . import tiering as T

#: Fitness that stands for a rejected point.
REJECTED = -1e8


def landscape(rows: DataFrame) -> DataFrame:
    """The dependency-free evaluator: adds ``fitness`` to rows with ``g``."""
    return rows.withColumn("fitness", sphere(F.col("g")))


def gaussian(*parts: Column) -> Column:
    """A normal deviate that depends on its arguments alone (Box and Muller)."""
    u = F.greatest(S.unit_hash(F.lit(1), *parts), F.lit(1e-12))
    return F.sqrt(-2.0 * F.log(u)) * F.cos(2.0 * 3.141592653589793 * S.unit_hash(F.lit(2), *parts))


def reproduce(survivors: DataFrame, size: int, sigma: float, seed: int, by: str = "island") -> DataFrame:
    """Survivors stay; the rest are mutants of survivors picked by hash, with noise on every gene."""
    ranked = survivors.select(by, "g", (F.row_number().over(Window.partitionBy(by).orderBy(F.desc("fitness"), "slot")) - 1).alias("slot"))
    counts = ranked.groupBy(by).agg(F.count("*").alias("n"))
    missing = counts.filter(F.col("n") < size).select(by, "n", F.explode(F.sequence(F.col("n"), F.lit(size - 1).cast("bigint"))).alias("slot"))
    parents = missing.withColumn("parent", F.pmod(F.xxhash64(F.lit(seed), by, "slot"), F.col("n")))
    joined = parents.join(ranked.select(by, F.col("slot").cast("bigint").alias("parent"), "g"), [by, "parent"])
    child = F.transform("g", lambda x, i: clip01(x + sigma * gaussian(F.lit(seed), F.col(by), F.col("slot"), i)))
    return ranked.select(by, F.col("slot").cast("bigint").alias("slot"), "g").union(joined.select(by, "slot", child.alias("g")))


@dataclass(frozen=True)
class Settings:
    islands: int = 2
    size: int = 20
    dims: int = 10
    elite: float = 0.2
    sigma: float = 0.08
    generations: int = 6
    interval: int = 2
    migrants: int = 2
    max_age: int = 5
    patience: int = 0
    min_improvement: float = 1e-4
    min_generations: int = 3
    seed: int = 42
    window: int = 1_000
    least: int = 100
    fresh: int = 20


def _kept(df: DataFrame, name: str) -> DataFrame:
    """A snapshot in the shared folder: generations don't pile up lineage, and lost executors cost
    a read."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class SurrogateWindow:
    """The newest evaluated points, and the model that was trained on them last: anew when enough
    have come since, once the window is large enough."""

    def __init__(self, make: Callable[[], Surrogate], cap: int, least: int, fresh: int):
        self.make, self.cap, self.least, self.fresh = make, cap, least, fresh
        self.x, self.y, self.new, self.version, self.model = [], [], 0, 0, None

    def ingest(self, scored: DataFrame) -> None:
        """Points that weren't rejected, the oldest going first; at most ``cap`` come to the driver."""
        rows = scored.filter(F.col("fitness") > REJECTED).orderBy(F.desc("query_id")).limit(self.cap).select("query_id", "g", "fitness").orderBy("query_id").collect()
        self.x, self.y = [*self.x, *(r["g"] for r in rows)][-self.cap :], [*self.y, *(r["fitness"] for r in rows)][-self.cap :]
        self.new += len(rows)
        if self.new >= self.fresh and len(self.y) >= self.least:
            self.model, _ = surrogates.train(self.make(), np.array(self.x), np.array(self.y))
            self.version, self.new = self.version + 1, 0

    def predict(self, rows: DataFrame) -> DataFrame | None:
        """``query_id, fitness``, or None while there is no model."""
        return None if self.model is None else surrogates.predict(rows, self.model, "g", ("query_id",)).select("query_id", F.col("mean").alias("fitness"))


def run(spark: SparkSession, settings: Settings = Settings(), evaluator: Evaluator = landscape, surrogate: Callable[[], Surrogate] | None = surrogates.GaussianProcess) -> DataFrame:
    """One row per island and generation: ``best, avg, worst, std, entropy, t1, t2, t3, stagnant,
    model``, the version of the surrogate that predicted.

    Points that the cache holds, or nearly holds, take its fitness (tier 1). Points near a stored one
    take the surrogate's prediction (tier 2); while it isn't ready, all of them are evaluated. The
    others are evaluated (tier 3), stored and fed to the surrogate's window. A generation sees cache
    and model as they stood before it.
    """
    s = settings
    start = spark.range(s.islands * s.size).select((F.col("id") % s.islands).alias("island"), F.expr(f"id div {s.islands}").alias("slot"))
    pop = start.withColumn("g", F.array(*(S.unit_hash(F.lit(s.seed), F.lit(k), F.col("island"), F.col("slot")) for k in range(s.dims))))
    store = spark.createDataFrame([], "store_id bigint, sg array<double>, fitness double, generation int, last_accessed int")
    history: DataFrame | None = None
    best, stagnant, mailbox = float("-inf"), 0, None
    window = surrogate and SurrogateWindow(surrogate, s.window, s.least, s.fresh)
    for generation in range(s.generations):
        if mailbox is not None:
            came = mailbox.withColumn("slot", F.lit(s.size) - F.row_number().over(Window.partitionBy("island").orderBy("slot")))
            pop = pop.join(came.select("island", "slot"), ["island", "slot"], "left_anti").unionByName(came.select("island", "slot", "g"))
        pop = _kept(pop.withColumn("query_id", F.col("island") * 1_000_000 + F.col("slot")), "population")
        tiers = _kept(T.partition(pop, store), "tiers")
        known = tiers.filter("tier = 'T1'").join(store.select(F.col("store_id").alias("nn_id"), "fitness"), "nn_id").select("query_id", "fitness")
        predicted = window and window.predict(pop.join(tiers.filter("tier = 'T2'").select("query_id"), "query_id"))
        version = window.version if predicted is not None else 0
        if predicted is None:
            tiers = tiers.withColumn("tier", F.when(F.col("tier") == "T2", "T3").otherwise(F.col("tier")))
        else:
            known = known.union(predicted)
        fresh = evaluator(pop.join(tiers.filter("tier = 'T3'").select("query_id", "tier"), "query_id"))
        scored = _kept(pop.join(known.union(fresh.select("query_id", "fitness")), "query_id").join(tiers.select("query_id", "tier"), "query_id"), "scored")
        if window:
            window.ingest(scored.filter("tier = 'T3'"))
        touched = tiers.filter("tier = 'T1'").select(F.col("nn_id").alias("store_id")).distinct().withColumn("now", F.lit(generation))
        aged = store.join(touched, "store_id", "left").select("store_id", "sg", "fitness", "generation", F.coalesce("now", "last_accessed").alias("last_accessed"))
        added = scored.filter("tier = 'T3'").select((F.lit(generation) * 100_000_000 + F.col("query_id")).cast("bigint").alias("store_id"), F.col("g").alias("sg"), "fitness", F.lit(generation).alias("generation"), F.lit(generation).alias("last_accessed"))
        store = _kept(S.ttl(aged.unionByName(added), "last_accessed", generation, s.max_age), "cache")
        by_tier = scored.groupBy("island").agg(*(F.count_if(F.col("tier") == t).alias(t.lower()) for t in ("T1", "T2", "T3")))
        record = stats.fitness_stats(scored, "fitness", ["island"]).join(stats.population_entropy(scored, "g", 10, ["island"]), "island").join(by_tier, "island")
        top = scored.agg(F.max("fitness")).first()[0]
        stagnant = 0 if top > best + s.min_improvement else stagnant + 1
        best = top if stagnant == 0 else best
        record = _kept(record.withColumn("generation", F.lit(generation)).withColumn("stagnant", F.lit(stagnant)).withColumn("model", F.lit(version)), "telemetry")
        history = record if history is None else history.unionByName(record)
        if s.patience and stagnant >= s.patience and generation >= s.min_generations:
            break
        mailbox = None
        if s.interval and s.islands > 1 and (generation + 1) % s.interval == 0:
            gone = S.top_per(scored, ["island"], [F.desc("fitness"), F.asc("slot")], s.migrants)
            mailbox = gone.select(((F.col("island") + 1) % s.islands).alias("island"), "slot", "g")
        pop = reproduce(S.survivors(scored, "fitness", "slot", ["island"], s.elite), s.size, s.sigma, s.seed + generation + 1)
    return history
