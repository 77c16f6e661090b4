"""Queries on selection, retention and sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import select as S
from ..registry import query
from .base import EVAL_SQL, G_SQL, evaluated, genomes, r6, table


@query("survivors", f"WITH {EVAL_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY generation ORDER BY fitness DESC, vec_id) AS rn, count(*) OVER (PARTITION BY generation) AS n FROM ev) SELECT generation, vec_id, round(fitness, 6) AS fitness FROM r WHERE rn <= greatest(2, floor(n * 0.2))")
def survivors(spark, d):
    return S.survivors(evaluated(spark, d), "fitness", "vec_id", ["generation"], 0.2).select("generation", "vec_id", r6("fitness").alias("fitness"))


@query("migrants", f"WITH {EVAL_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY island ORDER BY fitness DESC, vec_id) AS rn FROM ev) SELECT island, (island + 1) % 4 AS target, vec_id, round(fitness, 6) AS fitness FROM r WHERE rn <= 3")
def migrants(spark, d):
    top = S.top_per(evaluated(spark, d), ["island"], [F.desc("fitness"), F.asc("vec_id")], 3)
    return top.select("island", ((F.col("island") + 1) % 4).alias("target"), "vec_id", r6("fitness").alias("fitness"))


@query("immigrate", f"WITH {EVAL_SQL}, home AS (SELECT * FROM ev WHERE island = 0), came AS (SELECT * FROM ev WHERE island = 1 ORDER BY fitness DESC, vec_id LIMIT 3), stay AS (SELECT * FROM home ORDER BY fitness DESC, vec_id LIMIT 17) SELECT 'replace' AS mode, vec_id FROM (SELECT vec_id FROM stay UNION ALL SELECT vec_id FROM came) UNION ALL SELECT 'as_written', vec_id FROM (SELECT vec_id FROM home ORDER BY vec_id LIMIT 20)")
def immigrate(spark, d):
    e = evaluated(spark, d)
    home, came = e.filter("island = 0"), e.filter("island = 1").orderBy(F.desc("fitness"), "vec_id").limit(3)
    a = S.immigrate(home, came, 20, "fitness", "vec_id").select(F.lit("replace").alias("mode"), "vec_id")
    return a.union(S.immigrate(home, came, 20, "fitness", "vec_id", as_written=True).select(F.lit("as_written").alias("mode"), "vec_id"))


@query("linspace_sample", f"WITH {G_SQL}, r AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS i, count(*) OVER (PARTITION BY label) AS n FROM gen), w AS (SELECT *, [floor(j * (n - 1) / 9.0)::BIGINT FOR j IN range(10)] AS wanted FROM r) SELECT label, vec_id FROM w WHERE n <= 10 OR list_contains(wanted, i)")
def linspace_sample(spark, d):
    return S.evenly_spaced(genomes(spark, d).select("label", "vec_id"), "vec_id", ["label"], 10)


@query("pareto", "SELECT DISTINCT p_size, p_retailprice FROM part a WHERE NOT EXISTS (SELECT 1 FROM part b WHERE b.p_size >= a.p_size AND b.p_retailprice <= a.p_retailprice AND (b.p_size > a.p_size OR b.p_retailprice < a.p_retailprice))")
def pareto(spark, d):
    return S.pareto(table(spark, d, "part"), "p_size", "p_retailprice")


@query("split_602020", "WITH n AS (SELECT count(*) AS n FROM orders) SELECT unnest(['train', 'validation', 'test']) AS part, unnest([n * 6 // 10, n * 2 // 10, n - n * 6 // 10 - n * 2 // 10]) AS rows, true AS disjoint FROM n")
def split_602020(spark, d):
    split = S.split_by_hash(table(spark, d, "orders").select("o_orderkey"), "o_orderkey")
    return split.groupBy("part").agg(F.count("*").alias("rows"), (F.count("*") == F.countDistinct("o_orderkey")).alias("disjoint"))


@query("lhs")
def lhs(spark, d):
    """A Latin hypercube of 200 points in ten dimensions."""
    return S.latin_hypercube(spark, 200, 10)


@query("random_population")
def random_population(spark, d):
    """A seeded uniform population."""
    return S.random_population(spark, 500, 10)


@query("fifo_window", "SELECT event_id, value FROM events ORDER BY event_id DESC LIMIT 1000")
def fifo_window(spark, d):
    return S.sliding_window(table(spark, d, "events").select("event_id", "value"), "event_id", 1000)


@query("log_ring", "WITH r AS (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS rn, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT event_type, event_id FROM r WHERE rn <= CASE WHEN n <= 1250 THEN n ELSE 800 + (n - 1251) % 451 END")
def log_ring(spark, d):
    return S.bulk_trim(table(spark, d, "events").select("event_type", "event_id"), "event_id", ["event_type"], 1000)


@query("ttl_evict", f"WITH {EVAL_SQL} SELECT vec_id FROM ev WHERE greatest(9 - generation, 0) <= 5")
def ttl_evict(spark, d):
    return S.ttl(evaluated(spark, d), "generation", 9, 5).select("vec_id")


@query("genome_dedup", f"WITH {G_SQL}, x AS (SELECT vec_id, g FROM gen UNION ALL SELECT vec_id + 1000000, [v + 1e-9 FOR v IN g] FROM gen WHERE vec_id % 3 = 0), k AS (SELECT vec_id, [round(v, 6) FOR v IN g] AS key FROM x WHERE len(g) = 10) SELECT min(vec_id) AS vec_id FROM k GROUP BY key")
def genome_dedup(spark, d):
    g = genomes(spark, d).select("vec_id", "g")
    both = g.union(g.filter("vec_id % 3 = 0").select(F.col("vec_id") + 1000000, F.transform("g", lambda v: v + 1e-9))).filter(F.size("g") == 10)
    return S.first_seen(both, F.transform("g", lambda v: F.round(v, 6)), "vec_id").select("vec_id")


@query("oat_grid", f"WITH {G_SQL}, m AS (SELECT list_avg([g[1] FOR g IN l]) AS m FROM (SELECT list(g) AS l FROM gen)), grid AS (SELECT i AS dim, j AS step FROM range(10) a(i), range(11) b(j)) SELECT dim::INT AS dim, step::INT AS step, round(15.0 / (1.0 + 3.0 * ((step / 10.0 - 0.5) * (step / 10.0 - 0.5))), 6) AS response FROM grid")
def oat_grid(spark, d):
    from ..functions import vectors as V

    grid = spark.range(110).select(F.expr("cast(id div 11 as int)").alias("dim"), F.expr("cast(id % 11 as int)").alias("step"))
    point = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda k: F.when(k == F.col("dim"), F.col("step") / 10.0).otherwise(0.5))
    return grid.select("dim", "step", r6(V.sphere(point)).alias("response"))
