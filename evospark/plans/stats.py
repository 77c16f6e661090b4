"""Queries on statistics, distributions and series."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import stats as S
from ..operators.slices import ranked
from ..registry import query
from .base import EVAL_SQL, G_SQL, evaluated, genomes, r6, table

# Every user's events are a run; its steps are numbered by time.
RUN_SQL = "runs AS (SELECT user_id % 8 AS run, row_number() OVER (PARTITION BY user_id % 8 ORDER BY event_id) - 1 AS step, event_id, value FROM events)"


def runs(spark, d):
    e = table(spark, d, "events").select((F.col("user_id") % 8).alias("run"), "event_id", "value")
    return ranked(e, "event_id", "event_id", ["run"]).select("run", "event_id", "value", F.col("_rank").cast("bigint").alias("step"))


@query("fitness_stats", f"WITH {EVAL_SQL} SELECT generation, round(max(fitness), 6) AS best, round(avg(fitness), 6) AS avg, round(min(fitness), 6) AS worst, round(stddev_pop(fitness), 6) AS std FROM ev GROUP BY generation")
def fitness_stats(spark, d):
    s = S.fitness_stats(evaluated(spark, d), "fitness", ["generation"])
    return s.select("generation", *(r6(c).alias(c) for c in ("best", "avg", "worst", "std")))


@query("gene_variance", f"WITH {G_SQL}, x AS (SELECT label, unnest(range(10)) AS dim, unnest(g) AS x FROM gen) SELECT label, dim::INT AS dim, round(coalesce(var_samp(x), 0), 6) AS variance FROM x GROUP BY label, dim")
def gene_variance(spark, d):
    return S.gene_variance(genomes(spark, d), "g", ["label"]).withColumn("variance", r6("variance"))


@query("population_entropy", f"WITH {G_SQL}, x AS (SELECT unnest(range(10)) AS dim, unnest(g) AS x FROM gen), c AS (SELECT dim, least(floor(greatest(least(x, 1.0), 0.0) * 10), 9) AS b, count(*) AS c FROM x GROUP BY 1, 2), h AS (SELECT dim, -sum(c / t * ln(c / t)) / ln(10) AS h FROM (SELECT *, sum(c) OVER (PARTITION BY dim) AS t FROM c) GROUP BY dim) SELECT round(avg(h), 6) AS entropy FROM h")
def population_entropy(spark, d):
    return S.population_entropy(genomes(spark, d), "g").select(r6("entropy").alias("entropy"))


@query("best_candidate", f"WITH {EVAL_SQL} SELECT generation, vec_id, round(fitness, 6) AS fitness FROM (SELECT *, row_number() OVER (PARTITION BY generation ORDER BY fitness DESC, vec_id DESC) AS rn FROM ev) WHERE rn = 1")
def best_candidate(spark, d):
    return S.best_row(evaluated(spark, d), "fitness", "vec_id", ["vec_id", "fitness"], ["generation"]).withColumn("fitness", r6("fitness"))


@query("best_run", f"WITH {EVAL_SQL} SELECT island, vec_id, round(fitness, 6) AS fitness FROM ev ORDER BY fitness DESC, vec_id LIMIT 1")
def best_run(spark, d):
    return S.best_row(evaluated(spark, d), "fitness", "vec_id", ["island", "vec_id", "fitness"], last=False).withColumn("fitness", r6("fitness"))


BEST_SQL = f"{EVAL_SQL}, b AS (SELECT island, generation, max(fitness) AS best FROM ev GROUP BY 1, 2)"


def best_by_generation(spark, d):
    return evaluated(spark, d).groupBy("island", "generation").agg(F.max("fitness").alias("best"))


@query("best_so_far", f"WITH {BEST_SQL} SELECT island, generation, round(max(best) OVER (PARTITION BY island ORDER BY generation), 6) AS best_ever FROM b")
def best_so_far(spark, d):
    w = Window.partitionBy("island").orderBy("generation").rowsBetween(Window.unboundedPreceding, 0)
    return best_by_generation(spark, d).select("island", "generation", r6(F.max("best").over(w)).alias("best_ever"))


STAG_SQL = f"""WITH RECURSIVE {BEST_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY island ORDER BY generation) AS rn FROM b),
f AS (SELECT island, generation, rn, best AS last, 0 AS stagnant FROM o WHERE rn = 1 UNION ALL SELECT o.island, o.generation, o.rn, CASE WHEN o.best > f.last + 0.01 THEN o.best ELSE f.last END, CASE WHEN o.best > f.last + 0.01 THEN 0 ELSE f.stagnant + 1 END FROM f JOIN o ON o.island = f.island AND o.rn = f.rn + 1)
SELECT island, generation AS step, stagnant, stagnant >= 3 AND generation >= 2 AS stop FROM f"""


@query("stagnation", STAG_SQL)
def stagnation(spark, d):
    return S.stagnation(best_by_generation(spark, d), ["island"], "generation", "best", 3, 0.01, 2)


@query("convergence_gen", f"WITH {EVAL_SQL}, g AS (SELECT generation, max(fitness) AS best FROM ev GROUP BY 1) SELECT round(max(best), 6) AS best, min(generation) FILTER (best >= 9.0) AS converged FROM g")
def convergence_gen(spark, d):
    g = evaluated(spark, d).groupBy("generation").agg(F.max("fitness").alias("best"))
    return g.agg(r6(F.max("best")).alias("best"), F.min(F.when(F.col("best") >= 9.0, F.col("generation"))).alias("converged"))


def _ribbon_sql(shortest: bool) -> str:
    end = "WHERE step <= (SELECT min(m) FROM (SELECT max(step) AS m FROM runs GROUP BY run))" if shortest else ""
    return f"WITH {RUN_SQL} SELECT step, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, min(value) AS low, max(value) AS high, count(*) AS runs FROM runs {end} GROUP BY step"


@query("ribbon_min", _ribbon_sql(True))
def ribbon_min(spark, d):
    return S.ribbon(runs(spark, d), "run", "step", "value", True).withColumns({"mean": r6("mean"), "std": r6("std")})


@query("ribbon_ragged", _ribbon_sql(False))
def ribbon_ragged(spark, d):
    return S.ribbon(runs(spark, d), "run", "step", "value", False).withColumns({"mean": r6("mean"), "std": r6("std")})


SHARES = {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95, "p99": 0.99}


@query("latency_percentiles", "SELECT event_type, " + ", ".join(f"round(quantile_cont(value, {p}), 6) AS {n}" for n, p in SHARES.items()) + " FROM events GROUP BY event_type")
def latency_percentiles(spark, d):
    p = S.percentiles(table(spark, d, "events"), "value", SHARES, ["event_type"])
    return p.select("event_type", *(r6(n).alias(n) for n in SHARES))


@query("ecdf", "SELECT event_type, event_id, round(row_number() OVER (PARTITION BY event_type ORDER BY value, event_id)::DOUBLE / count(*) OVER (PARTITION BY event_type), 6) AS cdf FROM events")
def ecdf(spark, d):
    return S.ecdf(table(spark, d, "events"), "value", "event_id", ["event_type"]).select("event_type", "event_id", r6("cdf").alias("cdf"))


@query("jain_index", "WITH u AS (SELECT user_id, count(*)::DOUBLE AS n FROM events GROUP BY 1) SELECT round(sum(n) * sum(n) / (count(*) * sum(n * n)), 6) AS fairness FROM u")
def jain_index(spark, d):
    return S.jain(table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n")), "n").select(r6("fairness").alias("fairness"))


@query("locality_stats", f"WITH {EVAL_SQL}, q AS (SELECT vec_id, fitness, list_distance(g, [0.5 FOR x IN g]) AS r FROM ev) SELECT round(corr(r, fitness), 6) AS corr, round(median(r), 6) AS median_r, round(quantile_cont(r, 0.9) FILTER (fitness > 7), 6) AS p90_near, round(avg(r) / greatest(min(r), 1e-5), 6) AS ratio FROM q")
def locality_stats(spark, d):
    from ..functions import vectors as V

    q = evaluated(spark, d).select("fitness", V.l2(F.col("g"), V.vec(*[0.5] * 10)).alias("r"))
    whole = q.agg(r6(F.corr("r", "fitness")).alias("corr"), r6(F.avg("r") / F.greatest(F.min("r"), F.lit(1e-5))).alias("ratio"))
    median, near = S.percentiles(q, "r", {"median_r": 0.5}), S.percentiles(q.filter("fitness > 7"), "r", {"p90_near": 0.9})
    one = lambda df, name: F.broadcast(df.agg(r6(F.max(name)).alias(name)))
    return whole.join(one(median, "median_r")).join(one(near, "p90_near"))


@query("ols_fit", "SELECT p_brand, round(regr_slope(p_retailprice, p_size), 6) AS slope, round(regr_intercept(p_retailprice, p_size), 6) AS intercept FROM part GROUP BY p_brand HAVING count(DISTINCT p_size) > 1")
def ols_fit(spark, d):
    p = table(spark, d, "part").withColumn("p_size", F.col("p_size").cast("double"))
    many = p.groupBy("p_brand").agg(F.countDistinct("p_size").alias("c")).filter("c > 1")
    return S.ols(p.join(many, "p_brand", "left_semi"), "p_size", "p_retailprice", ["p_brand"]).select("p_brand", r6("slope").alias("slope"), r6("intercept").alias("intercept"))


@query("regression_metrics", "WITH x AS (SELECT l_returnflag, l_extendedprice AS y, l_quantity * 1500.0::DOUBLE AS p FROM lineitem), m AS (SELECT l_returnflag, avg(y) AS mean FROM x GROUP BY 1) SELECT l_returnflag, round(1 - sum((y - p) * (y - p)) / sum((y - mean) * (y - mean)), 6) AS r2, round(sqrt(avg((y - p) * (y - p))), 4) AS rmse, round(avg(abs(y - p)), 4) AS mae, round(max(abs(y - p)), 4) AS max_residual FROM x JOIN m USING (l_returnflag) GROUP BY l_returnflag")
def regression_metrics(spark, d):
    x = table(spark, d, "lineitem").select("l_returnflag", F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1500.0).alias("p"))
    m = S.regression_metrics(x, "y", "p", ["l_returnflag"])
    return m.select("l_returnflag", r6("r2").alias("r2"), *(F.round(c, 4).alias(c) for c in ("rmse", "mae", "max_residual")))


@query("scaling_table", "WITH w AS (SELECT l_linenumber AS workers, sum(l_quantity) AS work FROM lineitem GROUP BY 1), b AS (SELECT work AS base FROM w WHERE workers = 1) SELECT workers, work, round(base / work, 6) AS speedup, round(100 * base / work / workers, 6) AS efficiency, round(100 / work, 6) AS throughput FROM w, b")
def scaling_table(spark, d):
    w = table(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("workers")).agg(F.sum("l_quantity").alias("work"))
    base = F.broadcast(w.filter("workers = 1").select(F.col("work").alias("base")))
    return w.join(base).select("workers", "work", r6(F.col("base") / F.col("work")).alias("speedup"), r6(100 * F.col("base") / F.col("work") / F.col("workers")).alias("efficiency"), r6(100 / F.col("work")).alias("throughput"))


@query("scaler_fit", f"WITH {G_SQL}, x AS (SELECT unnest(range(10)) AS dim, unnest(g) AS x FROM gen) SELECT dim::INT AS dim, round(avg(x), 6) AS mean, round(CASE WHEN stddev_pop(x) > 1e-8 THEN stddev_pop(x) ELSE 1 END, 6) AS std FROM x GROUP BY dim")
def scaler_fit(spark, d):
    return S.scaler(genomes(spark, d), "g").select("dim", r6("mean").alias("mean"), r6("std").alias("std"))


@query("target_scale", f"WITH {EVAL_SQL}, s AS (SELECT avg(fitness) AS m, stddev_pop(fitness) AS s FROM ev) SELECT vec_id, round((fitness - m) / s, 6) AS z, round((fitness - m) / s * s + m, 6) AS back, round(0.25 * s * s, 6) AS variance FROM ev, s")
def target_scale(spark, d):
    e = evaluated(spark, d)
    s = F.broadcast(S.scaler(e.select(F.array("fitness").alias("y")), "y").select(F.col("mean").alias("m"), F.col("std").alias("s")))
    z = (F.col("fitness") - F.col("m")) / F.col("s")
    return e.join(s).select("vec_id", r6(z).alias("z"), r6(z * F.col("s") + F.col("m")).alias("back"), r6(0.25 * F.col("s") * F.col("s")).alias("variance"))


@query("upper_median", "SELECT event_type, list_sort(list(value))[count(*) // 2 + 1] AS m FROM events GROUP BY event_type")
def upper_median(spark, d):
    # the middle, or the upper one of two: a partial aggregate, unlike a sorted list
    return table(spark, d, "events").groupBy("event_type").agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY value DESC)").alias("m"))


@query("histogram", "WITH b AS (SELECT min(value) AS lo, max(value) AS hi, count(*) AS t FROM events), h AS (SELECT least(floor((value - lo) / ((hi - lo) / 20)), 19)::BIGINT AS cell, count(*) AS n FROM events, b GROUP BY 1) SELECT cell, round(lo + cell * (hi - lo) / 20, 6) AS low, n, round(n / (t * (hi - lo) / 20), 6) AS density FROM h, b")
def histogram(spark, d):
    return S.histogram(table(spark, d, "events"), "value", 20).select(F.col("cell").cast("bigint").alias("cell"), r6("low").alias("low"), "n", r6("density").alias("density"))


@query("density2d", "WITH b AS (SELECT min(p_size) AS x0, max(p_size) AS x1, min(p_retailprice) AS y0, max(p_retailprice) AS y1 FROM part) SELECT least(floor((p_size - x0)::DOUBLE / (x1 - x0) * 8), 7)::BIGINT AS cx, least(floor((p_retailprice - y0) / (y1 - y0) * 8), 7)::BIGINT AS cy, count(*) AS n, round(ln(1 + count(*)), 6) AS log_n FROM part, b GROUP BY 1, 2")
def density2d(spark, d):
    return S.density2d(table(spark, d, "part"), "p_size", "p_retailprice", 8).select(F.col("cx").cast("bigint").alias("cx"), F.col("cy").cast("bigint").alias("cy"), "n", r6("log_n").alias("log_n"))


@query("ratio_to_max", "SELECT p_partkey, round(p_size / max(p_size) OVER (), 6) AS size_share, round(p_retailprice / max(p_retailprice) OVER (), 6) AS price_share FROM part")
def ratio_to_max(spark, d):
    p = table(spark, d, "part")
    top = F.broadcast(p.agg(F.max("p_size").alias("s"), F.max("p_retailprice").alias("r")))
    return p.join(top).select("p_partkey", r6(F.col("p_size") / F.col("s")).alias("size_share"), r6(F.col("p_retailprice") / F.col("r")).alias("price_share"))


@query("mse_from_r2", f"WITH {EVAL_SQL}, v AS (SELECT var_pop(fitness) AS v FROM ev), r AS (SELECT unnest([0.2, 0.5, 0.9, 0.999])::DOUBLE AS r2) SELECT r2, round(v * greatest(0.01, 1 - r2), 6) AS mse FROM v, r")
def mse_from_r2(spark, d):
    v = evaluated(spark, d).agg(F.var_pop("fitness").alias("v"))
    return v.select(F.explode(F.array(*(F.lit(x) for x in (0.2, 0.5, 0.9, 0.999)))).alias("r2"), "v").select("r2", r6(F.col("v") * F.greatest(F.lit(0.01), 1 - F.col("r2"))).alias("mse"))


@query("relevance_rank", f"WITH {G_SQL}, x AS (SELECT unnest(range(10)) AS dim, unnest(g) AS x FROM gen), l AS (SELECT dim::INT AS dim, stddev_pop(x) * 1.5 AS scale FROM x GROUP BY 1) SELECT dim, round(1 / (scale * scale) / sum(1 / (scale * scale)) OVER (), 6) AS relevance, row_number() OVER (ORDER BY 1 / (scale * scale) DESC, dim)::INT AS rank FROM l")
def relevance_rank(spark, d):
    s = S.scaler(genomes(spark, d), "g").select("dim", (1 / (F.col("std") * 1.5 * F.col("std") * 1.5)).alias("r"))
    return s.select("dim", r6(F.col("r") / F.sum("r").over(Window.partitionBy())).alias("relevance"), F.row_number().over(Window.orderBy(F.desc("r"), "dim")).alias("rank"))


@query("marginal_gain", f"WITH {BEST_SQL} SELECT island, generation, round(best - lag(best, 1, 0.0) OVER (PARTITION BY island ORDER BY generation), 6) AS gain FROM b")
def marginal_gain(spark, d):
    w = Window.partitionBy("island").orderBy("generation")
    return best_by_generation(spark, d).select("island", "generation", r6(F.col("best") - F.lag("best", 1, 0.0).over(w)).alias("gain"))


@query("gradient", f"WITH {BEST_SQL}, n AS (SELECT *, coalesce(lag(generation) OVER w, generation) AS x0, coalesce(lead(generation) OVER w, generation) AS x1, coalesce(lag(best) OVER w, best) AS y0, coalesce(lead(best) OVER w, best) AS y1 FROM b WINDOW w AS (PARTITION BY island ORDER BY generation)) SELECT island, generation, round((y1 - y0) / (x1 - x0), 6) AS gradient FROM n WHERE x1 <> x0")
def gradient(spark, d):
    return S.gradient(best_by_generation(spark, d), ["island"], "generation", "best").filter("gradient is not null").select("island", "generation", r6("gradient").alias("gradient"))


@query("rr_counts", "WITH x AS (SELECT event_type, (row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1) % 4 AS worker FROM events) SELECT event_type, worker, count(*) AS n FROM x GROUP BY 1, 2")
def rr_counts(spark, d):
    rows = ranked(table(spark, d, "events").select("event_type", "event_id"), "event_id", "event_id", ["event_type"])
    return rows.select("event_type", (F.col("_rank") % 4).cast("bigint").alias("worker")).groupBy("event_type", "worker").agg(F.count("*").alias("n"))


@query("queue_backlog")
def queue_backlog(spark, d):
    """Latencies of both balancing policies over every user's requests."""
    q = S.queue_backlog(table(spark, d, "events"), "event_id", "value", 4, ["user_id"])
    return q.select("user_id", "i", r6("round_robin").alias("round_robin"), r6("least_request").alias("least_request"))


@query("bootstrap_scaling")
def bootstrap_scaling(spark, d):
    """Seconds of a generation of 100 for one to eight workers, from latencies drawn from all events."""
    e = table(spark, d, "events").filter("value is not null").select("event_id", F.col("value").alias("ms"), F.lit(1).alias("one"))
    pool = S.running(e, "event_id", {"rank": "one"}).select((F.col("rank") - 1).alias("slot"), "ms")
    n = F.broadcast(e.agg(F.count("*").alias("n")).filter("n > 0"))
    draws = spark.range(8).select((F.col("id") + 1).alias("workers"), F.explode(F.sequence(F.lit(0), F.lit(99))).alias("item"))
    draws = draws.join(n).select("workers", (F.col("item") % F.col("workers")).alias("worker"), F.pmod(F.xxhash64("workers", "item", F.lit(42)), F.col("n")).alias("slot"))
    each = draws.join(pool, "slot").groupBy("workers", "worker").agg(F.sum("ms").alias("busy"))
    return each.groupBy("workers").agg(r6(F.max("busy") / 1000).alias("seconds"))
