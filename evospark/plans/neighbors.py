"""Queries on neighbours, tiers and vector functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import curve
from ..functions import vectors as V
from ..operators import neighbors as N
from ..operators import tiering as T
from ..registry import query
from .base import CACHE_SQL, DIMS, EVAL_SQL, G_SQL, POP_SQL, cache, evaluated, genomes, population, r6

DIST = "list_distance(p.g, c.sg)"
NN_SQL = f"nn AS (SELECT * FROM (SELECT query_id, store_id, {DIST} AS d, row_number() OVER (PARTITION BY query_id ORDER BY {DIST}, store_id) AS rank FROM pop p, cache c)"
EXACT_SQL = "exact AS (SELECT query_id, min(store_id) AS exact_id FROM pop p LEFT JOIN cache c ON p.g = c.sg GROUP BY query_id)"
TIERS_SQL = f"""{POP_SQL}, {NN_SQL} WHERE rank = 1), {EXACT_SQL},
tiers AS (SELECT e.query_id, CASE WHEN exact_id IS NOT NULL OR d < 0.005 THEN 'T1' WHEN d <= 0.15 THEN 'T2' ELSE 'T3' END AS tier, store_id AS nn_id, d FROM exact e LEFT JOIN nn USING (query_id))"""


@query("tier_partition", f"WITH {TIERS_SQL} SELECT query_id, tier, nn_id, round(d, 6) AS d FROM tiers")
def tier_partition(spark, d):
    return T.partition(population(spark, d), cache(spark, d)).select("query_id", "tier", "nn_id", r6("d").alias("d"))


@query("tier_metrics", f"WITH {TIERS_SQL}, c AS (SELECT count(*) FILTER (tier = 'T1') AS t1, count(*) FILTER (tier = 'T2') AS t2, count(*) FILTER (tier = 'T3') AS t3, count(*) AS total FROM tiers) SELECT t1, t2, t3, total, round(t1::DOUBLE / total, 6) AS t1_ratio, round(t2::DOUBLE / total, 6) AS t2_ratio, round(t3::DOUBLE / total, 6) AS t3_ratio, round((t1 + t2)::DOUBLE / total, 6) AS bypass_ratio FROM c")
def tier_metrics(spark, d):
    m = T.metrics(T.partition(population(spark, d), cache(spark, d)))
    return m.select("t1", "t2", "t3", "total", *(r6(c).alias(c) for c in ("t1_ratio", "t2_ratio", "t3_ratio", "bypass_ratio")))


GENS_SQL = f"{TIERS_SQL}, pg AS (SELECT (query_id % 1000000) // 50 AS generation, count(*) FILTER (tier = 'T1') AS t1, count(*) FILTER (tier = 'T2') AS t2, count(*) FILTER (tier = 'T3') AS t3, count(*) AS total FROM tiers GROUP BY 1)"


def _by_generation(spark, d):
    tiers = T.partition(population(spark, d), cache(spark, d)).withColumn("generation", F.expr("(query_id % 1000000) div 50"))
    return tiers.groupBy("generation").agg(*(F.count_if(F.col("tier") == t).alias(t.lower()) for t in ("T1", "T2", "T3")), F.count("*").alias("total"))


@query("tier_deltas", f"WITH {GENS_SQL} SELECT generation, t1 AS t1_total_delta, t2 AS t2_total_delta, t3 AS t3_total_delta FROM pg")
def tier_deltas(spark, d):
    from pyspark.sql.window import Window

    w = Window.orderBy("generation").rowsBetween(Window.unboundedPreceding, 0)
    counters = _by_generation(spark, d).select("generation", *(F.sum(c).over(w).alias(f"{c}_total") for c in ("t1", "t2", "t3")))
    return T.deltas(counters, "generation", ["t1_total", "t2_total", "t3_total"], [])


@query("tier_cost_model", f"WITH {TIERS_SQL}, c AS (SELECT count(*) FILTER (tier = 'T2') AS t2, count(*) FILTER (tier = 'T3') AS t3, count(*) AS total FROM tiers) SELECT round(total * 200.0::DOUBLE, 6) AS one_tier_ms, round(total * 80.0::DOUBLE / 1000 + (t2 + t3) * 200.0::DOUBLE, 6) AS two_tier_ms, round(total * 80.0::DOUBLE / 1000 + t2 * 20.0::DOUBLE / 1000 + t3 * 200.0::DOUBLE, 6) AS three_tier_ms, round(total * 200.0::DOUBLE / (total * 80.0::DOUBLE / 1000 + t2 * 20.0::DOUBLE / 1000 + t3 * 200.0::DOUBLE), 6) AS speedup FROM c")
def tier_cost_model(spark, d):
    m = T.cost_model(T.metrics(T.partition(population(spark, d), cache(spark, d))))
    return m.select(*(r6(c).alias(c) for c in m.columns))


@query("tier_cumulative", f"WITH {GENS_SQL}, r AS (SELECT generation, sum(t3) OVER (ORDER BY generation) AS actual, sum(total) OVER (ORDER BY generation) AS naive FROM pg) SELECT generation, actual::BIGINT AS actual, naive::BIGINT AS naive, round(100.0 * (1.0 - actual::DOUBLE / naive::DOUBLE), 6) AS saved_percent FROM r")
def tier_cumulative(spark, d):
    return T.cumulative(_by_generation(spark, d), "generation").withColumn("saved_percent", r6("saved_percent"))


@query("knn_exact", f"WITH {POP_SQL}, {NN_SQL} WHERE rank <= 10) SELECT query_id, store_id, round(d, 6) AS d, rank FROM nn")
def knn_exact(spark, d):
    return N.knn(population(spark, d), cache(spark, d), 10).select("query_id", "store_id", r6("d").alias("d"), F.col("rank").cast("long").alias("rank"))


# Vectors that are null, shorter, or hold a null or a NaN, on both sides.
ODD_SQL = f"""{POP_SQL}, oq AS (SELECT query_id, CASE query_id % 7 WHEN 0 THEN NULL WHEN 1 THEN g[1:6] WHEN 2 THEN list_concat(g[1:9], [NULL]) WHEN 3 THEN list_concat(g[1:9], ['nan'::DOUBLE]) ELSE g END AS g FROM pop),
oc AS (SELECT store_id, CASE store_id % 10 WHEN 0 THEN NULL WHEN 2 THEN sg[1:8] WHEN 4 THEN [] ELSE sg END AS sg FROM cache),
uq AS (SELECT * FROM oq WHERE len(g) > 0 AND list_bool_and([x IS NOT NULL AND isfinite(x) FOR x IN g])), uc AS (SELECT * FROM oc WHERE len(sg) > 0),
near AS (SELECT query_id, store_id, d, row_number() OVER (PARTITION BY query_id ORDER BY d, store_id) AS rank FROM (SELECT query_id, store_id, list_distance(g[1:least(len(g), len(sg))], sg[1:least(len(g), len(sg))]) AS d FROM uq, uc))"""


def _odd(spark, d):
    by = lambda i, n: F.col(i) % n
    q, tail = by("query_id", 7), lambda x: F.concat(F.slice("g", 1, 9), F.array(F.lit(x).cast("double")))
    pop = population(spark, d).withColumn("g", F.when(q == 0, None).when(q == 1, F.slice("g", 1, 6)).when(q == 2, tail(None)).when(q == 3, tail(float("nan"))).otherwise(F.col("g")))
    c, none = by("store_id", 10), F.array().cast("array<double>")
    return pop, cache(spark, d).withColumn("sg", F.when(c == 0, None).when(c == 2, F.slice("sg", 1, 8)).when(c == 4, none).otherwise(F.col("sg")))


@query("knn_odd_vectors", f"WITH {ODD_SQL} SELECT query_id, store_id, round(d, 6) AS d, rank FROM near WHERE rank <= 5")
def knn_odd_vectors(spark, d):
    """Neighbours where vectors are missing, shorter or not finite."""
    return N.knn(*_odd(spark, d), 5).select("query_id", "store_id", r6("d").alias("d"), F.col("rank").cast("long").alias("rank"))


@query("tier_odd_vectors", f"WITH {ODD_SQL}, ex AS (SELECT oq.query_id, min(store_id) AS exact_id FROM oq LEFT JOIN uc ON oq.g = uc.sg GROUP BY 1) SELECT ex.query_id, CASE WHEN exact_id IS NOT NULL OR d < 0.005 THEN 'T1' WHEN d <= 0.15 THEN 'T2' ELSE 'T3' END AS tier, store_id AS nn_id, round(d, 6) AS d FROM ex LEFT JOIN near ON near.query_id = ex.query_id AND rank = 1")
def tier_odd_vectors(spark, d):
    """Tiers where vectors are missing, shorter or not finite: without a neighbour, the third."""
    return T.partition(*_odd(spark, d)).select("query_id", "tier", "nn_id", r6("d").alias("d"))


@query("lookup_exact", f"WITH {POP_SQL}, {EXACT_SQL} SELECT query_id, exact_id FROM exact")
def lookup_exact(spark, d):
    return N.lookup_exact(population(spark, d), cache(spark, d))


@query("nn_local_first", f"WITH {POP_SQL}, loc AS (SELECT * FROM cache WHERE store_id % 4 = 0 AND store_id < 0), rem AS (SELECT * FROM cache WHERE store_id % 4 <> 0), r AS (SELECT query_id, store_id, list_distance(p.g, c.sg) AS d, row_number() OVER (PARTITION BY query_id ORDER BY list_distance(p.g, c.sg), store_id) AS rk FROM pop p, rem c) SELECT query_id, store_id AS nn_id, round(d, 6) AS d, false AS is_local FROM r WHERE rk = 1 UNION ALL SELECT query_id, store_id, round(d, 6), true FROM (SELECT query_id + 10000000 AS query_id, store_id, list_distance(p.g, c.sg) AS d, row_number() OVER (PARTITION BY query_id ORDER BY list_distance(p.g, c.sg), store_id) AS rk FROM pop p, (SELECT * FROM cache WHERE store_id % 4 = 0) c) WHERE rk = 1")
def nn_local_first(spark, d):
    pop, store = population(spark, d), cache(spark, d)
    local, remote = store.filter("store_id % 4 = 0"), store.filter("store_id % 4 <> 0")
    empty = N.nearest_local_first(pop, local.filter("store_id < 0"), remote)
    full = N.nearest_local_first(pop, local, remote).withColumn("query_id", F.col("query_id") + 10000000)
    return empty.union(full).withColumn("d", r6("d"))


@query("pairwise_dist", f"WITH {G_SQL} SELECT a.vec_id AS a, b.vec_id AS b, round(list_distance(a.g, b.g), 6) AS d, abs(a.vec_id - b.vec_id) AS line FROM gen a, gen b WHERE a.vec_id < b.vec_id")
def pairwise_dist(spark, d):
    points = genomes(spark, d).select(F.col("vec_id").alias("id"), F.col("g").alias("v"))
    return N.pairwise(points).select("a", "b", r6("d").alias("d"), F.abs(F.col("a") - F.col("b")).alias("line"))


@query("radius_pairs", f"WITH {G_SQL} SELECT a.vec_id AS a, b.vec_id AS b, round(list_distance(a.g, b.g), 6) AS d FROM gen a, gen b WHERE a.vec_id < b.vec_id AND list_distance(a.g, b.g) < 0.40")
def radius_pairs(spark, d):
    """All pairs of near neighbours, by an epsilon grid."""
    points = genomes(spark, d).select(F.col("vec_id").alias("id"), F.col("g").alias("v"))
    return N.radius_pairs(points, 0.40).select("a", "b", r6("d").alias("d"))


@query("knn_regress", f"WITH {POP_SQL}, {NN_SQL} WHERE rank <= 5) SELECT query_id, round(sum(label / (d + 1e-12)) / sum(1.0 / (d + 1e-12)), 6) AS prediction, round(avg(d), 6) AS mean_distance FROM nn JOIN cache USING (store_id) GROUP BY query_id")
def knn_regress(spark, d):
    store = cache(spark, d)
    out = N.knn_regress(N.knn(population(spark, d), store, 5), store.select("store_id", F.col("label").cast("double").alias("y")))
    return out.select("query_id", r6("prediction").alias("prediction"), r6("mean_distance").alias("mean_distance"))


def _keys(spark, d, curves):
    store, pop = cache(spark, d), population(spark, d)
    keys = curve.probe_keys(store, "store_id", "sg", curves)
    asked = curve.probe_keys(pop, "query_id", "g", curves)
    return store, pop, keys, asked


# Hilbert keys in SQL: the points of a table ``src`` (id, stored, v), quantized in each curve's order,
# turned step by step (level from the top, dimension by dimension) and written as hex.
CURVES = 3
_ORDERS = ", ".join(f"({c}, {[i + 1 for i in order]})" for c, order in enumerate(curve.permutations(DIMS, CURVES)))
KEYS_SQL = f"""orders_of AS (SELECT * FROM (VALUES {_ORDERS}) o(curve, places)),
turned AS (SELECT id, stored, curve, 0 AS step, [round_even(greatest(least(v[i], 1.0), 0.0) * 65535.0, 0)::BIGINT FOR i IN places] AS x FROM src, orders_of
 UNION ALL SELECT id, stored, curve, step + 1, [CASE WHEN k = 1 THEN xor(x[1], CASE WHEN high THEN low ELSE swap END) WHEN k = dim THEN xor(x[k], swap) ELSE x[k] END FOR k IN range(1, {DIMS + 1})]
 FROM (SELECT *, CASE WHEN high THEN 0 ELSE xor(x[1], x[dim]) & low END AS swap FROM (SELECT *, ((x[dim] >> lv) & 1) = 1 AS high, (1::BIGINT << lv) - 1 AS low FROM (SELECT *, 15 - step // {DIMS} AS lv, step % {DIMS} + 1 AS dim FROM turned WHERE step < {15 * DIMS})))),
gray AS (SELECT id, stored, curve, [list_aggregate(x[1:k], 'bit_xor') FOR k IN range(1, {DIMS + 1})] AS x FROM turned WHERE step = {15 * DIMS}),
flipped AS (SELECT *, list_aggregate([CASE WHEN ((x[{DIMS}] >> l) & 1) = 1 THEN (1::BIGINT << l) - 1 ELSE 0 END FOR l IN range(1, 16)], 'bit_xor') AS flips FROM gray),
index_of AS (SELECT id, stored, curve, [xor(t, flips) FOR t IN x] AS x FROM flipped),
keyed AS (SELECT id, stored, curve, array_to_string([substr('0123456789abcdef', (8 * b[4 * h + 1] + 4 * b[4 * h + 2] + 2 * b[4 * h + 3] + b[4 * h + 4] + 1)::BIGINT, 1) FOR h IN range(0, {4 * DIMS})], '') AS hkey
 FROM (SELECT id, stored, curve, [(x[n % {DIMS} + 1] >> (15 - n // {DIMS})) & 1 FOR n IN range(0, {16 * DIMS})] AS b FROM index_of))"""
PROBE_SQL = f"""{POP_SQL}, src AS (SELECT query_id AS id, 0 AS stored, g AS v FROM pop UNION ALL SELECT store_id, 1, sg FROM cache), {KEYS_SQL},
placed AS (SELECT *, sum(stored) OVER (PARTITION BY curve ORDER BY hkey, stored, id ROWS UNBOUNDED PRECEDING) AS place FROM keyed)"""


def _probed(name: str, window: int, curves: int = CURVES, both_ways: bool = False) -> str:
    """The ten nearest of what a probe of a window finds, as a table of SQL."""
    low = 1 - window if both_ways else 1
    return f"""{name} AS (SELECT * FROM (SELECT query_id, store_id, {DIST} AS d, row_number() OVER (PARTITION BY query_id ORDER BY {DIST}, store_id) AS rank FROM
 (SELECT DISTINCT q.id AS query_id, e.id AS store_id FROM placed q JOIN placed e ON e.curve = q.curve AND e.place - q.place BETWEEN {low} AND {window} WHERE q.stored = 0 AND e.stored = 1 AND q.curve < {curves}) f JOIN pop p USING (query_id) JOIN cache c USING (store_id)) WHERE rank <= 10)"""


@query("probe_keys", f"WITH RECURSIVE {G_SQL}, src AS (SELECT vec_id AS id, 0 AS stored, g AS v FROM gen), {KEYS_SQL} SELECT curve, hkey, id AS vec_id FROM keyed")
def probe_keys(spark, d):
    """Keys of every genome along three curves."""
    return curve.probe_keys(genomes(spark, d), "vec_id", "g", 3)


@query("knn_multiprobe", f"WITH RECURSIVE {PROBE_SQL}, {_probed('f', 10)} SELECT query_id, store_id, round(d, 6) AS d, rank FROM f")
def knn_multiprobe(spark, d):
    """Ten nearest by forward scans of three curves."""
    store, pop, keys, asked = _keys(spark, d, 3)
    return N.rerank(N.probe(keys, asked, 10), pop, store, 10).select("query_id", "store_id", r6("d").alias("d"), "rank")


@query("knn_bidirectional", f"WITH RECURSIVE {PROBE_SQL}, {_probed('f', 20, both_ways=True)} SELECT query_id, store_id, round(d, 6) AS d, rank FROM f")
def knn_bidirectional(spark, d):
    """Ten nearest by scans of twenty entries either way along three curves."""
    store, pop, keys, asked = _keys(spark, d, 3)
    return N.rerank(N.probe(keys, asked, 20, both_ways=True), pop, store, 10).select("query_id", "store_id", r6("d").alias("d"), "rank")


def _modes(spark, d):
    store, pop, keys, asked = _keys(spark, d, 3)
    one = lambda f: f.filter("curve = 0")
    runs = {
        "single": N.probe(one(keys), one(asked), 10),
        "single_wide": N.probe(one(keys), one(asked), 40),
        "multi_forward": N.probe(keys, asked, 10),
        "multi_bidirectional": N.probe(keys, asked, 10, both_ways=True),
    }
    out = None
    for mode, candidates in runs.items():
        part = N.rerank(candidates, pop, store, 10).select(F.lit(mode).alias("mode"), "query_id", "store_id", "d")
        out = part if out is None else out.union(part)
    return pop, store, out


MODES_SQL = f"""WITH RECURSIVE {PROBE_SQL}, {_probed('a', 10, 1)}, {_probed('b', 40, 1)}, {_probed('e', 10)}, {_probed('h', 10, both_ways=True)}, {NN_SQL} WHERE rank <= 10),
found AS (SELECT 'single' AS mode, * FROM a UNION ALL SELECT 'single_wide', * FROM b UNION ALL SELECT 'multi_forward', * FROM e UNION ALL SELECT 'multi_bidirectional', * FROM h)
SELECT mode, round(count(n.store_id) / (SELECT count(*) FROM nn)::DOUBLE, 6) AS recall, round(avg(f.d), 6) AS mean_distance FROM found f LEFT JOIN nn n ON n.query_id = f.query_id AND n.store_id = f.store_id GROUP BY mode"""


@query("knn_modes", MODES_SQL)
def knn_modes(spark, d):
    """Recall at ten of four retrieval modes against the exact answer."""
    pop, store, found = _modes(spark, d)
    truth = N.knn(pop, store, 10).select("query_id", "store_id", F.lit(1).alias("hit"))
    total = truth.agg(F.count("*").alias("total"))  # one row
    hits = found.join(truth, ["query_id", "store_id"], "left").groupBy("mode").agg(F.count("hit").alias("hits"), r6(F.avg("d")).alias("mean_distance"))
    return hits.join(F.broadcast(total)).select("mode", r6(F.col("hits") / F.col("total")).alias("recall"), "mean_distance")


@query("probe_quality", f"""WITH RECURSIVE {PROBE_SQL}, {_probed('f', 20, both_ways=True)}, {NN_SQL} WHERE rank <= 10), near AS (SELECT nn.query_id, avg(nn.d) AS gt, count(f.store_id) AS hits, max(CASE WHEN nn.rank = 1 AND f.store_id IS NOT NULL THEN 1 ELSE 0 END)::INT AS top1 FROM nn LEFT JOIN f ON f.query_id = nn.query_id AND f.store_id = nn.store_id GROUP BY 1),
got AS (SELECT query_id, avg(d) AS got FROM f GROUP BY 1), rnd AS (SELECT query_id, avg({DIST}) AS rnd FROM pop p, cache c GROUP BY 1)
SELECT query_id, round(hits / 10.0::DOUBLE, 6) AS recall, top1, round(greatest(0.0, least(1.0, 1.0 - (got - gt) / greatest(rnd - gt, 1e-12))), 6) AS quality FROM near JOIN got USING (query_id) JOIN rnd USING (query_id)""")
def probe_quality(spark, d):
    """Recall at ten, first hit and quality of the search along three curves, for each query."""
    store, pop, keys, asked = _keys(spark, d, CURVES)
    found = N.rerank(N.probe(keys, asked, 20, both_ways=True), pop, store, 10)
    hits = found.select("query_id", "store_id", F.lit(1).alias("hit"))
    first = F.max(F.when((F.col("rank") == 1) & F.col("hit").isNotNull(), 1).otherwise(0))
    near = N.knn(pop, store, 10).join(hits, ["query_id", "store_id"], "left").groupBy("query_id").agg(F.avg("d").alias("gt"), r6(F.count("hit") / F.lit(10.0)).alias("recall"), first.alias("top1"))
    got = found.groupBy("query_id").agg(F.avg("d").alias("got"))
    rows = near.join(got, "query_id").join(N.mean_distance(pop, store).withColumnRenamed("mean_distance", "rnd"), "query_id")
    score = 1.0 - (F.col("got") - F.col("gt")) / F.greatest(F.col("rnd") - F.col("gt"), F.lit(1e-12))
    return rows.select("query_id", "recall", "top1", r6(V.clip01(score)).alias("quality"))


# An approximate search: the nearest by the first four dimensions, then the distance by all.
ROUGH_SQL = "ro AS (SELECT query_id, store_id, d FROM (SELECT query_id, store_id, list_distance(p.g, c.sg) AS d, row_number() OVER (PARTITION BY query_id ORDER BY list_distance(p.g[1:4], c.sg[1:4]), store_id) AS r4 FROM pop p, cache c) WHERE r4 <= 10)"


def _rough(spark, d):
    pop, store = population(spark, d), cache(spark, d)
    found = N.knn(pop.withColumn("g", F.slice("g", 1, 4)), store.withColumn("sg", F.slice("sg", 1, 4)), 10).select("query_id", "store_id")
    return pop, store, N.rerank(found, pop, store, 10)


@query("recall_at_k", f"WITH {POP_SQL}, {NN_SQL} WHERE rank <= 10), {ROUGH_SQL} SELECT query_id, round(count(r.store_id) / 10.0::DOUBLE, 6) AS recall, coalesce(max(CASE WHEN rank = 1 AND r.store_id IS NOT NULL THEN 1 ELSE 0 END), 0)::INT AS top1 FROM nn LEFT JOIN ro r USING (query_id, store_id) GROUP BY query_id")
def recall_at_k(spark, d):
    pop, store, rough = _rough(spark, d)
    joined = N.knn(pop, store, 10).join(rough.select("query_id", "store_id", F.lit(1).alias("hit")), ["query_id", "store_id"], "left")
    return joined.groupBy("query_id").agg(r6(F.count("hit") / F.lit(10.0)).alias("recall"), F.max(F.when((F.col("rank") == 1) & F.col("hit").isNotNull(), 1).otherwise(0)).alias("top1"))


@query("quality_score", f"""WITH {POP_SQL}, {NN_SQL} WHERE rank <= 10), {ROUGH_SQL}, gt AS (SELECT query_id, avg(d) AS gt FROM nn GROUP BY query_id), got AS (SELECT query_id, avg(d) AS got FROM ro GROUP BY query_id), rnd AS (SELECT query_id, avg(list_distance(p.g, c.sg)) AS rnd FROM pop p, cache c GROUP BY query_id)
SELECT query_id, round(greatest(0.0, least(1.0, 1.0 - (got - gt) / greatest(rnd - gt, 1e-12))), 6) AS quality FROM gt JOIN got USING (query_id) JOIN rnd USING (query_id)""")
def quality_score(spark, d):
    pop, store, rough = _rough(spark, d)
    near = N.knn(pop, store, 10).groupBy("query_id").agg(F.avg("d").alias("gt"))
    got = rough.groupBy("query_id").agg(F.avg("d").alias("got"))
    every = N.mean_distance(pop, store).withColumnRenamed("mean_distance", "rnd")
    score = 1.0 - (F.col("got") - F.col("gt")) / F.greatest(F.col("rnd") - F.col("gt"), F.lit(1e-12))
    return near.join(got, "query_id").join(every, "query_id").select("query_id", r6(V.clip01(score)).alias("quality"))


@query("l2", f"WITH {G_SQL} SELECT vec_id, round(list_distance(g, [0.5 FOR x IN g]), 6) AS d, round(list_distance(g[1:4], [0.5::DOUBLE, 0.5, 0.5, 0.5]), 6) AS d_short FROM gen")
def l2(spark, d):
    return genomes(spark, d).select("vec_id", r6(V.l2(F.col("g"), V.vec(*[0.5] * 10))).alias("d"), r6(V.l2(F.col("g"), V.vec(*[0.5] * 4))).alias("d_short"))


@query("scaled_dist", f"WITH {G_SQL} SELECT vec_id, round(list_sum([power((x - 0.5) / 0.3, 2) FOR x IN g]), 6) AS d2 FROM gen")
def scaled_dist(spark, d):
    return genomes(spark, d).select("vec_id", r6(V.scaled_squared(F.col("g"), V.vec(*[0.5] * 10), V.vec(*[0.3] * 10))).alias("d2"))


@query("quantize", f"WITH {G_SQL} SELECT vec_id, [round_even(greatest(least(x, 1.0), 0.0) * 65535.0, 0)::BIGINT FOR x IN g]::VARCHAR AS q FROM gen")
def quantize(spark, d):
    return genomes(spark, d).select("vec_id", F.concat(F.lit("["), F.array_join(F.transform("g", lambda x: V.quantize(x).cast("string")), ", "), F.lit("]")).alias("q"))


@query("sphere_fitness", f"WITH {EVAL_SQL} SELECT vec_id, round(fitness, 6) AS fitness FROM ev")
def sphere_fitness(spark, d):
    return evaluated(spark, d).select("vec_id", r6("fitness").alias("fitness"))


@query("matern52", f"WITH {G_SQL}, r AS (SELECT vec_id, list_distance(g, [0.5 FOR x IN g]) AS r FROM gen) SELECT vec_id, round(2.5 * (1.0 + sqrt(5.0) * r + 5.0 * r * r / 3.0) * exp(-sqrt(5.0) * r), 6) AS matern, round(2.5 * exp(-0.5 * r * r), 6) AS rbf FROM r")
def matern52(spark, d):
    r = V.l2(F.col("g"), V.vec(*[0.5] * 10))
    return genomes(spark, d).select("vec_id", r6(V.matern52(r, 2.5)).alias("matern"), r6(V.rbf(r, 2.5)).alias("rbf"))


@query("activations", """WITH x AS (SELECT event_id, (value - 50) / 25 AS x FROM events), s AS (SELECT *, 1.0 / (1.0 + exp(-x)) AS s, tanh(sqrt(2.0 / pi()) * (x + 0.044715 * x * x * x)) AS i FROM x)
SELECT event_id, round(greatest(x, 0.0), 6) AS relu, CASE WHEN x > 0 THEN 1.0::DOUBLE ELSE 0.0 END AS relu_d, round(x * s, 6) AS silu, round(s * (1.0 + x * (1.0 - s)), 6) AS silu_d, round(0.5 * x * (1.0 + i), 6) AS gelu, round(0.5 * (1.0 + i) + 0.5 * x * (1.0 - i * i) * sqrt(2.0 / pi()) * (1.0 + 3 * 0.044715 * x * x), 6) AS gelu_d, round(tanh(x), 6) AS tanh, round(1.0 - tanh(x) * tanh(x), 6) AS tanh_d FROM s""")
def activations(spark, d):
    from .base import table

    e = table(spark, d, "events").select("event_id", ((F.col("value") - 50) / 25).alias("x"))
    return e.select("event_id", *(r6(c).alias(n) for n, c in V.activations(F.col("x")).items()))
