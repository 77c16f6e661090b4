"""Queries on surrogates, missions and the generational loop."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import functions as F

from ..functions import airframe as A
from ..functions import vectors as V
from ..models import distributed as D
from ..models import mission as X
from ..models import surrogates as M
from ..operators import evolution as E
from ..operators import neighbors as N
from ..operators import tiering as T
from ..operators.stats import regression_metrics, scaler
from ..registry import query
from .base import DIMS, EVAL_SQL, cache, evaluated, genomes, population, r6

#: Generations that a stored point serves in a replay.
MAX_AGE = 5
#: Rows of the online surrogates' training window, and the most that a Gaussian process trains on.
WINDOW = 1_000


def window(spark, d):
    """The latest evaluated points, as the sliding window holds them."""
    rows = evaluated(spark, d).orderBy(F.desc("vec_id")).limit(WINDOW).select("vec_id", "g", "fitness").orderBy("vec_id").collect()
    return np.array([r["g"] for r in rows]), np.array([r["fitness"] for r in rows])


def arrays(df):
    """``g`` and ``fitness`` of a table, in the order of ``vec_id``, without vectors of another length
    than the first or that aren't finite; 88 bytes a row on the driver."""
    t = df.select("vec_id", "g", "fitness").filter("fitness is not null").orderBy("vec_id").toArrow()
    known, x = M.matrix(t.column("g").combine_chunks()) if t.num_rows else (np.zeros(0, bool), np.zeros((0, 1)))
    return x, t.column("fitness").to_numpy()[known]


def parts(spark, d, *shares):
    """The whole table with ``part``, dealt by hash of the id; the shares are in tenths."""
    at = F.pmod(F.xxhash64("vec_id", F.lit(42)), F.lit(10))
    edges = np.cumsum(shares).tolist()
    part = F.lit(len(edges) - 1)
    for i, edge in reversed(list(enumerate(edges[:-1]))):
        part = F.when(at < edge, i).otherwise(part)
    return evaluated(spark, d).select("vec_id", "g", "fitness", part.alias("part"))


def latest(rows):
    """What a Gaussian process trains on: the newest WINDOW rows."""
    return rows.orderBy(F.desc("vec_id")).limit(WINDOW)


def scored(rows, model):
    """Metrics over a table of any size."""
    return regression_metrics(M.predict(rows, model, "g", ("fitness",)), "fitness", "mean")


def _predictions(spark, d, model):
    x, y = window(spark, d)
    model, _ = M.train(model, x, y)
    return M.predict(genomes(spark, d), model, "g", ("vec_id",)).select("vec_id", r6("mean").alias("mean"), r6("variance").alias("variance"))


@query("gp_predict")
def gp_predict(spark, d):
    """Gaussian process means and variances for every genome."""
    return _predictions(spark, d, M.GaussianProcess())


@query("gp_optimize")
def gp_optimize(spark, d):
    """Length scales, signal and noise variance by likelihood."""
    x, y = window(spark, d)
    gp = M.optimize_gp(spark, x, y)
    rows = [(i, float(v), float(gp.variance), float(gp.noise), gp.log_likelihood) for i, v in enumerate(gp.scales)]
    return spark.createDataFrame(rows, "dim int, scale double, signal_variance double, noise_variance double, log_likelihood double")


@query("rf_predict")
def rf_predict(spark, d):
    """Random forest means and variances between trees."""
    return _predictions(spark, d, M.RandomForest())


@query("mlp_predict")
def mlp_predict(spark, d):
    """Perceptron predictions."""
    return _predictions(spark, d, M.Perceptron())


@query("model_compare")
def model_compare(spark, d):
    """Metrics of the four surrogates on the held-out fifth of the whole table. All train on three
    fifths, where the rows are; the Gaussian process on the newest WINDOW rows of these."""
    rows = parts(spark, d, 6, 2, 2)
    training, held = rows.filter("part = 0"), rows.filter("part = 2")
    tables = {"rf": D.TableForest(), "mlp": D.TablePerceptron()}
    tested = {"gp": scored(held, M.GaussianProcess().fit(*arrays(latest(training)))), "knn": regression_metrics(nearest_mean(training, held), "fitness", "mean")}
    tested |= {n: scored(held, m.fit(training, "g", "fitness", "vec_id")) for n, m in tables.items()}
    return reduce(lambda a, b: a.union(b), (t.select(F.lit(n).alias("model"), *(r6(c).alias(c) for c in ("r2", "rmse", "mae", "max_residual"))) for n, t in tested.items()))


def nearest_mean(training, held, k: int = 5):
    """``fitness, mean``: the weighted mean of the k nearest training rows, in scaled dimensions."""
    stats = sorted(scaler(training, "g").collect(), key=lambda r: r["dim"])  # a row a dimension
    mean, std = V.vec(*(r["mean"] for r in stats)), V.vec(*(r["std"] for r in stats))
    scaled = F.zip_with(F.zip_with("g", mean, lambda x, m: x - m), std, lambda x, s: x / s)
    near = N.knn(held.select(F.col("vec_id").alias("query_id"), scaled.alias("g")), training.select(F.col("vec_id").alias("store_id"), scaled.alias("sg")), k)
    found = N.knn_regress(near, training.select(F.col("vec_id").alias("store_id"), F.col("fitness").alias("y")))
    return held.select(F.col("vec_id").alias("query_id"), "fitness").join(found.select("query_id", F.col("prediction").alias("mean")), "query_id")


@query("learning_curve")
def learning_curve(spark, d):
    """R2 of the Gaussian process on the validation fifth of the whole table, by the size of its
    training set, of up to WINDOW rows."""
    rows = parts(spark, d, 6, 2, 2)
    x, y = arrays(latest(rows.filter("part = 0")))
    a = np.random.default_rng(42).permutation(len(y))
    out = [scored(rows.filter("part = 1"), M.GaussianProcess().fit(x[a[:n]], y[a[:n]])).select(F.lit(n).alias("n"), r6("r2").alias("r2")) for n in (20, 40, 80, 160, len(a))]
    return reduce(lambda a, b: a.union(b), out)


@query("cross_validation")
def cross_validation(spark, d):
    """R2 of the Gaussian process on each fifth of the whole table, trained on the newest WINDOW rows
    of the others."""
    rows = parts(spark, d, 2, 2, 2, 2, 2)
    out = [scored(rows.filter(F.col("part") == k), M.GaussianProcess().fit(*arrays(latest(rows.filter(F.col("part") != k))))).select(F.lit(k).alias("fold"), r6("r2").alias("r2")) for k in range(5)]
    return reduce(lambda a, b: a.union(b), out)


@query("permutation_importance")
def permutation_importance(spark, d):
    """Loss of R2 by permuted feature, most important first."""
    x, y = window(spark, d)
    model, _ = M.train(M.GaussianProcess(), x, y)
    rows = evaluated(spark, d).select("g", "fitness")
    return M.permutation_importance(rows, model, "fitness", repeats=30).select("dim", r6("importance").alias("importance")).orderBy(F.desc("importance"), "dim")


@query("pca")
def pca(spark, d):
    """Projections of all genomes on two components."""
    rows, _, _ = M.principal_components(genomes(spark, d).select("vec_id", "g"))
    return rows.select("vec_id", r6("pc1").alias("pc1"), r6("pc2").alias("pc2"))


@query("tier_predict")
def tier_predict(spark, d):
    """Surrogate values of the second tier; while the model isn't ready, rows go to the third."""
    tiers = T.partition(population(spark, d), cache(spark, d)).filter("tier = 'T2'")
    x, y = window(spark, d)
    ready = len(y) >= 100
    if not ready:
        return tiers.select("query_id", F.lit("T3").alias("tier"), F.lit(None).cast("double").alias("mean"))
    model, _ = M.train(M.GaussianProcess(), x, y)
    rows = population(spark, d).join(tiers.select("query_id"), "query_id", "left_semi")
    return M.predict(rows, model, "g", ("query_id",)).select("query_id", F.lit("T2").alias("tier"), r6("mean").alias("mean"))


@query("tier_evaluate")
def tier_evaluate(spark, d):
    """Full evaluation of the third tier, as it is stored for the next snapshot."""
    tiers = T.partition(population(spark, d), cache(spark, d)).filter("tier = 'T3'")
    rows = population(spark, d).join(tiers.select("query_id"), "query_id", "left_semi")
    return E.landscape(rows).select("query_id", r6("fitness").alias("fitness")).filter("fitness > -1e8")


REPLAY_SQL = f"""WITH RECURSIVE {EVAL_SQL}, o AS (SELECT island AS run, generation, vec_id, g, row_number() OVER (PARTITION BY island ORDER BY generation, vec_id) AS rn FROM ev),
f AS (SELECT run, rn, vec_id, 'T3' AS tier, [{{'g': g, 'gen': generation}}] AS seen FROM o WHERE rn = 1 UNION ALL
SELECT run, rn, vec_id, tier, CASE WHEN tier = 'T3' THEN list_append(held, {{'g': g, 'gen': generation}}) ELSE held END FROM (SELECT *, CASE WHEN d < 0.005 THEN 'T1' WHEN d <= 0.15 THEN 'T2' ELSE 'T3' END AS tier FROM
(SELECT *, list_min([list_distance(p.g, g) FOR p IN held]) AS d FROM (SELECT o.*, [p FOR p IN f.seen IF o.generation - p.gen <= {MAX_AGE}] AS held FROM f JOIN o ON o.run = f.run AND o.rn = f.rn + 1)))) SELECT run, vec_id, tier FROM f"""


@query("tier_replay", REPLAY_SQL)
def tier_replay(spark, d):
    """Tiers of each run's points when every point sees the stored ones before it, of which those
    more than MAX_AGE generations old are gone."""
    e = evaluated(spark, d).select(F.col("island").alias("run"), "generation", "vec_id", "g")
    return T.replay(e, "run", "generation", "vec_id", "g", DIMS, MAX_AGE)


def designs(spark, d):
    p = A.parameters(F.col("g"))
    b = A.drag_buildup(p)
    return genomes(spark, d).select("vec_id", A.masses(p)["m_total"].alias("mass"), (A.wing_area(p) * 1e-6).alias("area"), b["aspect_ratio"].alias("aspect"), p["naca_m"].alias("camber"), b["cd0"].alias("cd0"), b["oswald"].alias("oswald"), A.required_cl(p).alias("cl"))


@query("trim_mission")
def trim_mission(spark, d):
    """Trim and mission of every genome's aircraft."""
    return X.simulate(designs(spark, d), "vec_id")


@query("evaluate_designs")
def evaluate_designs(spark, d):
    """Fitness of every genome from geometry to mission, with the reasons of rejections."""
    p = A.parameters(F.col("g"))
    volume = genomes(spark, d).select("vec_id", A.fuselage_volume(p).alias("volume"))
    out = X.simulate(designs(spark, d), "vec_id").join(volume, "vec_id")
    reason = F.when(F.col("volume") < A.LEAST_VOLUME, "volume").when(F.isnan("ld"), "untrimmed").when(~F.col("completed"), F.col("failure"))
    value = A.fitness(F.col("ld"), F.col("alpha"), F.col("cm_alpha"), F.col("cm_trim"), F.col("takeoff_m"), F.col("energy_wh"))
    return out.select("vec_id", reason.alias("rejected"), r6(F.when(reason.isNotNull(), A.REJECT).otherwise(value)).alias("fitness"))


@query("powertrain")
def powertrain(spark, d):
    """Operating points over airspeed and charge."""
    speed, soc = np.meshgrid(np.arange(0.0, 26.0, 5.0), np.linspace(0.2, 1.0, 5))
    out = X.powertrain(speed.ravel(), 1.0, soc.ravel())
    rows = [tuple(map(float, r)) for r in zip(speed.ravel(), soc.ravel(), out["thrust"], out["current"], out["rpm"], out["power"])]
    return spark.createDataFrame(rows, "speed double, soc double, thrust double, current double, rpm double, power double")


@query("ga_run")
def ga_run(spark, d):
    """Telemetry of a run on two islands, whose second tier predicts once its model is trained."""
    return E.run(spark, E.Settings(generations=5, size=60))


@query("reproduce")
def reproduce(spark, d):
    """The next population of every island, from its survivors."""
    from ..operators import select as S

    e = evaluated(spark, d).select("island", F.col("vec_id").alias("slot"), "g", "fitness")
    return E.reproduce(S.survivors(e, "fitness", "slot", ["island"], 0.1), 40, 0.08, 42).select("island", "slot", F.transform("g", lambda x: F.round(x, 6)).alias("g"))


@query("circuit_breaker")
def circuit_breaker(spark, d):
    """States of a breaker over a trace of outcomes."""
    from ..streaming.retry import CircuitBreaker

    now = [0.0]
    b = CircuitBreaker(threshold=3, recovery=5.0, probes=2, clock=lambda: now[0])
    rows = []
    for i, ok in enumerate([True, False, False, False, True, True, True, False, True, True, True]):
        now[0] = i * 2.0
        allowed = b.allows()
        if allowed:
            (b.succeeded if ok else b.failed)()
        rows.append((i, allowed, ok, b.state))
    return spark.createDataFrame(rows, "step int, allowed boolean, ok boolean, state string")
