"""Known values of single operators."""

import math
import random
import types

import numpy as np
import pytest
from pyspark.sql import functions as F

from evospark.config import from_mapping
from evospark.functions import airframe as A
from evospark.functions import curve
from evospark.functions import vectors as V
from evospark.models import mission as X
from evospark.models import surrogates as M
from evospark.operators import evolution as E
from evospark.operators import kv, neighbors, ring, rmi, select, stats
from evospark.streaming.retry import CircuitBreaker, delay_ms, evaluate
from evospark.streaming.streams import Registry


def test_fitness_stats(spark):
    r = stats.fitness_stats(spark.createDataFrame([(10.0,), (20.0,), (30.0,)], "f double"), "f").first()
    assert (r.best, r.worst, r.avg) == (30, 10, 20) and abs(r["std"] - 8.1649) < 1e-3
    e = stats.fitness_stats(spark.createDataFrame([], "f double"), "f").first()
    assert (e.best, e.avg, e.worst, e["std"]) == (-math.inf, 0, -math.inf, 0)


def test_variance_and_entropy(spark):
    rows = spark.createDataFrame([([0.0, 1.0],), ([1.0, 1.0],)], "g array<double>")
    assert [r.variance for r in stats.gene_variance(rows, "g").orderBy("dim").collect()] == [0.5, 0.0]
    one = spark.createDataFrame([([0.3],)] * 4, "g array<double>")
    each = spark.createDataFrame([([(i + 0.5) / 10],) for i in range(10)], "g array<double>")
    assert stats.population_entropy(one, "g").first()[0] == pytest.approx(0)
    assert stats.population_entropy(each, "g").first()[0] == pytest.approx(1)


def test_retention(spark):
    rows = spark.createDataFrame([(i, float(i * 10)) for i in range(1, 5)], "seq int, y double")
    assert sorted(r.y for r in select.sliding_window(rows, "seq", 3).collect()) == [20, 30, 40]
    aged = spark.createDataFrame([(5,), (6,)], "last int")
    assert [r["last"] for r in select.ttl(aged, "last", 10, 5).collect()] == [5, 6]
    assert [r["last"] for r in select.ttl(aged, "last", 11, 5).collect()] == [6]


def test_nearest(spark):
    store = spark.createDataFrame([(1, [0.0]), (2, [1.0]), (3, [0.5])], "store_id long, sg array<double>")
    q = spark.createDataFrame([(9, [0.4])], "query_id long, g array<double>")
    assert [r.store_id for r in neighbors.knn(q, store, 2).orderBy("rank").collect()] == [3, 1]
    assert neighbors.knn(q.limit(0), store, 2).count() == 0 and neighbors.knn(q, store.limit(0), 2).count() == 0


def test_blocks_of_neighbours_equal_a_scan(spark):
    rng = random.Random(4)
    vectors = [(i, [rng.randint(0, 5) / 5 for _ in range(3)]) for i in range(400)]
    store = spark.createDataFrame(vectors, "store_id long, sg array<double>")
    q = spark.createDataFrame([(i, v) for i, v in vectors if i % 3 == 0], "query_id long, g array<double>")
    got = neighbors.knn(q, store, 4, block=20, stored_block=50)
    assert sorted(got.collect()) == sorted(neighbors.knn(q, store, 4).collect())
    for r in got.filter("query_id % 60 = 0").collect():
        every = sorted((math.dist(v, vectors[r.query_id][1]), i) for i, v in vectors)
        assert r.store_id == every[r["rank"] - 1][1]
    means = {r.query_id: r.mean_distance for r in neighbors.mean_distance(q, store, block=20, stored_block=50).collect()}
    assert all(abs(means[i] - sum(math.dist(v, w) for _, w in vectors) / 400) < 1e-9 for i, v in vectors if i % 60 == 0)
    assert neighbors.knn(q, store.limit(0), 2, block=20).count() == 0


def test_second_tier_predicts_once_trained(spark):
    s = E.Settings(islands=2, size=20, sigma=0.03, generations=4, least=30, fresh=10)
    rows = E.run(spark, s).orderBy("generation", "island").collect()
    assert all(r.t1 + r.t2 + r.t3 == 20 for r in rows) and all(r.t2 == 0 for r in rows if r.model == 0)
    assert [r.model for r in rows][:4] == [0, 0, 1, 1] and sum(r.t2 for r in rows) > 0

    class Broken:
        def fit(self, x, y):
            raise AssertionError("too few points for a model")

    assert all(r.t2 == 0 and r.model == 0 for r in E.run(spark, E.Settings(size=10, generations=2), surrogate=Broken).collect())


def test_pareto_by_quantiles(spark):
    rng = random.Random(2)
    pairs = [(rng.choice([rng.random() * 1e-3, rng.random() * 1e6]), rng.random()) for _ in range(800)] + [(None, 0.0), (1e7, None)]
    got = {tuple(r) for r in select.pareto(spark.createDataFrame(pairs, "a double, b double"), "a", "b").collect()}
    whole = [p for p in pairs if None not in p]
    assert got == {(a, b) for a, b in whole if not any(x >= a and y <= b and (x > a or y < b) for x, y in whole)}


def test_shared_folder_on_a_cluster():
    from types import SimpleNamespace

    from evospark.session import shared_dir

    conf = SimpleNamespace(get=lambda key, default=None: default)
    with pytest.raises(RuntimeError):
        shared_dir(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="spark://host:7077")))
    assert shared_dir(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="local[2]"))).startswith("file://")


def test_curve_order_and_locality():
    unit = np.array([[0, 0], [0, 1], [1, 1], [1, 0]], float)
    assert curve.encode(unit, [0, 1], bits=1) == ["0", "1", "2", "3"]
    grid = np.array([[x, y] for x in range(8) for y in range(8)], np.uint64)
    keys = curve.hex_keys(grid, bits=3)
    order = grid[np.argsort(keys)].astype(int)
    assert len(set(keys)) == 64 and (np.abs(np.diff(order, axis=0)).sum(1) == 1).all()
    assert curve.permutations(5, 3) == curve.permutations(5, 6)[:3]


def test_key_features(spark):
    keys = ["0" + "0" * 16 + "|x", "1" + "0" * 16 + "|x", "2" + "0" * 16 + "|x", "2" + "f" * 16 + "|x"]
    df = spark.createDataFrame([(k,) for k in keys], "k string").select(rmi.feature(F.col("k")).alias("f"))
    assert [r.f for r in df.collect()] == pytest.approx([0, 1 / 3, 2 / 3, 1], abs=1e-4)


def test_ranks_of_any_keys(spark):
    rng = random.Random(5)
    keys = [f"{'same-' * 9}{rng.randrange(4000):x}" for _ in range(3000)] + [f"{rng.getrandbits(64):016x}" for _ in range(500)] + ["", "é", "z", None, None] + ["hot"] * 2000
    want = {k: i for i, k in enumerate(sorted(set(keys) - {None}, key=lambda k: k.encode()))}
    rows = rmi.ranked(spark.createDataFrame([(k,) for k in keys], "k string")).collect()
    assert {r["k"]: r["rank"] for r in rows} == want and len(rows) == len(want)
    assert {r["n"] for r in rows} == {len(want)}
    assert rmi.ranked(spark.createDataFrame([], "k string")).count() == 0
    assert [r["rank"] for r in rmi.ranked(spark.createDataFrame([("a",), ("a",)], "k string")).collect()] == [0]


def test_controller(spark):
    steps = spark.createDataFrame([(0, 0, 0, 100), (1, 0, 95, 5), (2, 0, 1, 1)], "bin int, step int, inside int, outside int")
    r = {x.bin: x for x in rmi.tune(steps).collect()}
    assert (r[0].scale, r[0].i) == (0.95, 1) and r[0].offset > 0
    assert (r[1].scale, r[1].p, r[1].d) == (1, 1, 1)
    assert (r[2].scale, r[2].offset) == (1, 0)


def test_ring_edges(spark):
    r = spark.range(1).select(ring.in_range(F.lit("5"), F.lit("5"), F.lit("5")).alias("a"), ring.in_half_open(F.lit("5"), F.lit("5"), F.lit("5")).alias("b"), ring.finger_start(F.lit("f" * 16), 1).alias("c"), rmi.position(F.lit(1.0)).alias("d"), rmi.position(F.lit(0.5)).alias("e")).first()
    assert (r.a, r.b, r.c, r.d, r.e) == (True, False, "0" * 16, "f" * 16, "8" + "0" * 15)


def test_matern_and_cholesky():
    s = math.sqrt(5)
    assert M.matern52(np.zeros((1, 1)), np.ones((1, 1)), np.ones(1), 2.5)[0, 0] == pytest.approx(2.5 * (1 + s + 5 / 3) * math.exp(-s))
    low = M.cholesky(np.array([[4.0, 12, -16], [12, 37, -43], [-16, -43, 98]]))
    assert np.allclose(low, [[2, 0, 0], [6, 1, 0], [-8, 5, 3]])
    with pytest.raises(ValueError):
        M.cholesky(np.array([[1.0, 2.0], [2.0, 1.0]]))


def test_fitness_values(spark):
    f = spark.range(1).select(A.fitness(F.lit(8.0), F.lit(2.0), F.lit(0.05), F.lit(0.0)).alias("a"), A.fitness_smooth(F.lit(None).cast("double"), F.lit(1.0), F.lit(0.0), F.lit(0.0)).alias("b")).first()
    assert f.a == pytest.approx(6.95) and f.b == -20


def test_surrogates_learn():
    rng = np.random.default_rng(0)
    x = rng.random((300, 4))
    y = 15 / (1 + 3 * ((x - 0.5) ** 2).sum(1))
    a, b, c = M.split(len(y))
    assert len(set(a) | set(b) | set(c)) == 300 and (len(a), len(b), len(c)) == (180, 60, 60)
    for model, least in ((M.GaussianProcess(), 0.9), (M.Neighbours(), 0.4), (M.RandomForest(trees=30), 0.55), (M.Perceptron(epochs=100), 0.5)):
        assert M.metrics(y[c], model.fit(x[a], y[a]).predict(x[c])[0])["r2"] > least
    with pytest.raises(ValueError):
        M.train(M.Neighbours(), x[:4], y[:4])
    assert M.train(M.Neighbours(), x[:10], y[:10])[1] is None and M.metrics(y[:0], y[:0])["r2"] == 0


class _First:
    """Predicts a row's first feature."""

    def predict(self, x):
        return x[:, 0], np.zeros(len(x))


def test_permutation_of_all_rows(spark):
    # a third of the rows are equal, and one of 3,000 rows holds nearly all of the variance
    rows = [([i / 2000, 0.5], i / 2000) for i in range(1999)] + [([1000.0, 0.5], 1000.0)] + [([0.25, 0.5], 0.25)] * 1000
    df = spark.createDataFrame(rows, "g array<double>, y double").repartition(8)
    got = M.permuted(df, "y", "g", 4).groupBy("rep").agg(F.sort_array(F.collect_list(F.col("other")[0])).alias("o"), F.sort_array(F.collect_list("y")).alias("y"), F.count_if(F.col("other")[0] == F.col("y")).alias("same")).collect()
    assert len(got) == 4 and all(r.o == r.y == sorted(y for _, y in rows) and r.same < 600 for r in got)
    out = {r.dim: r.importance for r in M.permutation_importance(df, _First(), "y", repeats=3).collect()}
    # a permutation moves the outlier once in and once out: twice the variance is lost
    assert out[0] == pytest.approx(2, abs=0.02) and out[1] == pytest.approx(0)
    assert M.permuted(df.limit(1), "y", "g", 2).count() == 2


def test_importance_scores_a_row_once_a_repeat(spark, monkeypatch):
    """Means alone, exchanged in the task; odd rows as if each mixed row were predicted by itself."""
    rng = np.random.default_rng(5)
    x = rng.random((60, 3))
    y = x[:, 0] * 2 + np.sin(4 * x[:, 1])
    gp = M.GaussianProcess().fit(x[:12], y[:12])
    monkeypatch.setattr(M, "MEANS", 16)
    assert np.allclose(gp.mean(x), gp.predict(x)[0], rtol=0, atol=1e-10) and gp.mean(x[:0]).shape == (0,)
    nan = float("nan")
    odd = [(None, 1.0), ([0.5], 1.0), ([0.5, None, 0.1], 1.0), ([0.5, nan, 0.1], 2.0), ([0.1, 0.2, 0.3, 0.4], 1.5), ([0.2, 0.2, 0.2], None)]
    df = spark.createDataFrame([(v.tolist(), float(t)) for v, t in zip(x, y)] + odd, "g array<double>, y double").repartition(3)
    scored, predict = [], M.predict
    monkeypatch.setattr(M, "predict", lambda df, *a: scored.append(df.count()) or predict(df, *a))
    got = {r.dim: r.importance for r in M.permutation_importance(df, gp, "y", repeats=2).collect()}
    assert scored == [66]  # the rows as they are, not rows times features times repeats
    rows = M.permuted(df, "y", "g", 2).collect()
    total = np.var([r.y for r in rows if r.y is not None]) * (len(rows) / 2 - 1)

    def r2(rows, dim):
        mixed, of = [], []
        for r in rows:
            v = None if r.g is None else [(None if r.other is None or len(r.other) <= i else r.other[i]) if i == dim else a for i, a in enumerate(r.g)]
            if v is not None and r.y is not None and len(v) == 3 and all(a is not None and np.isfinite(a) for a in v):
                mixed.append(v)
                of.append(r.y)
        return 1 - ((np.array(of) - gp.predict(np.array(mixed))[0]) ** 2).sum() / total

    base = r2([r for r in rows if r.rep == 0], None)
    for dim in range(3):
        assert got[dim] == pytest.approx(np.mean([base - r2([r for r in rows if r.rep == k], dim) for k in range(2)]), abs=1e-8)


def test_tier_replay(spark, tmp_path):
    from evospark import registry

    def row(i, *g):
        return (i, 0, [2 * x - 1 for x in (*g, *[0.5] * (10 - len(g)))])

    # run 0 (ids by fours); a generation has fifty ids
    rows = [row(0), row(4), row(8, 0.6), row(12, 0.5, 0.5, 0.5, 0.5, 0.9)]  # equal, near, far in the fifth gene alone
    rows += [row(304, 0.5, 0.5, 0.5, 0.5, 0.9), row(308), row(312)]  # six generations on
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r.vec_id: r.tier for r in registry.QUERIES["tier_replay"](spark, str(tmp_path)).filter("run = 0").collect()}
    assert got == {0: "T3", 4: "T1", 8: "T2", 12: "T3", 304: "T3", 308: "T3", 312: "T1"}


def test_tier_replay_within_age(spark, tmp_path):
    from evospark import registry

    rows = [(i, 0, [0.0] * 10) for i in (0, 252, 300)]  # generations 0, 5 and 6
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r.vec_id: r.tier for r in registry.QUERIES["tier_replay"](spark, str(tmp_path)).collect()}
    assert got == {0: "T3", 252: "T1", 300: "T3"}


def test_bootstrap_draws_single_latencies(spark, tmp_path):
    from evospark import registry

    # one event in ten is slow; averages over a thousand slots hide that
    spark.range(20_000).select(F.col("id").alias("event_id"), F.when(F.col("id") * 7919 % 20_000 < 2_000, 1000.0).otherwise(0.0).alias("value")).write.parquet(f"{tmp_path}/events.parquet")
    got = {r.workers: r.seconds for r in registry.QUERIES["bootstrap_scaling"](spark, str(tmp_path)).collect()}
    assert len(got) == 8 and all(s == int(s) for s in got.values())  # whole latencies
    # ids without any residue of their own lose no draw
    few = f"{tmp_path}/few"
    spark.range(7).select((F.col("id") * 5).alias("event_id"), F.lit(100.0).alias("value")).write.parquet(f"{few}/events.parquet")
    got = {r.workers: r.seconds for r in registry.QUERIES["bootstrap_scaling"](spark, few).collect()}
    assert got == {w: pytest.approx(-(-100 // w) / 10) for w in range(1, 9)}


def test_models_use_the_whole_table(spark, tmp_path, monkeypatch):
    from evospark.models import distributed as D
    from evospark.plans import models as P

    rng = np.random.default_rng(3)
    n = 1500
    spark.createDataFrame([(i, 0, rng.uniform(-1, 1, 10).tolist()) for i in range(n)], "vec_id long, label int, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    d, trained, tried, tested = str(tmp_path), [], [], []
    gp_fit, predict = M.GaussianProcess.fit, M.predict
    monkeypatch.setattr(M.GaussianProcess, "fit", lambda self, x, y: trained.append(len(y)) or gp_fit(self, x, y))
    monkeypatch.setattr(M, "predict", lambda df, *a: tested.append(df.count()) or predict(df, *a))
    monkeypatch.setattr(M, "optimize_gp", lambda spark, x, y: tried.append(len(y)) or M.GaussianProcess(scales=np.ones(10)).fit(x[:50], y[:50]))
    P.gp_optimize(spark, d)
    assert tried == [1000] and len(P.window(spark, d)[1]) == 1000
    trained.clear()
    assert P.cross_validation(spark, d).count() == 5
    assert sum(tested) == n and trained == [1000] * 5  # every row is held out once
    trained.clear(), tested.clear()
    assert P.learning_curve(spark, d).count() == 5 and max(trained) > 800 and min(tested) > 200
    tested.clear()
    fits = []
    training = D._training
    monkeypatch.setattr(D, "_training", lambda df, *a: fits.append(df.count()) or training(df, *a))
    monkeypatch.setattr(P.N, "knn", lambda q, s, k, knn=P.N.knn: fits.append(s.count()) or tested.append(q.count()) or knn(q, s, k))
    monkeypatch.setattr(P, "D", types.SimpleNamespace(TablePerceptron=lambda: D.TablePerceptron(epochs=3), TableForest=lambda: D.TableForest(trees=4, depth=3)))
    got = {r.model: r.r2 for r in P.model_compare(spark, d).collect()}
    assert set(got) == {"gp", "knn", "rf", "mlp"} and len(fits) == 3 and min(fits) > 800 and min(tested) > 200


def test_queries_have_the_operators_settings(spark, tmp_path, monkeypatch):
    from evospark.plans import models as P

    seen = []
    monkeypatch.setattr(P, "_predictions", lambda spark, d, model: seen.append(model))
    P.rf_predict(spark, ""), P.mlp_predict(spark, "")
    assert (seen[0].trees, seen[0].depth, seen[1].epochs) == (150, 12, 300)
    x = np.random.default_rng(2).random((60, 3))
    gp = M.optimize_gp(spark, x, np.sin(6 * x[:, 0]))
    assert gp.scales[0] < 0.5 * min(gp.scales[1:])  # a sweep visits every dimension
    point = [*map(float, gp.scales), gp.variance, gp.noise]
    ends = [M.GaussianProcess(np.array(p[:-2]), p[-2], p[-1]).fit(x, np.sin(6 * x[:, 0])).log_likelihood for _, p in M.moves(point, ("scales", "signal", "noise"))]
    assert max(ends) < gp.log_likelihood + 0.01  # no single move of any parameter gains


def test_search_tunes_signal_and_noise(spark):
    rng = np.random.default_rng(5)
    x = rng.random((80, 2))
    noisy = np.sin(5 * x[:, 0]) + 0.3 * rng.standard_normal(80)
    full, scales = M.optimize_gp(spark, x, noisy), M.optimize_gp(spark, x, noisy, tuned=("scales",))
    assert full.log_likelihood > scales.log_likelihood + 1 and (scales.variance, scales.noise) == (1.0, 1e-3)
    share = 0.09 / noisy.var()  # of the noise in the scaled target
    assert 0.4 * share < full.noise < 2.5 * share
    bounded = M.moves([50.0, 0.05, 30.0, 0.5], ("scales", "signal", "noise"))
    assert len(bounded) == 3 * 8 + 6 and all(0.05 <= p[k] <= 50 for k, p in bounded if k < 2) and all(p[2] <= 30 and p[3] <= 0.5 for _, p in bounded)
    jobs = []
    real = M.likelihoods
    try:
        M.likelihoods = lambda *a: jobs.append(len(a[1])) or real(*a)
        M.optimize_gp(spark, x, noisy, sweeps=2)
    finally:
        M.likelihoods = real
    assert jobs[:2] == [5, 30] and len(jobs) <= 5  # the starts, then two tables a sweep
    flat = M.likelihoods(spark, [[1.0, 1.0, 1.0, 1e-6], [1.0, 1.0, -1.0, 1e-6]], x, noisy)
    assert flat[-1][1] == -np.inf and flat[0][0][2] == 1.0


def test_neighbours_in_parts():
    rng = np.random.default_rng(1)
    x, q = rng.random((50_000, 4)), rng.random((45, 4))
    m = M.Neighbours().fit(x, x[:, 0])
    assert np.allclose(m.predict(q)[0], np.concatenate([m.predict(q[i : i + 1])[0] for i in range(45)]))


def test_mission_events():
    one = lambda v: np.array([v])
    cl, cd, cm = X.polar(one(5.0), one(2.0), one(0.03), one(0.8))
    light, heavy = X.mission(one(0.3), one(0.02), cl, cd), X.mission(one(1.5), one(0.002), cl, cd)
    assert light["completed"][0] and 0 < light["takeoff_m"][0] < 30 and light["total_m"][0] > light["takeoff_m"][0]
    assert not heavy["completed"][0] and heavy["failure"][0] == "takeoff_distance_exceeded" and heavy["takeoff_m"][0] == pytest.approx(30)
    assert np.isnan(X.trim(one(9.0), cl, cd, cm)["ld"][0])
    off = X.powertrain(one(0.0), 0.0, one(1.0))
    assert off["rpm"][0] == 0 and off["thrust"][0] == 0


def test_breaker_and_retries():
    now = [0.0]
    b = CircuitBreaker(threshold=2, recovery=5, probes=1, clock=lambda: now[0])
    b.failed(), b.failed()
    assert not b.allows()
    now[0] = 6
    assert b.allows() and b.state == "half_open" and not b.allows()
    b.succeeded()
    assert b.state == "closed" and delay_ms(3, jitter=0) == 400 and delay_ms(30, jitter=0) == 5000
    assert 75 <= delay_ms(1, rng=random.Random(1)) <= 125

    def broken(_):
        raise RuntimeError

    single = lambda r: (_ for _ in ()).throw(RuntimeError()) if r == 2 else float(r)
    assert evaluate([1, 2, 3], broken, single, penalty=-1e9, sleep=lambda s: None) == [1, -1e9, 3]
    with pytest.raises(RuntimeError):
        evaluate([2], broken, single, sleep=lambda s: None)


def test_registry_of_models():
    r = Registry()
    assert not r.promote(1) and not r.roll_back()
    assert r.promote(r.propose("a")) and r.promote(r.propose("b")) and r.active == (2, "b")
    assert r.roll_back() and r.active == (1, "a") and not r.roll_back()


def test_generations(spark):
    s = E.Settings(islands=2, size=8, dims=4, generations=3)
    a = E.run(spark, s).orderBy("generation", "island").collect()
    key = lambda rows: [(r.generation, r.island, r.best, r.worst, r.t1, r.t2, r.t3) for r in rows]
    assert len(a) == 6 and key(a) == key(E.run(spark, s).orderBy("generation", "island").collect())
    tops = [max(r.best for r in a if r.generation == g) for g in range(3)]
    assert tops == sorted(tops)  # survivors stay


def test_sampling(spark):
    x = np.array([r.x for r in select.latin_hypercube(spark, 20, 3).collect()])
    assert (np.sort((x * 20).astype(int), axis=0) == np.arange(20)[:, None]).all()


def test_table(spark, tmp_path):
    t = kv.Table(spark, f"file://{tmp_path}/kv")
    t.write(spark.createDataFrame([("b", "2"), ("a", "1")], "k string, v string"), 2)
    assert [r.k for r in kv.range_scan(t.read(), "a", 9, inclusive=False).collect()] == ["b"]
    assert t.get_meta("m") is None
    t.put_meta("m", "7")
    assert t.get_meta("m") == "7" and t.read().count() == 2


def test_stagnation_patience(spark):
    rows = spark.createDataFrame([(0, i, v) for i, v in enumerate([1.0, 1.0, 1.0, 2.0])], "run int, gen bigint, best double")
    out = [(r.stagnant, r["stop"]) for r in stats.stagnation(rows, ["run"], "gen", "best", 2, 0.0, 0).orderBy("step").collect()]
    assert out == [(0, False), (1, False), (2, True), (0, False)]
    assert not any(r["stop"] for r in stats.stagnation(rows, ["run"], "gen", "best", 0, 0.0, 0).collect())


def test_settings_from_mapping():
    with pytest.warns(UserWarning):
        s = from_mapping(E.Settings, {"GA_SIZE": "50", "GA_SIGMA": "x"}, "GA_")
    assert (s.size, s.sigma) == (50, 0.08)


def test_short_vectors(spark):
    d = spark.range(1).select(V.l2(V.vec(1.0, 2.0), V.vec(1.0, 5.0, 9.0)).alias("d")).first().d
    assert d == 3


def test_ranks_digest_a_key_once(spark):
    """No digest stands inside a lambda, nor is computed again for the slices."""
    keys = spark.range(300).select(F.sha1(F.col("id").cast("string")).alias("k"))
    from evospark.operators import rmi

    got = rmi.ranked(keys)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    sliced = [line for line in plan.splitlines() if "lambdafunction" in line]
    assert sliced and not any("sha1" in line.lower() for line in sliced)
    want = {k: i for i, k in enumerate(sorted(r.k for r in keys.collect()))}
    assert {r.k: r["rank"] for r in got.collect()} == want


def test_replay_by_brute_force(spark, monkeypatch):
    """Several runs, batches smaller than a run, points on the borders of cells, odd vectors, ties."""
    from evospark.operators import tiering

    rng = random.Random(11)
    rows = []
    for i in range(700):
        g = [round(rng.choice([0.0, 0.15, 0.3, 0.45]) + rng.choice([0, 0, 0.001, 0.07, -0.15]), 4) for _ in range(4)]
        rows.append((rng.choice(["a", "b", "c"]), i // 40, i, rng.choice([g] * 12 + [None, g[:2], [float("nan")] * 4])))
    want, held = {}, {}
    for run, gen, i, g in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        seen = [p for p in held.get(run, []) if gen - p[0] <= 3]
        good = g is not None and len(g) == 4 and g[0] == g[0]
        d = min((sum((x - y) ** 2 for x, y in zip(g, p[1])) for p in seen), default=9.0) if good else 9.0
        want[i] = "T1" if d < 0.005**2 else "T2" if d <= 0.15**2 else "T3"
        held[run] = seen + [(gen, g)] * (good and want[i] == "T3")
    df = spark.createDataFrame(rows, "run string, gen int, i long, g array<double>").repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        got = {r.i: r.tier for r in tiering.replay(df, "run", "gen", "i", "g", 4, 3).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    assert got == want and set(want.values()) == {"T1", "T2", "T3"}
    seen = tiering.SeenPoints(0.005, 0.15, 2)
    for gen in range(50):
        assert seen.tier(np.array([gen, 0.0, 0.0]), gen) == "T3"
    assert len(seen.order) == 3 and sum(map(len, seen.cells.values())) == 3  # old ones are dropped
