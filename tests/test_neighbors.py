"""Nearest neighbours by cells against brute force, odd vectors, and the pairs that cells spare."""

import math
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from evospark.functions import curve
from evospark.models import surrogates as M
from evospark.operators import neighbors as N


def brute(queries, store, k):
    ok = lambda v: v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v)
    out = []
    for q, g in queries:
        if q is not None and ok(g):
            d = []
            for s, v in store:
                if s is not None and ok(v):
                    total = 0.0
                    for x, y in zip(g, v):
                        total += (x - y) ** 2
                    d.append((total**0.5, s))
            out += [(q, s, round(x, 9), i) for i, (x, s) in enumerate(sorted(d)[:k], 1)]
    return sorted(out)


def tables(spark, queries, store):
    q = spark.createDataFrame(queries, "query_id long, g array<double>").withColumn("v", F.lit("clash"))
    return q.repartition(3), spark.createDataFrame(store, "store_id long, sg array<double>").withColumn("id", F.lit(0)).repartition(4)


def clustered(n, rng, dims=6, centres=40):
    c = rng.random((centres, dims)) * 10
    return c[rng.integers(0, centres, n)] + rng.normal(0, 0.05, (n, dims))


def answer(df):
    return sorted((r.query_id, r.store_id, round(r.d, 9), r["rank"]) for r in df.collect())


@pytest.mark.parametrize("k", [1, 7])
@pytest.mark.parametrize("block,stored_block,worth", [(4_096, 16_384, 1.0), (16, 32, 1.0), (16, 32, -1.0)])
def test_by_brute_force(spark, k, block, stored_block, worth, monkeypatch):
    rng = np.random.default_rng(2)
    monkeypatch.setattr(N, "WORTH", worth)
    store = [(i, v.tolist()) for i, v in enumerate(clustered(900, rng))]
    store += [(5_000 + i, store[i % 3][1]) for i in range(200)]  # copies of three points: ties by id
    queries = [(i, v.tolist()) for i, v in enumerate(clustered(90, rng))] + [(700, store[0][1]), (701, [1e6] * 6), (702, [-3.0] * 6)]
    assert answer(N.knn(*tables(spark, queries, store), k, block, stored_block)) == brute(queries, store, k)


@pytest.mark.parametrize("block", [4_096, 4])
def test_odd_vectors(spark, block):
    nan, inf = float("nan"), float("inf")
    queries = [(1, None), (2, [0.1, 0.2, 0.3, 0.4]), (3, [0.5]), (4, []), (5, [nan, 1.0, 1.0, 1.0]), (6, [None, 1.0, 1.0, 1.0]), (None, [0.0] * 4), (7, [0.9, 0.9, 0.9, 0.9, 5.0]), (8, [inf, 0.0, 0.0, 0.0])]
    store = [(1, [0.0, 0.2, 0.3, 0.4]), (2, None), (3, [0.1, 0.2]), (4, [nan, 0.0, 0.0, 0.0]), (5, []), (6, [0.9, 0.9, None, 0.9]), (7, [0.8] * 4), (None, [0.1] * 4), (8, [0.8] * 4)]
    assert answer(N.knn(*tables(spark, queries, store), 3, block, 4)) == brute(queries, store, 3)
    assert N.knn(*tables(spark, queries, []), 3, block, 4).collect() == [] and N.knn(*tables(spark, [], store), 3, block, 4).collect() == []
    assert {r.query_id: r.n for r in N.mean_distance(*tables(spark, queries, store), block, 4).withColumn("n", F.lit(1)).collect()}.keys() == {2, 3, 7}
    exact = {r.query_id: r.exact_id for r in N.lookup_exact(*tables(spark, queries, store)).collect()}
    assert all(v is None for v in exact.values())


def test_a_null_query_moves_no_other(spark):
    store = [(1, [0.0, 0.0, 0.0, 0.0]), (2, [0.9, 0.9, 0.9, 0.9])]
    got = answer(N.knn(*tables(spark, [(1, [0.9, 0.9, 0.9, 0.8]), (2, None)], store), 1))
    assert got == [(1, 2, pytest.approx(0.1), 1)]


def test_cells_spare_most_pairs():
    rng = np.random.default_rng(4)
    points = clustered(30_500, rng)
    stored, points = points[:30_000], points[30_000:]
    cells = N.Cells(stored[:4_096])
    for sid in (np.arange(len(stored)), rng.permutation(len(stored))):
        near = N.Nearest(np.arange(500), points, 10, cells)
        for at in range(0, len(stored), N.ROWS):
            near.see(sid[at : at + N.ROWS], stored[at : at + N.ROWS])
        assert near.compared < 500 * 30_000 / 5
    plain = N.Nearest(np.arange(500), points, 10)
    plain.see(sid, stored)
    assert plain.compared == 500 * 30_000
    for a, b in zip(near.found(), plain.found()):
        assert (a == b).all()


def test_blocks_spare_most_pairs(spark, monkeypatch):
    """Rows that are sent to a query's other blocks, times a block's rows, are under a fifth of all pairs."""
    rng = np.random.default_rng(6)
    points = clustered(4_300, rng)
    store = [(i, v.tolist()) for i, v in enumerate(points[:4_000])]
    queries = [(i, v.tolist()) for i, v in enumerate(points[4_000:])]
    q, s = tables(spark, queries, store)
    seen, union = [], type(q).union

    def spy(self, other):
        if "deal" in self.columns:
            seen.append(self.groupBy("cell", "ring", "part", "deal").agg(F.count("*").alias("q")).join(other.groupBy("cell", "ring", "part", "deal").agg(F.count("*").alias("s")), ["cell", "ring", "part", "deal"]).agg(F.sum(F.col("q") * F.col("s"))).first()[0])
        return union(self, other)

    monkeypatch.setattr(type(q), "union", spy)
    got = N.knn(q, s, 5, 100, 256)
    monkeypatch.undo()
    assert len(seen) == 2 and sum(x or 0 for x in seen) < 300 * 4_000 / 5
    assert answer(got) == brute(queries, store, 5)


def test_predictions_of_odd_vectors(spark):
    x = np.random.default_rng(1).random((40, 3))
    model = M.GaussianProcess().fit(x, x[:, 0])
    rows = spark.createDataFrame([(1, [0.5, 0.5, 0.5]), (2, None), (3, [0.5]), (4, [0.5, None, 0.5]), (5, [float("nan")] * 3)], "i long, g array<double>")
    got = {r.i: (r["mean"], r.variance) for r in M.predict(rows, model, "g", ("i",)).collect()}
    assert got[1][0] == pytest.approx(model.predict(np.full((1, 3), 0.5))[0][0]) and all(got[i] == (None, None) for i in (2, 3, 4, 5))
    known, m = M.matrix(pa.array([None, [], [1.0], [1.0, 2.0]], pa.list_(pa.float64())), 2)
    assert known.tolist() == [False, False, False, True] and m.tolist() == [[1.0, 2.0]]


def test_keys_of_odd_vectors(spark):
    rows = spark.createDataFrame([(1, [0.5, 0.25]), (2, None), (3, []), (4, [None, 0.1]), (5, [0.5, 0.25, 0.1])], "i long, g array<double>")
    got = curve.probe_keys(rows, "i", "g", 2).collect()
    assert sorted({r.i for r in got}) == [1, 5] and len(got) == 4


# Pairs within a radius


@pytest.mark.parametrize("grid", [1, 3])
def test_pairs_within_a_radius(spark, grid):
    rng = np.random.default_rng(8)
    rows = [(i, v.tolist()) for i, v in enumerate(clustered(150, rng, dims=5, centres=12))] + [(200, [0.0] * 5), (201, [0.3] + [0.0] * 4), (202, [-0.0] * 5), (203, None), (204, [float("nan")] * 5), (205, [0.0, 0.1, 0.0]), (None, [0.0] * 5)]
    got = sorted((r.a, r.b, round(r.d, 9)) for r in N.radius_pairs(spark.createDataFrame(rows, "id long, v array<double>").withColumn("cell", F.lit("clash")), 0.3, grid).collect())
    good = [(i, v) for i, v in rows if i is not None and v is not None and np.isfinite(v).all()]
    dist = lambda x, y: sum((p - q) ** 2 for p, q in zip(x, y)) ** 0.5
    want = sorted((i, j, round(dist(v, w), 9)) for i, v in good for j, w in good if i < j and dist(v, w) < 0.3)
    assert got == want and len(got) > 100 and len({x[:2] for x in got}) == len(got)


def test_radius_join_of_nothing_and_its_plan(spark):
    assert N.radius_pairs(spark.createDataFrame([], "id long, v array<double>"), 0.3).collect() == []
    rows = spark.range(500).select("id", F.array(*(F.rand(i) for i in range(4))).alias("v"))
    plan = N.radius_pairs(rows, 0.1)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"(SortMerge|BroadcastHash|ShuffledHash)Join \[cell", plan) and "NestedLoop" not in plan and "Cartesian" not in plan


def test_probes_of_a_cluster_in_slices(spark, monkeypatch):
    from evospark.functions import curve
    from evospark.operators import neighbors as N
    from evospark.operators import slices

    rng = np.random.default_rng(11)
    points = 0.4 + rng.random((600, 10)) * 1e-3  # all within one cell of the first digits
    points[::9] = points[0]  # exact copies
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "id long, v array<double>")
    keys = curve.probe_keys(df, "id", "v", 2).cache()
    store, asked = (keys.filter(f"id % 2 = {r}").withColumnRenamed("id", n) for r, n in ((0, "store_id"), (1, "query_id")))
    largest = []
    monkeypatch.setattr(N, "sliced", lambda *a: largest.append(slices.sliced(*a).groupBy("curve", "_s").count().agg(F.max("count")).first()[0]) or slices.sliced(*a))
    got = {tuple(r) for r in N.probe(store, asked, 5, both_ways=True, per_slice=40).collect()}
    assert got == {tuple(r) for r in N.probe(store, asked, 5, both_ways=True).collect()}
    assert largest[1] == 600 and largest[0] <= 120  # copies share a slice, the cluster doesn't
    want = set()
    for c in (0, 1):
        rows = sorted((r.hkey, 1 - r.id % 2, r.id) for r in keys.filter(f"curve = {c}").collect())
        held = [i for _, is_stored, i in rows if is_stored]
        rank = 0
        for _, is_stored, i in rows:
            rank += is_stored
            if not is_stored:
                want |= {(i, j) for j in held[max(0, rank - 5) : rank + 5]}
    assert got == want


def test_all_pairs_in_blocks(spark, monkeypatch):
    """Odd vectors and several blocks; a point goes once to each block, not to one for every 256 points."""
    monkeypatch.setattr(N, "LEAST_BLOCK", 20)
    monkeypatch.setattr(N, "PAIRS", 64)
    rng = np.random.default_rng(5)
    rows = [(i, rng.random(3).tolist()) for i in range(120)] + [(200, None), (201, []), (202, [None, 0.5, 0.1]), (203, [0.5]), (204, [0.2, None]), (205, [float("nan"), 0.0, 0.0]), (None, [0.1])]

    def d(a, b):
        if a is None or b is None:
            return None
        pairs = list(zip(a, b))
        return None if any(x is None or y is None for x, y in pairs) else round(math.sqrt(sum((x - y) ** 2 for x, y in pairs)), 9)

    want = {(i, j): d(v, w) for i, v in rows for j, w in rows if i is not None and j is not None and i < j}
    out = N.pairwise(spark.createDataFrame(rows, "id long, v array<double>"))
    got = {(r.a, r.b): None if r.d is None else round(r.d, 9) for r in out.collect()}
    assert got.keys() == want.keys() and all(got[k] == want[k] or got[k] != got[k] and want[k] != want[k] for k in want)
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_distances_are_held_in_pieces(monkeypatch):
    """No more pairs at once than PAIRS, and the same neighbours and sums."""
    rng = np.random.default_rng(6)
    points, store = rng.random((300, 4)), rng.random((2_000, 4))
    want, held, plain = N._distances(points, store), [], N._distances
    monkeypatch.setattr(N, "_distances", lambda a, b: held.append(len(a) * len(b)) or plain(a, b))
    near, sums = N.Nearest(np.arange(300), points, 5), N.Sums(np.arange(300), points)
    for work in (near, sums):
        work.see(np.arange(2_000), store)
    assert max(held) <= N.PAIRS and np.allclose(near.best_d, np.sort(want, 1)[:, :5]) and np.allclose(sums.total, want.sum(1))


def test_pairs_leave_in_the_order_of_their_ids(spark):
    """A run for each point and block, so that a file's ids take little room beside the distances."""
    rng = np.random.default_rng(4)
    n, ids = 2_500, rng.permutation(2_500) * 7 - 3_000
    out = N.pairwise(spark.createDataFrame([(int(i), rng.random(2).tolist()) for i in ids], "id long, v array<double>").repartition(3)).toArrow()
    a, b = (out.column(c).to_numpy() for c in ("a", "b"))
    turns = a[1:] != a[:-1]
    assert len(a) == n * (n - 1) // 2 == len(np.unique(a * 20_000 + b)) and (a < b).all()
    assert turns.sum() < 4 * n and ((b[1:] < b[:-1]) & ~turns).sum() < 20


def test_pairs_of_ids_that_crowd(spark, monkeypatch):
    monkeypatch.setattr(N, "LEAST_BLOCK", 20)
    ids = [5] * 70 + list(range(-10, 20)) + [10**15, -(10**15)]
    out = N.pairwise(spark.createDataFrame([(i, [float(k)]) for k, i in enumerate(ids)], "id long, v array<double>"))
    want = sorted((min(i, j), max(i, j), float(abs(k - m))) for k, i in enumerate(ids) for m, j in enumerate(ids[:k]) if i != j)
    assert sorted(map(tuple, out.collect())) == want


def test_copies_of_a_point_are_bounded_whatever_its_cells(spark, monkeypatch):
    monkeypatch.setattr(N, "LEAST_BLOCK", 2)
    sent, plain = [], N._compared
    monkeypatch.setattr(N, "_compared", lambda both, *more: sent.append(both.count()) or plain(both, *more))
    rng = np.random.default_rng(6)
    points = 0.2 * rng.integers(0, 2, (2_000, 3)) + 0.09 + 0.02 * rng.random((2_000, 3))
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "id long, v array<double>")
    got = N.radius_pairs(df, 0.1).toArrow()
    d = np.sqrt(((points[:, None] - points[None]) ** 2).sum(2))
    want = np.argwhere(np.triu(d < 0.1, 1))
    assert sorted(zip(got.column("a").to_pylist(), got.column("b").to_pylist())) == sorted(map(tuple, want.tolist()))
    assert sent[0] <= 2_000 * 2 * (N.BLOCKS + 27)


def test_blocks_are_bounded_by_their_components(spark, monkeypatch):
    rows = spark.range(640).select("id", F.expr("array_repeat(cast(id as double), if(id = 7, 100, 3))").alias("v"))
    monkeypatch.setattr(N, "LEAST_BLOCK", 4)
    assert N._block(rows) == (640, 20)
    monkeypatch.setattr(N, "MOST_VALUES", 1_000)
    assert N._block(rows) == (640, 10) and N._block(rows.limit(0)) == (0, 4)
