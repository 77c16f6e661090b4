"""Models trained on the executors against the driver's fits."""

import numpy as np
import pytest

from evospark.models import distributed as D
from evospark.models import surrogates as M


def sample(n, seed=1, dims=6):
    rng = np.random.default_rng(seed)
    x = rng.random((n, dims))
    return x, np.sin(5 * x[:, 0]) + x[:, 1] * x[:, 2] * 2 + 0.05 * rng.normal(size=n)


def table(spark, x, y, parts=5):
    rows = [(i, v.tolist(), float(t)) for i, (v, t) in enumerate(zip(x, y))]
    odd = [(10_000, None, 1.0), (10_001, [0.5], 1.0), (10_002, [0.5] * 6, None), (10_003, [float("nan")] * 6, 1.0), (10_004, [0.5] * 6, float("nan"))]
    return spark.createDataFrame(rows + odd, "id long, g array<double>, y double").repartition(parts)


def test_forest_is_as_good_as_the_drivers(spark):
    x, y = sample(1_000)
    test_x, test_y = sample(500, 2)
    forest = D.TableForest(trees=60).fit(table(spark, x, y), "g", "y", "id")
    local = M.RandomForest(trees=60).fit(x, y)
    r2 = lambda m: M.metrics(test_y, m.predict(test_x)[0])["r2"]
    assert abs(r2(forest) - r2(local)) < 0.02 and r2(forest) > 0.8
    mean, var = forest.predict(test_x)
    assert mean.shape == var.shape == (500,) and (var >= 0).all() and var.max() > 0


def test_forest_does_not_depend_on_partitions(spark, monkeypatch):
    x, y = sample(400, 3)
    y = np.round(y * 8) / 8  # sums are exact, so the tasks' order changes nothing
    one = D.TableForest(trees=6, depth=5).fit(table(spark, x, y, 1), "g", "y", "id")
    monkeypatch.setattr(D, "SUMS", 3 * 32 * 3 * 4)  # four nodes a pass
    many = D.TableForest(trees=6, depth=5).fit(table(spark, x, y, 7), "g", "y", "id")
    assert (one.feature, one.cut) == (many.feature, many.cut) and np.allclose(one.predict(x)[0], many.predict(x)[0])


def test_forest_of_few_and_equal_rows(spark):
    rows = spark.createDataFrame([(i, [0.5] * 6, 2.0) for i in range(50)], "id long, g array<double>, y double")
    assert np.allclose(D.TableForest(trees=5).fit(rows, "g", "y", "id").predict(np.full((2, 6), 0.1))[0], 2.0)
    with pytest.raises(ValueError):
        D.TableForest(trees=2).fit(rows.limit(0), "g", "y", "id")


def test_tasks_get_packed_trees_alone(spark):
    """Memory of a worker by nodes: 15 bytes each, padded to the longest tree, and no lists."""
    import pickle

    x, y = sample(2_000, 5)
    forest = D.TableForest(trees=8, depth=9).fit(table(spark, x, y), "g", "y", "id")
    nodes = len(forest.feature) * max(map(len, forest.feature))
    sent = pickle.dumps(forest)
    assert nodes > 1_000 and len(sent) < 15 * nodes + 10_000
    held = pickle.loads(sent)
    assert not any(isinstance(v, list) and isinstance(v[0], list) for v in vars(held).values())
    assert all((a == b).all() for a, b in zip(held.predict(x), forest.predict(x)))


def test_a_tree_by_brute_force(spark):
    """Without a choice of features, the first cut is the best of all bins with the tree's weights."""
    x, y = sample(300, 4, dims=6)
    f = D.TableForest(trees=1, depth=1, features=6).fit(table(spark, x, y), "g", "y", "id")
    h = np.array([r.h for r in table(spark, x, y).filter("id < 10000").selectExpr("id", "xxhash64(id) as h").orderBy("id").collect()]).view(np.uint64)
    w = np.searchsorted(D.POISSON, D._mixed(h ^ D._mixed(np.uint64(42) + np.zeros(1, np.uint64))) / 2.0**64, side="right")
    codes = f.codes(x)
    gains = {}
    for dim in range(6):
        for b in range(31):
            low = codes[:, dim] <= b
            if w[low].sum() and w[~low].sum():
                gains[dim, b] = sum((w[s] * y[s]).sum() ** 2 / w[s].sum() for s in (low, ~low))
    assert (f.feature[0][0], f.cut[0][0]) == max(gains, key=gains.get)


def test_perceptron_equals_the_local_fit(spark, monkeypatch):
    x, y = sample(300, 5)
    local = M.Perceptron(epochs=25, batch=300).fit(x, y)
    for parts, tasks in ((1, 32), (4, 32), (4, 0)):
        monkeypatch.setattr(D, "TASKS", tasks)
        losses = []
        table_fit = D.TablePerceptron(epochs=25).fit(table(spark, x, y, parts), "g", "y", "id", losses)
        assert np.abs(table_fit.predict(x)[0] - local.predict(x)[0]).max() < 1e-8
        assert losses[-1] < 0.5 * losses[0]
