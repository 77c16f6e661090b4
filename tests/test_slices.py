"""Ranks, percentiles and running sums by quantile slices against plain sorting."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from evospark.operators import select, slices, stats


def skewed(n=6_000, seed=3):
    """A long tail, a value that a third of the rows share in one stretch of ids, nulls and NaN."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        v = 7.5 if n // 5 < i < n // 5 + n // 3 else rng.lognormvariate(0, 3)
        rows.append((rng.choice("aaab"), i * 3 % (3 * n + 1), v))
    return rows


def df_of(spark, rows):
    return spark.createDataFrame(rows, "g string, i long, v double").repartition(6)


@pytest.mark.parametrize("per_slice", [100, 10**6])
def test_ranks_by_sorting(spark, per_slice):
    rows = skewed(3_000) + [("a", 10**6, None), ("a", 10**6 + 1, None), ("b", 10**6 + 2, float("nan")), (None, 1, 2.0), (None, 2, 1.0)]
    got = {(r.g, r.i): (r["_rank"], r["_n"]) for r in slices.ranked(df_of(spark, rows), "v", "i", ["g"], per_slice=per_slice).collect()}
    place = lambda v: (v is not None, v is not None and v != v, v if v is not None and v == v else 0.0)
    for g in ("a", "b", None):
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (place(r[2]), r[1]))
        assert all(got[g, r[1]] == (k, len(own)) for k, r in enumerate(own))


def test_no_slice_is_crowded(spark):
    sizes = [r["count"] for r in slices.sliced(df_of(spark, skewed(20_000)), "v", "i", per_slice=400).groupBy("_s").count().collect()]
    assert sum(sizes) == 20_000 and max(sizes) < 3 * 400
    exact = slices.sliced(df_of(spark, [("a", i, 1.0) for i in range(5_000)]), "v", "i", per_slice=250).groupBy("_s").count()
    assert max(r["count"] for r in exact.collect()) < 3 * 250


def test_many_slices_find_their_edges(spark, monkeypatch):
    rows = spark.range(3_000).select(F.lit("a").alias("g"), F.col("id").alias("i"), F.col("id").cast("double").alias("v"))
    got = slices.sliced(rows, "v", "i", per_slice=10).groupBy("_s.a").agg(F.min("i").alias("lo"), F.max("i").alias("hi")).orderBy("a").collect()
    assert len(got) > 300 and all(a.hi < b.lo for a, b in zip(got, got[1:]))


@pytest.mark.parametrize("per_slice", [70, 10**6])
def test_percentiles_and_ecdf(spark, per_slice):
    rows = skewed(2_000, 8) + [("c", 1, 5.0), ("d", 2, None)]
    df = df_of(spark, rows)
    shares = {"p0": 0.0, "p25": 0.25, "p50": 0.5, "p99": 0.99, "p100": 1.0}
    got = {r.g: r for r in stats.percentiles(df, "v", shares, ["g"], per_slice).collect()}
    assert set(got) == {"a", "b", "c"}
    for g in got:
        own = [r[2] for r in rows if r[0] == g]
        for name, p in shares.items():
            assert got[g][name] == pytest.approx(np.percentile(own, 100 * p), rel=1e-12)
    cdf = {(r.g, r.i): r.cdf for r in stats.ecdf(df, "v", "i", ["g"], per_slice).collect()}
    own = sorted((r[2], r[1]) for r in rows if r[0] == "a")
    assert all(cdf["a", i] == (k + 1) / len(own) for k, (_, i) in enumerate(own))


@pytest.mark.parametrize("per_slice", [50, 10**6])
def test_running_sums_rings_and_steps(spark, per_slice):
    rng = random.Random(2)
    rows = [("a" if i % 3 else "b", int(1.02 ** (i % 900)) * 1_000 + i, float(rng.randint(0, 9))) for i in range(1_500)]
    df, total, want = df_of(spark, rows), 0.0, {}
    for _, i, v in sorted(rows, key=lambda r: r[1]):
        total += v
        want[i] = total
    assert {r.i: r.total for r in stats.running(df, "i", {"total": "v"}, per_slice).collect()} == want
    groups = {g: sorted(r[1] for r in rows if r[0] == g) for g in "ab"}
    kept = select.bulk_trim(df, "i", ["g"], 300, per_slice).collect()
    for g, ids in groups.items():
        left = 240 + (len(ids) - 376) % 136 if len(ids) > 375 else len(ids)
        assert sorted(r.i for r in kept if r.g == g) == ids[-left:]
        steps = select.evenly_spaced(df, "i", ["g"], 7, per_slice).filter(F.col("g") == g).collect()
        assert sorted(r.i for r in steps) == [ids[j * (len(ids) - 1) // 6] for j in range(7)]
    few = select.evenly_spaced(df.limit(4), "i", ["g"], 10, per_slice)
    assert few.count() == 4


def test_only_wanted_slices_are_sorted(spark):
    df = spark.range(5_000).select(F.col("id").alias("i"), F.col("id").cast("double").alias("v"))
    rows = slices.ranked(df, "v", "i", (), lambda n: F.array(F.lit(10).cast("bigint"), n - 1), 100)
    assert sorted((r.i, r["_rank"]) for r in rows.collect()) == [(10, 10), (4_999, 4_999)]


def test_nothing(spark):
    none = spark.createDataFrame([], "g string, i long, v double")
    assert stats.percentiles(none, "v", {"p": 0.5}, ["g"]).collect() == [] and stats.running(none, "i", {"t": "v"}).collect() == []
