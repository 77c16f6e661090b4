"""Meshes against edges counted one by one, closed forms and odd designs."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from evospark.functions.airframe import BASELINE
from evospark.operators import mesh
from evospark.sources import files


def designs(spark, *changes):
    return spark.createDataFrame([{"id": i, "extra": "x", **BASELINE, **c} for i, c in enumerate(changes)], "id long, extra string, " + ", ".join(f"{k} double" for k in BASELINE))


@pytest.fixture(scope="module")
def rows(spark):
    return mesh.facets(designs(spark, {}, {"wing_twist": 0.0, "wing_dihedral": 0.0, "naca_m": 0.0, "wing_tip_chord": 0.0})).cache()


def test_edges_meet_their_reverse(rows):
    for surface in [r.surface for r in rows.select("surface").distinct().collect()]:
        found = rows.filter((F.col("id") == 0) & (F.col("surface") == surface)).collect()
        edges = Counter()
        for r in found:
            a, b, c = (tuple(round(r[p + x], 6) + 0.0 for x in "xyz") for p in "abc")
            edges.update([(a, b), (b, c), (c, a)])
        assert max(edges.values()) == 1 and all((b, a) in edges for a, b in edges)
        points = {a for a, _ in edges}
        assert len(points) - len(edges) // 2 + len(found) == 2  # a sphere's characteristic


def test_volumes_and_areas(rows):
    got = {r.surface: r for r in mesh.solids(rows).filter("id = 0").collect()}
    assert {k: r.facets for k, r in got.items()} == {"fuselage": 1120, "wing_left": 1062, "wing_right": 1062, "stabilizer_left": 458, "stabilizer_right": 458, "fin": 458}
    assert all(r.closed and r.volume > 0 for r in got.values())
    assert got["wing_left"].volume == pytest.approx(got["wing_right"].volume)
    b, r = BASELINE, BASELINE["fuse_max_diam"] / 2
    nose, tail = b["fuse_length"] * b["nose_ratio"], b["fuse_length"] * b["tail_ratio"]
    exact = math.pi * r * r * (2 / 3 * nose + b["fuse_length"] - nose - tail + tail / 3 * (1 + 0.15 + 0.0225))
    assert 0.97 * exact < got["fuselage"].volume < exact  # inscribed
    area = 5 * 0.1 * 2 * (0.2969 / 1.5 - 0.126 / 2 - 0.3516 / 3 + 0.2843 / 4 - 0.1015 / 5)
    mean = lambda p, q: (p * p + p * q + q * q) / 3
    assert got["fin"].volume == pytest.approx(area * b["v_stab_height"] * mean(b["v_stab_root"], b["v_stab_tip"]), rel=0.02)
    assert got["stabilizer_left"].area > 2 * b["h_stab_span"] * (b["h_stab_root"] + b["h_stab_tip"]) / 2


def test_a_tip_without_chord_is_still_closed(rows):
    got = {r.surface: r for r in mesh.solids(rows).filter("id = 1").collect()}
    assert got["wing_left"].facets == 1062 - 41 - 39 and all(r.closed for r in got.values())


def test_open_and_turned_meshes_are_found(rows):
    fin = rows.filter("id = 0 and surface = 'fin'")
    one = fin.orderBy("ax", "ay", "az", "bx", "by").limit(1)
    assert not mesh.solids(fin.exceptAll(one)).first().closed
    turned = one.select("id", "surface", "ax", "ay", "az", *(F.col(c + x).alias(n + x) for n, c in (("b", "c"), ("c", "b")) for x in "xyz"))
    assert not mesh.solids(fin.exceptAll(one).unionByName(turned)).first().closed


def test_odd_designs(spark):
    odd = designs(spark, {"wing_span": None}, {"fuse_length": float("nan")}, {"naca_p": float("inf")})
    assert mesh.facets(odd).count() == 0 and mesh.facets(odd.limit(0)).count() == 0
    twice = mesh.facets(designs(spark, {}).union(designs(spark, {})))
    with pytest.raises(ValueError):
        mesh.facets(odd.withColumn("surface", F.col("id")), "surface")
    assert twice.count() == 2 * 4618


def test_written_and_read_back(spark, rows, tmp_path):
    files.write_stl(rows.filter("id = 0"), f"file://{tmp_path}/stl")
    text = spark.read.text(f"file://{tmp_path}/stl", wholetext=True).filter(F.length("value") > 0).first().value
    points = np.array([line.split()[1:] for line in text.splitlines() if "vertex" in line], float).reshape(-1, 3, 3)
    assert len(points) == 4618 and text.startswith("solid airframe-0") and text.rstrip().endswith("endsolid airframe-0")
    want = mesh.solids(rows).filter("id = 0").agg(F.sum("volume")).first()[0]
    assert np.linalg.det(points).sum() / 6 == pytest.approx(want)
