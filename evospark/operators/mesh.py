"""Closed triangle meshes of whole airframes: fuselage, wing panels, stabilizer and fin.

Every surface is a loft: rings of points, skinned ring to ring and capped at both ends. Which points
make a facet is the same for all designs; where they lie is computed for a batch of designs at once,
so a mesh is one pass over the designs without a shuffle. (As column expressions the corners' formulas
are copied into each other by the optimizer until it runs out of memory.) The fuselage's first and
last rings are single points; facets that have shrunk to an edge are left out.

A mesh is closed, with all facets turned the same way, where each directed edge is met by its
reverse. ``solids`` sums signed hashes of the edges, which cancel exactly then (another sum is zero
with a chance of 2 to the -40), so the check is a sum and no join of edges.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship

# Sides of the fuselage, its rings along nose, middle and tail, and the tail's end as
# a share of the radius; points of one side of a section and stations, for wing and tail panels;
# thickness of the tail's section.
SIDES, RINGS, END = 20, (10, 6, 12), 0.15
WING, TAIL = (20, 12), (16, 6)
TAIL_THICKNESS = 0.10

#: Parameters of a design that a mesh needs.
NEEDED = tuple("fuse_length fuse_max_diam nose_ratio tail_ratio wing_span wing_root_chord wing_tip_chord wing_sweep wing_dihedral wing_twist wing_x_pos wing_z_pos naca_m naca_p naca_t tail_x_pos v_stab_height v_stab_root v_stab_tip h_stab_span h_stab_root h_stab_tip".split())

#: Designs whose points are made at once: 18 MB of corners.
BATCH = 48


def loft(rings: int, points: int) -> np.ndarray:
    """Corners of all facets of a surface, as numbers ring * points + point: the skin's quads in two,
    then fans over the first and the last ring."""
    i, j = (v.ravel() for v in np.mgrid[: rings - 1, :points])
    here, beside = i * points + j, i * points + (j + 1) % points
    k, last = np.arange(1, points - 1), (rings - 1) * points
    skin = [np.c_[here, beside, beside + points], np.c_[here, beside + points, here + points]]
    return np.concatenate([*skin, np.c_[0 * k, k + 1, k], last + np.c_[0 * k, k, k + 1]])


def section(m: np.ndarray, p: np.ndarray, t: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray]:
    """Four-digit contours (a row each) from the trailing edge over the upper side to the nose and back below."""
    side = np.arange(2 * half + 1) - half
    x, m, p = 0.5 * (1 - np.cos(np.abs(side) * np.pi / half))[None], m[:, None], p[:, None]
    thick = 5 * t[:, None] * (0.2969 * np.sqrt(x) - 0.126 * x - 0.3516 * x**2 + 0.2843 * x**3 - 0.1015 * x**4)
    flat = (m == 0) | (p == 0)
    at = np.where(flat, 0.4, p)  # anywhere: a flat section has no camber
    ahead, scale = x < at, np.where(flat, 0.0, m / np.where(x < at, at**2, (1 - at) ** 2))
    camber = scale * np.where(ahead, 2 * at * x - x**2, 1 - 2 * at + 2 * at * x - x**2)
    lean = np.arctan(2 * scale * (at - x))
    up = np.where(side <= 0, thick, -thick)
    return x - up * np.sin(lean), camber + up * np.cos(lean)


def body(v: dict[str, np.ndarray]) -> np.ndarray:
    """Points of the fuselages: an elliptic nose, a cylinder, a cone, and a point at each end."""
    nose, middle, tail = (np.arange(1, n + 1) / n for n in RINGS)
    length, front, rear = (a[:, None] for a in (v["fuse_length"], v["fuse_length"] * v["nose_ratio"], v["fuse_length"] * v["tail_ratio"]))
    x = np.concatenate([0 * front, nose * front, front + middle * (length - front - rear), length - rear + tail * rear, length], 1)
    width = np.concatenate([[0], np.sqrt(np.maximum(1 - (1 - nose) ** 2, 0)), np.ones(len(middle)), 1 - (1 - END) * tail, [0]])
    angle = np.arange(SIDES) * 2 * np.pi / SIDES
    r = v["fuse_max_diam"][:, None, None] / 2 * width[None, :, None]
    return np.stack(np.broadcast_arrays(x[:, :, None], r * np.cos(angle), r * np.sin(angle)), -1)


def panel(grid: tuple[int, int], foil: tuple[np.ndarray, np.ndarray, np.ndarray], span, root, tip, shift, rise, twist, x0, z0) -> np.ndarray:
    """Points of panels along y: sections between the chords, shifted, raised and twisted towards the tip."""
    half, stations = grid
    at = (np.arange(stations + 1) / stations)[None, :, None]
    span, root, tip, shift, rise, twist, x0, z0 = (np.asarray(a, float)[..., None, None] for a in (span, root, tip, shift, rise, twist, x0, z0))
    u, w = (c[:, None, :] for c in section(*foil, half))
    turn, chord = at * twist, root * (1 - at) + tip * at
    x = x0 + at * shift + chord * (u * np.cos(turn) - w * np.sin(turn))
    z = z0 + at * rise + chord * (u * np.sin(turn) + w * np.cos(turn))
    return np.stack(np.broadcast_arrays(x, at * span, z), -1)


def surfaces(v: dict[str, np.ndarray]) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """The six surfaces of some designs: name, points and facets, whose corners turn against the
    clock seen from outside."""
    n, none = len(v["fuse_length"]), np.zeros(len(v["fuse_length"]))
    yield "fuselage", body(v).reshape(n, -1, 3), loft(sum(RINGS) + 2, SIDES)
    slope = {k: v["wing_span"] * np.tan(np.radians(v[f"wing_{k}"])) for k in ("sweep", "dihedral")}
    wing = panel(WING, (v["naca_m"] / 100, v["naca_p"] / 10, v["naca_t"] / 100), v["wing_span"], v["wing_root_chord"], v["wing_tip_chord"], slope["sweep"], slope["dihedral"], np.radians(v["wing_twist"]), v["wing_x_pos"], v["wing_z_pos"])
    foil = (none, none, none + TAIL_THICKNESS)
    level = panel(TAIL, foil, v["h_stab_span"], v["h_stab_root"], v["h_stab_tip"], none, none, none, v["tail_x_pos"], none)
    fin = panel(TAIL, foil, v["v_stab_height"], v["v_stab_root"], v["v_stab_tip"], v["v_stab_root"] - v["v_stab_tip"], none, none, v["tail_x_pos"], none)
    for name, (half, stations), points in (("wing", WING, wing), ("stabilizer", TAIL, level)):
        corners = loft(stations + 1, 2 * half + 1)
        yield f"{name}_right", points.reshape(n, -1, 3), corners[:, ::-1]
        yield f"{name}_left", (points * [1, -1, 1]).reshape(n, -1, 3), corners
    yield "fin", fin[..., [0, 2, 1]].reshape(n, -1, 3), loft(TAIL[1] + 1, 2 * TAIL[0] + 1)


def facets(designs: DataFrame, by: str = "id") -> DataFrame:
    """Facets of each design: ``by``, ``surface`` and the corners ``ax .. cz`` in millimetres.

    ``designs`` holds ``by`` and the ``NEEDED`` parameters; other columns are ignored. A design with
    a null or non-finite parameter has no facets; rows of one id give their facets each. ``by`` named
    as a column of the result is an error."""
    ship(designs.sparkSession)
    names = [p + c for p in "abc" for c in "xyz"]
    if by in {"surface", *names}:
        raise ValueError(f"{by} is a column of the facets")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = np.array([batch.column(k).to_numpy(zero_copy_only=False) for k in NEEDED], float).reshape(len(NEEDED), -1)
            whole = np.flatnonzero(np.isfinite(v).all(0))
            for at in range(0, len(whole), BATCH):
                some = whole[at : at + BATCH]
                for name, points, corners in surfaces(dict(zip(NEEDED, v[:, some]))):
                    places = points[:, corners]  # design, facet, corner, axis
                    rounded = np.rint(places * 1e6)
                    same = [(rounded[:, :, a] == rounded[:, :, b]).all(-1) for a, b in ((0, 1), (1, 2), (0, 2))]
                    design, facet = np.nonzero(~(same[0] | same[1] | same[2]))
                    out = places[design, facet].reshape(-1, 9)
                    yield pa.record_batch([batch.column("id").take(pa.array(some[design])), pa.array([name]).take(pa.array(np.zeros(len(out), int))), *(pa.array(out[:, k]) for k in range(9))], ["id", "surface", *names])

    rows = designs.select(F.col(by).alias("id"), *(F.col(k).cast("double").alias(k) for k in NEEDED))
    kind = rows.schema["id"].dataType.simpleString()
    made = rows.mapInArrow(run, f"id {kind}, surface string, " + ", ".join(f"{k} double" for k in names))
    return made.withColumnRenamed("id", by)


def corner(p: str) -> Column:
    """A corner by its place to a millionth of a millimetre, as a hash."""
    return F.xxhash64(*(F.rint(F.col(p + c) * 1e6) + 0.0 for c in "xyz"))


def solids(facets: DataFrame, by: str = "id") -> DataFrame:
    """``facets``, ``area`` and ``volume`` (by the divergence theorem) of each surface of each
    design, and whether it is ``closed``; one aggregate, most of it before the shuffle."""
    at = {p: [F.col(p + x) for x in "xyz"] for p in "abc"}
    cross = lambda p, q: [p[1] * q[2] - p[2] * q[1], p[2] * q[0] - p[0] * q[2], p[0] * q[1] - p[1] * q[0]]
    minus = lambda p, q: [x - y for x, y in zip(at[p], at[q])]
    n = cross(minus("b", "a"), minus("c", "a"))
    volume = sum((x * y for x, y in zip(at["a"], cross(at["b"], at["c"]))), F.lit(0.0)) / 6
    rows = facets.select(by, "surface", volume.alias("v"), (F.sqrt(n[0] * n[0] + n[1] * n[1] + n[2] * n[2]) / 2).alias("w"), *(corner(p).alias("h" + p) for p in "abc"))

    def edge(p: str, q: str) -> Column:
        key = F.shiftright(F.xxhash64(F.least(p, q), F.greatest(p, q)), 24)
        return F.when(F.col(p) < F.col(q), key).when(F.col(p) > F.col(q), -key).otherwise(F.lit(0))

    rest = edge("ha", "hb") + edge("hb", "hc") + edge("hc", "ha")
    return rows.groupBy(by, "surface").agg(F.count("*").alias("facets"), F.sum("w").alias("area"), F.sum("v").alias("volume"), (F.sum(rest) == 0).alias("closed"))
