"""Queries on the airframe's closed forms."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import airframe as A
from ..functions import vectors as V
from ..operators import mesh as MESH
from ..operators import select as S
from ..registry import query
from .base import G_SQL, genomes, r6, table

GENES = [b[0] for b in A.BOUNDS]
PARAMS_SQL = f"{G_SQL}, pm AS (SELECT vec_id, " + ", ".join(f"{low} + ({high} - {low})::DOUBLE * greatest(least(g[{i + 1}], 1.0), 0.0) AS {name}" for i, (name, low, high) in enumerate(A.BOUNDS)) + " FROM gen), pr AS (SELECT *, fuse_length - 45.0 AS tail_x_pos, fuse_max_diam / 2 AS r FROM pm)"
SWET_SQL = "(pi() * (fuse_max_diam * 1e-3) * (fuse_length * 1e-3) * 0.7 * least(1.0 + 3.0 / power(greatest(fuse_length / fuse_max_diam, 1.0), 1.9) + 0.03443 / greatest(fuse_length * 0.25 / fuse_max_diam, 0.5) + 0.03443 / greatest(fuse_length * 0.35 / fuse_max_diam, 0.5), 1.5))"
VOLUME_SQL = "(2.0::DOUBLE / 3.0 * pi() * r * r * fuse_length * 0.25 + pi() * r * r * fuse_length * 0.4 + pi() / 3.0 * fuse_length * 0.35 * (r * r + r * r * 0.15 + r * r * 0.0225))"


@query("decode_genes", f"WITH {PARAMS_SQL} SELECT vec_id, " + ", ".join(f"round({n}, 6) AS {n}" for n in GENES) + ", round(tail_x_pos, 6) AS tail_x_pos FROM pr")
def decode_genes(spark, d):
    p = A.parameters(F.col("g"))
    return genomes(spark, d).select("vec_id", *(r6(p[n]).alias(n) for n in [*GENES, "tail_x_pos"]))


@query("normalize", "WITH b AS (SELECT min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part) SELECT p_partkey, round(CASE WHEN abs(hi - lo) < 1e-12 THEN 0 ELSE greatest(least((p_retailprice - lo) / (hi - lo), 1.0), 0.0) END, 6) AS u, 0.0::DOUBLE AS flat FROM part, b")
def normalize(spark, d):
    p = table(spark, d, "part")
    b = F.broadcast(p.agg(F.min("p_retailprice").alias("lo"), F.max("p_retailprice").alias("hi")))
    return p.join(b).select("p_partkey", r6(V.min_max(F.col("p_retailprice"), F.col("lo"), F.col("hi"))).alias("u"), V.min_max(F.col("p_retailprice"), F.col("lo"), F.col("lo")).alias("flat"))


@query("feature_project", f"WITH {PARAMS_SQL} SELECT vec_id, 22 AS n_all, round(wing_span + wing_root_chord + wing_tip_chord + wing_sweep + wing_dihedral + wing_twist + wing_x_pos + naca_m + fuse_length + fuse_max_diam + tail_x_pos, 6) AS active_sum FROM pr")
def feature_project(spark, d):
    p = A.parameters(F.col("g"))
    active = F.array(*(p[n] for n in [*GENES, "tail_x_pos"]))
    return genomes(spark, d).select("vec_id", F.size(F.array(*p.values())).alias("n_all"), r6(V.total(active)).alias("active_sum"))


@query("validate", f"WITH {G_SQL}, x AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN g[1:9] ELSE g END AS g FROM gen) SELECT vec_id, CASE WHEN len(g) <> 10 THEN -1e9::DOUBLE ELSE 0.0 END AS verdict FROM x")
def validate(spark, d):
    g = genomes(spark, d).withColumn("g", F.when(F.col("vec_id") % 7 == 0, F.slice("g", 1, 9)).otherwise(F.col("g")))
    return g.select("vec_id", F.when(F.size("g") != 10, A.REJECT).otherwise(0.0).alias("verdict"))


@query("reject_rules", f"WITH {PARAMS_SQL} SELECT vec_id, CASE WHEN {VOLUME_SQL} < 20000 THEN 'volume' WHEN vec_id % 11 = 0 THEN 'untrimmed' WHEN vec_id % 13 = 0 THEN 'mission' ELSE 'kept' END AS verdict FROM pr")
def reject_rules(spark, d):
    p = A.parameters(F.col("g"))
    verdict = F.when(A.fuselage_volume(p) < A.LEAST_VOLUME, "volume").when(F.col("vec_id") % 11 == 0, "untrimmed").when(F.col("vec_id") % 13 == 0, "mission").otherwise("kept")
    return genomes(spark, d).select("vec_id", verdict.alias("verdict"))


CF_SQL = "(CASE WHEN 1.225 * 15.0 * fuse_length * 1e-3 / 1.81e-5 < 1e3 THEN 0.0 ELSE 0.455 / power(log10(1.225 * 15.0 * fuse_length * 1e-3 / 1.81e-5), 2.58) END)"
FUSE_CD_SQL = f"({CF_SQL} * (1.0 + 60.0 / power(greatest(fuse_length / fuse_max_diam, 1.0), 3) + greatest(fuse_length / fuse_max_diam, 1.0) / 400.0) * {SWET_SQL} / (wing_span * (wing_root_chord + wing_tip_chord) * 1e-6))"


@query("fuselage", f"WITH {PARAMS_SQL} SELECT vec_id, round({VOLUME_SQL}, 4) AS volume, round({SWET_SQL}, 8) AS wetted, round({FUSE_CD_SQL}, 8) AS cd FROM pr")
def fuselage(spark, d):
    p = A.parameters(F.col("g"))
    return genomes(spark, d).select("vec_id", F.round(A.fuselage_volume(p), 4).alias("volume"), F.round(A.fuselage_wetted_area(p), 8).alias("wetted"), F.round(A.fuselage_drag(p, A.wing_area(p) * 1e-6), 8).alias("cd"))


WING_SQL = f"{PARAMS_SQL}, wg AS (SELECT *, wing_span * (wing_root_chord + wing_tip_chord) AS area, 2.0::DOUBLE / 3.0 * (wing_root_chord + wing_tip_chord - wing_root_chord * wing_tip_chord / (wing_root_chord + wing_tip_chord)) AS mac, greatest(tail_x_pos + 7.0 - wing_x_pos - 0.25 * wing_root_chord, 1e-4) AS lh, greatest(tail_x_pos + 8.75 - wing_x_pos - 0.25 * wing_root_chord, 1e-4) AS lv FROM pr)"


@query("wing_geometry", f"WITH {WING_SQL} SELECT vec_id, round(area, 4) AS area, round(mac, 6) AS mac, round(0.5 * area * mac / lh, 4) AS s_h, round(0.04 * area * 2.0 * wing_span / lv, 4) AS s_v, round(sqrt(greatest(0.5 * area * mac / lh / 1935.0, 0.01)), 6) AS scale_h, round(sqrt(greatest(0.04 * area * 2.0 * wing_span / lv / 1192.5, 0.01)), 6) AS scale_v FROM wg")
def wing_geometry(spark, d):
    p = A.parameters(F.col("g"))
    (h, v), (sh, sv) = A.tail_areas(p), A.tail_scales(p)
    return genomes(spark, d).select("vec_id", F.round(A.wing_area(p), 4).alias("area"), r6(A.mean_chord(p)).alias("mac"), F.round(h, 4).alias("s_h"), F.round(v, 4).alias("s_v"), r6(sh).alias("scale_h"), r6(sv).alias("scale_v"))


MASS_SQL = f"{WING_SQL}, ms AS (SELECT *, {SWET_SQL} * 1.2 AS m_fuse, 2.05 * area * 1e-6 AS m_wing, 2.05 * (1935.0 + 1192.5) * 1e-6 * 0.8 AS m_tail FROM wg), mt AS (SELECT *, m_fuse + m_wing + m_tail + 0.08 AS m_total FROM ms)"


@query("mass_cg", f"WITH {MASS_SQL} SELECT vec_id, round(m_fuse, 8) AS m_fuse, round(m_wing, 8) AS m_wing, round(m_tail, 8) AS m_tail, round(m_total, 8) AS m_total, round((0.08 * fuse_length * 0.18 + m_fuse * fuse_length * 0.45 + m_wing * (wing_x_pos + 0.25 * wing_root_chord) + m_tail * (tail_x_pos + 7.0)) * 1e-3 / m_total, 8) AS cg FROM mt")
def mass_cg(spark, d):
    p = A.parameters(F.col("g"))
    m = A.masses(p)
    return genomes(spark, d).select("vec_id", *(F.round(m[k], 8).alias(k) for k in ("m_fuse", "m_wing", "m_tail", "m_total")), F.round(A.centre_of_gravity(p), 8).alias("cg"))


DRAG_SQL = f"{MASS_SQL}, dr AS (SELECT *, {FUSE_CD_SQL} + 2.05 * 1.328 / sqrt(greatest(1.225 * 15.0 * (wing_root_chord + wing_tip_chord) / 2.0 * 1e-3 / 1.81e-5, 1.0)) * (1.0 + 0.24 + 60.0 * power(0.12, 4)) * 1.25 + 2.05 * 3127.5 * 1e-6 / (area * 1e-6) * 1.328 / sqrt(1.225 * 15.0 * 0.025 / 1.81e-5) * 1.2 * 1.25 AS cd0, greatest(power(2.0 * wing_span * 1e-3, 2) / (area * 1e-6), 1.0) AS ar FROM mt), dd AS (SELECT *, 1.0 / (1.0 + 0.38 * cd0 * pi() * ar) AS e, m_total * 9.81 / (0.5 * 1.225 * 225.0 * area * 1e-6) AS cl FROM dr)"


@query("drag_buildup", f"WITH {DRAG_SQL} SELECT vec_id, round(cd0, 8) AS cd0, round(ar, 6) AS aspect_ratio, round(e, 8) AS oswald, round(1.0 / (pi() * ar * greatest(e, 0.1)), 8) AS induced FROM dd")
def drag_buildup(spark, d):
    b = A.drag_buildup(A.parameters(F.col("g")))
    return genomes(spark, d).select("vec_id", F.round(b["cd0"], 8).alias("cd0"), r6(b["aspect_ratio"]).alias("aspect_ratio"), F.round(b["oswald"], 8).alias("oswald"), F.round(b["induced"], 8).alias("induced"))


@query("fitness", f"WITH {DRAG_SQL}, q AS (SELECT vec_id, cl / (cd0 + cl * cl / (pi() * ar * greatest(e, 0.1))) AS ld, cl, {VOLUME_SQL} AS vol FROM dd) SELECT vec_id, round(CASE WHEN vol < 20000 THEN -1e9 ELSE ld - 0.5 * abs(10 * cl - 2) - 20.0 * power(greatest(0.1 - cl, 0.0), 2) - 30.0 * power(0.01 * cl, 2) - 5.0 * power(12.0 * cl / 30.0, 2) - 0.5 * (3.0 / 5.0) END, 6) AS fitness FROM q")
def fitness(spark, d):
    p = A.parameters(F.col("g"))
    b, cl = A.drag_buildup(p), A.required_cl(p)
    rows = genomes(spark, d).select("vec_id", cl.alias("cl"), (cl / (b["cd0"] + cl * cl * b["induced"])).alias("ld"), A.fuselage_volume(p).alias("vol"))
    c = F.col("cl")
    f = A.fitness(F.col("ld"), 10 * c - 2, 0.1 - c, 0.01 * c, 12.0 * c, F.lit(3.0))
    return rows.select("vec_id", r6(F.when(F.col("vol") < A.LEAST_VOLUME, A.REJECT).otherwise(f)).alias("fitness"))


FLOWN_SQL = f"{DRAG_SQL}, q AS (SELECT vec_id, m_total AS mass, CASE WHEN vec_id % 9 <> 0 THEN cl / (cd0 + cl * cl / (pi() * ar * greatest(e, 0.1))) END AS ld, {VOLUME_SQL} AS vol FROM dd), fe AS (SELECT round(ld, 6) AS ld, round(mass, 6) AS mass FROM q WHERE ld > 4.0 AND vol >= 20000)"


@query("feasible_front", f"WITH {FLOWN_SQL} SELECT DISTINCT ld, mass FROM fe a WHERE NOT EXISTS (SELECT 1 FROM fe b WHERE b.ld >= a.ld AND b.mass <= a.mass AND (b.ld > a.ld OR b.mass < a.mass))")
def feasible_front(spark, d):
    """Glide ratio against mass of the feasible designs that no other one beats; each ninth design
    plays one that the solver gave nothing for."""
    p = A.parameters(F.col("g"))
    b, cl = A.drag_buildup(p), A.required_cl(p)
    flown = F.when(F.col("vec_id") % 9 != 0, cl / (b["cd0"] + cl * cl * b["induced"]))
    rows = genomes(spark, d).select(flown.alias("ld"), A.masses(p)["m_total"].alias("mass"), (A.fuselage_volume(p) < A.LEAST_VOLUME).alias("rejected"))
    return S.pareto(S.feasible(rows).select(r6("ld").alias("ld"), r6("mass").alias("mass")), "ld", "mass")


@query("fuselage_empty", "SELECT n, 0.0::DOUBLE AS wetted, 0.0::DOUBLE AS cd FROM (SELECT unnest(['area', 'diameter', 'length', 'speed']) AS n)")
def fuselage_empty(spark, d):
    """No drag without a length, a diameter, an area or a speed."""
    rows = spark.createDataFrame([("length", 0.0, 60.0, 1.0), ("diameter", 600.0, 0.0, 1.0), ("area", 600.0, 60.0, 0.0), ("speed", 600.0, 60.0, 1.0)], "n string, fuse_length double, fuse_max_diam double, s double")
    p = {c: F.col(c) for c in ("fuse_length", "fuse_max_diam")} | {"nose_ratio": F.lit(0.25), "tail_ratio": F.lit(0.35)}
    drag = F.when(F.col("n") == "speed", A.fuselage_drag(p, F.col("s"), 0.0)).otherwise(A.fuselage_drag(p, F.col("s")))
    return rows.select("n", F.when(F.col("n").isin("area", "speed"), 0.0).otherwise(A.fuselage_wetted_area(p)).alias("wetted"), drag.alias("cd"))


@query("fitness_smooth", f"WITH {DRAG_SQL}, q AS (SELECT vec_id, cl / (cd0 + cl * cl / (pi() * ar * greatest(e, 0.1))) AS ld, cl, {VOLUME_SQL} AS vol FROM dd) SELECT vec_id, round(CASE WHEN vec_id % 9 = 0 THEN -20.0 ELSE greatest(least(ld - 10.0 * tanh(power((vol - 50000) / 50000, 2)) - 0.5 * abs(10 * cl - 2) - 15.0 * power(ln(1 + exp(5.0 * (0.1 - cl + 0.05))) / 5.0, 2), 40.0), -20.0) END, 6) AS fitness FROM q")
def fitness_smooth(spark, d):
    p = A.parameters(F.col("g"))
    b, cl = A.drag_buildup(p), A.required_cl(p)
    ld = F.when(F.col("vec_id") % 9 != 0, cl / (b["cd0"] + cl * cl * b["induced"]))
    return genomes(spark, d).select("vec_id", r6(A.fitness_smooth(ld, A.fuselage_volume(p), 10 * cl - 2, 0.1 - cl)).alias("fitness"))


@query("battery", "WITH x AS (SELECT event_id, value / 100 AS soc, value AS i FROM events) SELECT event_id, round((3.3 + soc * (4.2 - 3.3)) * 3, 6) AS voc, round(greatest((3.3 + soc * (4.2 - 3.3)) * 3 - i * 0.03, 0.0), 6) AS terminal, round(least(greatest((soc * 2.2 - i * 60.0 / 3600.0) / 2.2, 0.0), 1.0), 6) AS soc_after FROM x")
def battery(spark, d):
    x = table(spark, d, "events").select("event_id", (F.col("value") / 100).alias("soc"), F.col("value").alias("i"))
    voc, v = A.battery_voltage(F.col("soc"), F.col("i"))
    return x.select("event_id", r6(voc).alias("voc"), r6(v).alias("terminal"), r6(A.battery_discharge(F.col("soc"), F.col("i"), F.lit(60.0))).alias("soc_after"))


@query("motor", "WITH x AS (SELECT event_id, value * 120 AS rpm, 11.1::DOUBLE AS v FROM events), c AS (SELECT *, greatest(rpm / 1000.0, 0.0) AS emf, greatest((v - greatest(rpm / 1000.0, 0.0)) / 0.06, 0.0) AS i FROM x) SELECT event_id, round(emf, 6) AS emf, round(i, 6) AS current, round(30.0 / (pi() * 1000.0) * greatest(i - 0.8, 0.0), 6) AS torque, i > 40.0 AS over FROM c")
def motor(spark, d):
    m = A.motor(F.lit(11.1), F.col("value") * 120)
    return table(spark, d, "events").select("event_id", *(r6(m[k]).alias(k) for k in ("emf", "current", "torque")), m["over"].alias("over"))


@query("propeller", f"WITH x AS (SELECT event_id, value * 120 / 60.0 AS n, (event_id % 30)::DOUBLE AS speed FROM events), j AS (SELECT *, CASE WHEN n <= 0 THEN 0.0 ELSE speed / (n * 0.254) END AS j FROM x), c AS (SELECT *, CASE WHEN j >= 0.75 THEN 0.0 ELSE greatest(0.066 * (1.0 - power(j / 0.75, 1.5)), 0.0) END AS ct, CASE WHEN j >= 0.75 THEN 0.005 ELSE greatest({0.045 * (0.1524 / 0.254) ** 1.2!r} * (1.0 - 0.3 * (j / 0.75)), 0.005) END AS cp FROM j) SELECT event_id, round(j, 5) AS j, round(ct, 6) AS ct, round(cp, 6) AS cp, round(CASE WHEN n <= 0 THEN 0.0 ELSE ct * 1.225 * n * n * power(0.254, 4) END, 6) AS thrust, round(CASE WHEN n <= 0 THEN 0.0 ELSE cp * 1.225 * n * n * power(0.254, 5) / (2.0 * pi()) END, 6) AS torque FROM c")
def propeller(spark, d):
    p = A.propeller(F.col("value") * 120, (F.col("event_id") % 30).cast("double"))
    return table(spark, d, "events").select("event_id", F.round(p["j"], 5).alias("j"), *(r6(p[k]).alias(k) for k in ("ct", "cp", "thrust", "torque")))


@query("naca4", f"WITH {PARAMS_SQL}, x AS (SELECT vec_id, naca_m / 100 AS m, i, 0.5 * (1 - cos(i * pi() / 24)) AS x FROM pr, range(25) t(i)), y AS (SELECT *, 0.6 * (0.2969 * sqrt(greatest(x, 0.0)) - 0.126 * x - 0.3516 * x * x + 0.2843 * x * x * x - 0.1015 * x * x * x * x) AS yt, CASE WHEN m = 0 THEN 0 WHEN x < 0.4 THEN m / 0.16 * (0.8 * x - x * x) ELSE m / 0.36 * (0.2 + 0.8 * x - x * x) END AS yc, atan(CASE WHEN m = 0 THEN 0 WHEN x < 0.4 THEN 2 * m / 0.16 * (0.4 - x) ELSE 2 * m / 0.36 * (0.4 - x) END) AS a FROM x) SELECT vec_id, i::INT AS i, round(x - yt * sin(a), 6) AS xu, round(yc + yt * cos(a), 6) AS yu, round(x + yt * sin(a), 6) AS xl, round(yc - yt * cos(a), 6) AS yl FROM y")
def naca4(spark, d):
    p = A.parameters(F.col("g"))
    grid = genomes(spark, d).select("vec_id", (p["naca_m"] / 100).alias("m"), F.explode(F.sequence(F.lit(0), F.lit(24))).alias("i"))
    x = 0.5 * (1 - F.cos(F.col("i") * math.pi / 24))
    pts = A.naca_point(x, F.col("m"), F.lit(0.4), F.lit(0.12))
    return grid.select("vec_id", "i", *(r6(pts[k]).alias(k) for k in ("xu", "yu", "xl", "yl")))


@query("backoff", "SELECT a::INT AS attempt, least(100.0 * power(2, a - 1), 5000.0)::DOUBLE AS ms FROM range(1, 11) t(a)")
def backoff(spark, d):
    from ..streaming.retry import delay_ms

    return spark.createDataFrame([(a, delay_ms(a, jitter=0.0)) for a in range(1, 11)], "attempt int, ms double")


# The meshes' volumes by other ways: slices of the fuselage as prismatoids, tails as cones' ends, the
# wing's skin and ends by determinants.
FOIL_SQL = "5.0::DOUBLE * {t} * (0.2969 * sqrt(x) - 0.126 * x - 0.3516 * x * x + 0.2843 * x * x * x - 0.1015 * x * x * x * x)"
MESH_SQL = f"""{PARAMS_SQL},
ring AS (SELECT i, CASE WHEN i <= 10 THEN 0.25 * i / 10 WHEN i <= 16 THEN 0.25 + 0.4 * (i - 10) / 6 WHEN i <= 28 THEN 0.65 + 0.35 * (i - 16) / 12 ELSE 1.0 END::DOUBLE AS x,
 CASE WHEN i <= 10 THEN sqrt(greatest(1 - power(1 - i / 10.0::DOUBLE, 2), 0)) WHEN i <= 16 THEN 1.0 WHEN i <= 28 THEN 1.0 - 0.85::DOUBLE * (i - 16) / 12 ELSE 0.0 END::DOUBLE AS w FROM generate_series(0, 29) r(i)),
tube AS (SELECT sum(10 * sin(pi() / 10) * (b.x - a.x) / 3 * (a.w * a.w + a.w * b.w + b.w * b.w)) AS v FROM ring a JOIN ring b ON b.i = a.i + 1),
tailp AS (SELECT k, x, CASE WHEN k <= 16 THEN 1 ELSE -1 END * {FOIL_SQL.format(t="0.1")} AS y FROM (SELECT k, 0.5::DOUBLE * (1 - cos(abs(k - 16) * pi() / 16)) AS x FROM generate_series(0, 32) r(k))),
tailf AS (SELECT abs(sum(a.x * b.y - b.x * a.y)) / 2 AS area FROM tailp a JOIN tailp b ON b.k = (a.k + 1) % 33),
wk AS (SELECT k, 0.5::DOUBLE * (1 - cos(abs(k - 20) * pi() / 20)) AS x FROM generate_series(0, 40) r(k)),
wf AS (SELECT *, CASE WHEN k <= 20 THEN 1 ELSE -1 END * {FOIL_SQL.format(t="0.12")} AS up,
 naca_m / 100 / CASE WHEN x < 0.4 THEN 0.16::DOUBLE ELSE 0.36::DOUBLE END AS sc FROM pr, wk),
wl AS (SELECT *, sc * CASE WHEN x < 0.4 THEN 0.8 * x - x * x ELSE 0.2::DOUBLE + 0.8 * x - x * x END AS camber, atan(2 * sc * (0.4::DOUBLE - x)) AS lean FROM wf),
ws AS (SELECT *, x - up * sin(lean) AS u, camber + up * cos(lean) AS w, radians(wing_twist) * i / 12 AS turn, wing_root_chord + (wing_tip_chord - wing_root_chord) * i / 12 AS chord FROM wl, generate_series(0, 12) r(i)),
wp AS (SELECT vec_id, i, k, wing_x_pos + wing_span * tan(radians(wing_sweep)) * i / 12 + chord * (u * cos(turn) - w * sin(turn)) AS x, wing_span * i / 12 AS y,
 -2.0::DOUBLE + wing_span * tan(radians(wing_dihedral)) * i / 12 + chord * (u * sin(turn) + w * cos(turn)) AS z FROM ws),
tri AS (SELECT i AS ai, k AS ak, i AS bi, (k + 1) % 41 AS bk, i + 1 AS ci, (k + 1) % 41 AS ck FROM generate_series(0, 11) r(i), generate_series(0, 40) q(k)
 UNION ALL SELECT i, k, i + 1, (k + 1) % 41, i + 1, k FROM generate_series(0, 11) r(i), generate_series(0, 40) q(k)
 UNION ALL SELECT 0, 0, 0, k + 1, 0, k FROM generate_series(1, 39) q(k) UNION ALL SELECT 12, 0, 12, k, 12, k + 1 FROM generate_series(1, 39) q(k)),
wv AS (SELECT a.vec_id, abs(sum(a.x * (b.y * c.z - b.z * c.y) + a.y * (b.z * c.x - b.x * c.z) + a.z * (b.x * c.y - b.y * c.x))) / 6 AS v
 FROM tri JOIN wp a ON a.i = ai AND a.k = ak JOIN wp b ON b.vec_id = a.vec_id AND b.i = bi AND b.k = bk JOIN wp c ON c.vec_id = a.vec_id AND c.i = ci AND c.k = ck GROUP BY 1)"""


@query("airframe_mesh", f"WITH {MESH_SQL} SELECT vec_id, (20 + 27 * 40 + 20 + 2 * (12 * 41 * 2 + 78) + 3 * (6 * 33 * 2 + 62))::BIGINT AS facets, true AS closed, round(fuse_length * r * r * tube.v, 2) AS fuselage, round(2 * wv.v, 2) AS wing, round(area * (2 * 45.0::DOUBLE * (28 * 28 + 28 * 15 + 15 * 15) + 45.0::DOUBLE * (35 * 35 + 35 * 18 + 18 * 18)) / 3, 2) AS tail, round(fuse_length * r * r * tube.v / {VOLUME_SQL}, 6) AS of_formula FROM pr JOIN wv USING (vec_id), tube, tailf")
def airframe_mesh(spark, d):
    """Facets, closedness and volumes of every design's mesh, and the fuselage's share of its formula."""
    p = A.parameters(F.col("g"))
    designs = genomes(spark, d).select("vec_id", *(p[n].alias(n) for n in MESH.NEEDED))
    parts = MESH.solids(MESH.facets(designs, "vec_id"), "vec_id")
    volume = lambda like: F.sum(F.when(F.col("surface").rlike(like), F.col("volume")).otherwise(0.0))
    whole = parts.groupBy("vec_id").agg(F.sum("facets").alias("facets"), F.every("closed").alias("closed"), volume("fuselage").alias("fuselage"), volume("wing").alias("wing"), volume("stabilizer|fin").alias("tail"))
    formula = designs.select("vec_id", A.fuselage_volume({n: F.col(n) for n in MESH.NEEDED}).alias("formula"))
    rows = whole.join(formula, "vec_id").withColumn("of_formula", F.round(F.col("fuselage") / F.col("formula"), 6))
    return rows.select("vec_id", "facets", "closed", *(F.round(c, 2).alias(c) for c in ("fuselage", "wing", "tail")), "of_formula")
