"""Geometry, mass, drag, powertrain and fitness of a small aircraft as column expressions.

Lengths are in millimetres where a parameter table gives them, SI units elsewhere. Only closed
forms are here; roots and trajectories are in ``models.mission``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vectors import decode

# The baseline of all parameters and the bounds of the ten genes, in gene order.
BASELINE = {
    "fuse_length": 250.0, "fuse_max_diam": 20.0, "nose_ratio": 0.25, "tail_ratio": 0.35, "wing_span": 140.0, "wing_root_chord": 55.0,
    "wing_tip_chord": 25.0, "wing_sweep": 12.0, "wing_dihedral": 2.5, "wing_twist": -2.0, "wing_x_pos": 75.0, "wing_z_pos": -2.0,
    "naca_m": 2.0, "naca_p": 4.0, "naca_t": 12.0, "tail_x_pos": 205.0, "v_stab_height": 45.0, "v_stab_root": 35.0,
    "v_stab_tip": 18.0, "h_stab_span": 45.0, "h_stab_root": 28.0, "h_stab_tip": 15.0,
}
BOUNDS = (
    ("wing_span", 80.0, 220.0), ("wing_root_chord", 35.0, 75.0), ("wing_tip_chord", 10.0, 45.0), ("wing_sweep", 0.0, 25.0), ("wing_dihedral", 0.0, 4.0),
    ("wing_twist", -4.0, 0.0), ("wing_x_pos", 55.0, 95.0), ("naca_m", 0.0, 5.0), ("fuse_length", 200.0, 350.0), ("fuse_max_diam", 14.0, 32.0),
)
#: Fitness of a rejected design, and the least fuselage volume.
REJECT, LEAST_VOLUME = -1e9, 20_000.0
RHO, MU, G = 1.225, 1.81e-5, 9.81
AVIONICS_KG, FUSE_KG_M2, WING_KG_M2 = 0.080, 1.20, 1.00
# Fixed values of the formulas. Wetted area: fineness, its exponent, ends, most; least fineness of an end.
SHAPE_FINENESS, SHAPE_POWER, SHAPE_END, SHAPE_MOST, END_FINENESS = 3.0, 1.9, 0.03443, 1.5, 0.5
# Friction: laminar and turbulent coefficient, the latter's exponent; form factor of a body.
LAMINAR, TURBULENT, TURBULENT_POWER, LAMINAR_BELOW = 1.328, 0.455, 2.58, 1e3
FORM_CUBE, FORM_LINEAR = 60.0, 400.0
# Lifting surfaces: wetted to plan area, thickness terms, interference, the tail's form and chord, span efficiency.
WETTED, THICK, THICK_FOURTH, INTERFERENCE, TAIL_FORM, TAIL_CHORD_M, EFFICIENCY_LOSS = 2.05, 2.0, 60.0, 1.25, 1.20, 0.025, 0.38
# Masses and their places: the tail's share of the wing's weight an area, avionics and fuselage along the length, a chord's quarter.
TAIL_WEIGHT, AVIONICS_AT, FUSE_AT, QUARTER = 0.8, 0.18, 0.45, 0.25


def parameters(genes: Column) -> dict[str, Column]:
    """All parameters of a genome; the tail sits ten millimetres before the end of the fuselage."""
    out = {k: F.lit(v) for k, v in BASELINE.items()}
    out |= dict(zip((b[0] for b in BOUNDS), decode(genes, BOUNDS)))
    out["tail_x_pos"] = out["fuse_length"] - max(BASELINE["v_stab_root"], BASELINE["h_stab_root"]) - 10.0
    return out


def at_least(x: Column, low: float) -> Column:
    return F.greatest(x, F.lit(low))


def fuselage_volume(p: dict[str, Column]) -> Column:
    r, length = p["fuse_max_diam"] / 2.0, p["fuse_length"]
    nose, tail = length * p["nose_ratio"], length * p["tail_ratio"]
    tip = r * 0.15
    return F.lit(2.0 / 3.0 * math.pi) * r * r * nose + F.lit(math.pi) * r * r * (length - nose - tail) + F.lit(math.pi / 3.0) * tail * (r * r + r * tip + tip * tip)


def fuselage_wetted_area(p: dict[str, Column]) -> Column:
    """Square metres; zero without a length or a diameter."""
    length, d = p["fuse_length"] * 1e-3, p["fuse_max_diam"] * 1e-3
    width = F.nullif(d, F.lit(0.0))
    fineness = at_least(length / width, 1.0)
    nose, tail = at_least(length * p["nose_ratio"] / width, END_FINENESS), at_least(length * p["tail_ratio"] / width, END_FINENESS)
    body = F.lit(math.pi) * d * length * (1.0 - 0.5 * (p["nose_ratio"] + p["tail_ratio"]))
    shape = 1.0 + SHAPE_FINENESS / F.pow(fineness, F.lit(SHAPE_POWER)) + SHAPE_END / nose + SHAPE_END / tail
    return F.when((length <= 0) | (d <= 0), 0.0).otherwise(body * F.least(shape, F.lit(SHAPE_MOST)))


def fuselage_drag(p: dict[str, Column], s_ref: Column, speed: float = 15.0) -> Column:
    """Skin friction with a form factor, referred to ``s_ref``; 0 without length, width, area or speed."""
    length, d = p["fuse_length"] * 1e-3, p["fuse_max_diam"] * 1e-3
    re = RHO * speed * length / MU
    cf = F.when(re < LAMINAR_BELOW, LAMINAR / F.sqrt(at_least(re, 1.0))).otherwise(TURBULENT / F.pow(F.log10(re), F.lit(TURBULENT_POWER)))
    fineness = at_least(length / F.nullif(d, F.lit(0.0)), 1.0)
    form = 1.0 + FORM_CUBE / (fineness * fineness * fineness) + fineness / FORM_LINEAR
    empty = (length <= 0) | (d <= 0) | (s_ref <= 0) | (F.lit(speed) <= 0)
    return F.when(empty, 0.0).otherwise(cf * form * fuselage_wetted_area(p) / F.nullif(s_ref, F.lit(0.0)))


def wing_area(p: dict[str, Column]) -> Column:
    return p["wing_span"] * (p["wing_root_chord"] + p["wing_tip_chord"])


def mean_chord(p: dict[str, Column]) -> Column:
    r, t = p["wing_root_chord"], p["wing_tip_chord"]
    return F.lit(2.0 / 3.0) * (r + t - r * t / at_least(r + t, 1e-6))


def tail_areas(p: dict[str, Column], vh: float = 0.5, vv: float = 0.04) -> tuple[Column, Column]:
    """Areas of both stabilizers for the target volume coefficients."""
    ac = p["wing_x_pos"] + 0.25 * p["wing_root_chord"]
    arm_h = at_least(p["tail_x_pos"] + 0.25 * BASELINE["h_stab_root"] - ac, 1e-4)
    arm_v = at_least(p["tail_x_pos"] + 0.25 * BASELINE["v_stab_root"] - ac, 1e-4)
    return vh * wing_area(p) * mean_chord(p) / arm_h, vv * wing_area(p) * (2.0 * p["wing_span"]) / arm_v


def tail_scales(p: dict[str, Column], vh: float = 0.5, vv: float = 0.04) -> tuple[Column, Column]:
    """Factors on the baseline's tail that reach the target areas."""
    b = BASELINE
    h0 = b["h_stab_span"] * (b["h_stab_root"] + b["h_stab_tip"])
    v0 = b["v_stab_height"] * (b["v_stab_root"] + b["v_stab_tip"]) / 2.0
    h, v = tail_areas(p, vh, vv)
    return F.sqrt(at_least(h / max(h0, 1e-4), 0.01)), F.sqrt(at_least(v / max(v0, 1e-4), 0.01))


def masses(p: dict[str, Column]) -> dict[str, Column]:
    fuse = fuselage_wetted_area(p) * FUSE_KG_M2
    wing = WETTED * wing_area(p) * 1e-6 * WING_KG_M2
    h = p["h_stab_span"] * (p["h_stab_root"] + p["h_stab_tip"]) * 1e-6
    v = p["v_stab_height"] * (p["v_stab_root"] + p["v_stab_tip"]) / 2.0 * 1e-6
    tail = WETTED * (h + v) * (WING_KG_M2 * TAIL_WEIGHT)
    return {"m_fuse": fuse, "m_wing": wing, "m_tail": tail, "m_avionics": F.lit(AVIONICS_KG), "m_total": fuse + wing + tail + AVIONICS_KG}


def centre_of_gravity(p: dict[str, Column]) -> Column:
    m = masses(p)
    moments = m["m_avionics"] * (p["fuse_length"] * AVIONICS_AT) + m["m_fuse"] * (p["fuse_length"] * FUSE_AT) + m["m_wing"] * (p["wing_x_pos"] + QUARTER * p["wing_root_chord"]) + m["m_tail"] * (p["tail_x_pos"] + QUARTER * p["h_stab_root"])
    return moments * 1e-3 / at_least(m["m_total"], 1e-6)


def drag_buildup(p: dict[str, Column], speed: float = 15.0) -> dict[str, Column]:
    """Parasitic drag, aspect ratio, span efficiency and the least induced drag per CL squared."""
    s = wing_area(p) * 1e-6
    chord = (p["wing_root_chord"] + p["wing_tip_chord"]) / 2.0 * 1e-3
    flat = lambda re: LAMINAR / F.sqrt(at_least(re, 1.0))
    t = p["naca_t"] / 100.0
    wing = WETTED * flat(RHO * speed * chord / MU) * (1.0 + THICK * t + THICK_FOURTH * t * t * t * t) * INTERFERENCE
    s_tail = (p["h_stab_span"] * (p["h_stab_root"] + p["h_stab_tip"]) + p["v_stab_height"] * (p["v_stab_root"] + p["v_stab_tip"]) / 2.0) * 1e-6
    tail = WETTED * s_tail / s * flat(F.lit(RHO * speed * TAIL_CHORD_M / MU)) * TAIL_FORM * INTERFERENCE
    cd0 = fuselage_drag(p, s, speed) + wing + tail
    span = 2.0 * p["wing_span"] * 1e-3
    ar = at_least(span * span / at_least(s, 1e-6), 1.0)
    e = 1.0 / (1.0 + EFFICIENCY_LOSS * cd0 * math.pi * ar)
    return {"cd0": cd0, "aspect_ratio": ar, "oswald": e, "induced": 1.0 / (math.pi * ar * at_least(e, 0.1))}


def required_cl(p: dict[str, Column], speed: float = 15.0) -> Column:
    return masses(p)["m_total"] * G / (0.5 * RHO * speed * speed * wing_area(p) * 1e-6)


def fitness(ld: Column, alpha: Column, cm_alpha: Column, cm_trim: Column, takeoff_m: Column | None = None, energy_wh: Column | None = None) -> Column:
    """Glide ratio less the penalties of trim angle, instability, moment, take-off and energy."""
    unstable = at_least(cm_alpha, 0.0)
    out = ld - 0.5 * F.abs(alpha) - 20.0 * unstable * unstable - 30.0 * cm_trim * cm_trim
    if takeoff_m is not None:
        out = out - 5.0 * (takeoff_m / 30.0) * (takeoff_m / 30.0) - 0.5 * (energy_wh / 5.0)
    return out


def fitness_smooth(ld: Column, volume: Column, alpha: Column, cm_alpha: Column, target: float = 50_000.0) -> Column:
    """The variant with smooth penalties, clipped to [-20, 40]; -20 without a glide ratio."""
    ratio = (volume - target) / target
    margin = F.log1p(F.exp(5.0 * (cm_alpha + 0.05))) / 5.0
    raw = ld - 10.0 * F.tanh(ratio * ratio) - 0.5 * F.abs(alpha) - 15.0 * margin * margin
    return F.when(ld.isNull() | F.isnan(ld), -20.0).otherwise(F.least(at_least(raw, -20.0), F.lit(40.0)))


def battery_voltage(soc: Column, current: Column, cells: int = 3, resistance: float = 0.03) -> tuple[Column, Column]:
    """Open-circuit and terminal voltage."""
    voc = (3.3 + soc * (4.2 - 3.3)) * cells
    return voc, at_least(voc - current * resistance, 0.0)


def battery_discharge(soc: Column, current: Column, seconds: Column, capacity: float = 2.2) -> Column:
    left = (soc * capacity - current * seconds / 3600.0) / capacity
    return F.least(at_least(left, 0.0), F.lit(1.0))


def motor(voltage: Column, rpm: Column, kv: float = 1000.0, ohms: float = 0.06, idle: float = 0.8, limit: float = 40.0) -> dict[str, Column]:
    emf = at_least(rpm / kv, 0.0)
    current = at_least((voltage - emf) / ohms, 0.0)
    return {"emf": emf, "current": current, "torque": 30.0 / (math.pi * kv) * at_least(current - idle, 0.0), "over": current > limit}


def propeller(rpm: Column, speed: Column, diameter: float = 0.254, pitch: float = 0.1524) -> dict[str, Column]:
    ratio = pitch / diameter
    ct0, top, cp0 = 0.11 * ratio, 1.25 * ratio, 0.045 * ratio**1.2
    n = rpm / 60.0
    still = n <= 0
    j = F.when(still, 0.0).otherwise(speed / (n * diameter))
    ct = F.when(j >= top, 0.0).otherwise(at_least(ct0 * (1.0 - F.pow(j / top, F.lit(1.5))), 0.0))
    cp = F.when(j >= top, 0.005).otherwise(at_least(cp0 * (1.0 - 0.3 * (j / top)), 0.005))
    thrust = F.when(still, 0.0).otherwise(ct * RHO * n * n * diameter**4)
    torque = F.when(still, 0.0).otherwise(cp * RHO * n * n * n * diameter**5 / (2.0 * math.pi * n))
    return {"j": j, "ct": ct, "cp": cp, "thrust": thrust, "torque": torque}


def naca_point(x: Column, m: Column, p: Column, t: Column) -> dict[str, Column]:
    """Upper and lower contour of a four-digit section at chord position x."""
    half = 5.0 * t * (0.2969 * F.sqrt(at_least(x, 0.0)) - 0.126 * x - 0.3516 * x * x + 0.2843 * x * x * x - 0.1015 * x * x * x * x)
    flat = (p == 0) | (m == 0)
    front, rear = m / (p * p), m / ((1 - p) * (1 - p))
    camber = F.when(flat, 0.0).when(x < p, front * (2 * p * x - x * x)).otherwise(rear * (1 - 2 * p + 2 * p * x - x * x))
    slope = F.when(flat, 0.0).when(x < p, 2 * front * (p - x)).otherwise(2 * rear * (p - x))
    a = F.atan(slope)
    return {"xu": x - half * F.sin(a), "yu": camber + half * F.cos(a), "xl": x + half * F.sin(a), "yl": camber - half * F.cos(a)}
