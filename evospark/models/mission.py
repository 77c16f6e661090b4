"""Polars, trim, powertrain equilibrium and missions, vectorized over designs.

A closed-form lifting-line polar stands in for a vortex-lattice solver, which this package doesn't
hold; any evaluator that gives the same polar columns can take its place.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..session import ship

RHO, G, CAPACITY_AH = 1.225, 9.81, 2.2
SWEEP = np.arange(-4.0, 15.0, 1.0)
#: Battery, motor and propeller of the standard powertrain.
CELLS, R_BATTERY, KV, R_MOTOR, IDLE_A, DIAMETER, PITCH = 3, 0.03, 1000.0, 0.06, 0.8, 0.254, 0.1524
ROLLING, LONGEST_M, FLIGHT_S = 0.04, 30.0, 30.0


def interpolate(x: np.ndarray, xs: np.ndarray, ys: np.ndarray) -> np.ndarray:
    """Linear, clamped at the ends; a row of ``ys`` (and of ``xs``, if it has rows) for each x."""
    if xs.ndim == 1:
        xs = np.broadcast_to(xs, ys.shape)
    rows = np.arange(len(ys))
    k = np.clip((xs <= x[:, None]).sum(1) - 1, 0, ys.shape[1] - 2)
    x0, x1 = xs[rows, k], xs[rows, k + 1]
    t = np.clip((x - x0) / np.where(x1 != x0, x1 - x0, 1.0), 0.0, 1.0)
    return ys[rows, k] + t * (ys[rows, k + 1] - ys[rows, k])


def polar(aspect: np.ndarray, camber: np.ndarray, cd0: np.ndarray, oswald: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """CL, CD and CM over the sweep of angles, by lifting-line slopes up to a soft stall."""
    slope = 2 * math.pi / (1 + 2 / aspect)
    a = np.radians(SWEEP)[None, :] + np.radians(camber)[:, None]
    cl = 1.4 * np.tanh(slope[:, None] * a / 1.4)
    cd = cd0[:, None] + cl**2 / (math.pi * aspect * np.maximum(oswald, 0.1))[:, None]
    cm = -0.02 * camber[:, None] - 0.12 * cl
    return cl, cd, cm


def trim(cl_req, cl, cd, cm) -> dict[str, np.ndarray]:
    """Glide ratio, angle, moment and moment slope at the required CL; NaN beyond the sweep."""
    alpha = interpolate(cl_req, cl, np.broadcast_to(SWEEP, cl.shape))
    out = (cl_req < cl.min(1)) | (cl_req > cl.max(1))
    mid = len(SWEEP) // 2
    step = np.radians(SWEEP[mid + 1] - SWEEP[mid - 1])
    res = {"ld": cl_req / np.maximum(interpolate(cl_req, cl, cd), 1e-4), "alpha": alpha, "cm_trim": interpolate(alpha, SWEEP, cm), "cm_alpha": (cm[:, mid + 1] - cm[:, mid - 1]) / step}
    return {k: np.where(out, np.nan, v) for k, v in res.items()}


def _propeller(rpm, speed):
    ratio = PITCH / DIAMETER
    n = rpm / 60
    top = 1.25 * ratio
    j = np.where(n > 0, speed / np.maximum(n * DIAMETER, 1e-12), 0.0)
    ct = np.where(j >= top, 0.0, 0.11 * ratio * (1 - np.minimum(j / top, 1) ** 1.5))
    cp = np.where(j >= top, 0.005, np.maximum(0.045 * ratio**1.2 * (1 - 0.3 * j / top), 0.005))
    thrust = np.where(n > 0, ct * RHO * n**2 * DIAMETER**4, 0.0)
    return thrust, np.where(n > 0, cp * RHO * n**2 * DIAMETER**5 / (2 * math.pi), 0.0)


def powertrain(speed: np.ndarray, throttle: float, soc: np.ndarray) -> dict[str, np.ndarray]:
    """Thrust, current, speed and power where motor and propeller torque agree, by bisection to
    under one revolution a minute for all rows at once."""
    voc = (3.3 + soc * 0.9) * CELLS
    throttle = min(max(throttle, 0.0), 1.0)
    top = throttle * voc * KV
    current = lambda rpm: np.maximum((throttle * voc - rpm / KV) / (R_MOTOR + throttle**2 * R_BATTERY), 0.0)
    gap = lambda rpm: 30 / (math.pi * KV) * np.maximum(current(rpm) - IDLE_A, 0) - _propeller(rpm, speed)[1]
    low, high = np.ones_like(voc), np.maximum(top, 1.0)
    stalled, free = gap(low) <= 0, gap(high) >= 0
    for _ in range(24):
        mid = (low + high) / 2
        up = gap(mid) > 0
        low, high = np.where(up, mid, low), np.where(up, high, mid)
    rpm = np.where(stalled, 0.0, np.where(free, top, (low + high) / 2))
    off = (soc <= 0) | (throttle <= 0)
    rpm = np.where(off, 0.0, rpm)
    amps = np.where(off, 0.0, current(rpm))
    return {"thrust": np.where(off, 0.0, _propeller(rpm, speed)[0]), "current": amps, "rpm": rpm, "power": amps * np.maximum(voc - amps * R_BATTERY, 0.0)}


def mission(mass: np.ndarray, area: np.ndarray, cl, cd, step: float = 0.05) -> dict[str, np.ndarray]:
    """Ground roll by the classical Runge-Kutta method until rotation or the runway's end, then
    cruise in closed form at 60 % throttle."""
    n, weight = len(mass), mass * G
    v_rotate = 1.15 * np.sqrt(2 * weight / (RHO * area * cl.max(1)))
    cl0, cd0 = interpolate(np.zeros(n), SWEEP, cl), interpolate(np.zeros(n), SWEEP, cd)

    def slope(y):
        v = np.maximum(y[1], 0)
        p = powertrain(v, 1.0, np.clip(y[3], 0, 1))
        q = 0.5 * RHO * v**2 * area
        force = p["thrust"] - q * cd0 - ROLLING * np.maximum(weight - q * cl0, 0)
        return np.stack((y[1], force / mass, p["power"], -p["current"] / (3600 * CAPACITY_AH)))

    y = np.stack((np.zeros(n), np.full(n, 0.5), np.zeros(n), np.ones(n)))
    t, rolling = np.zeros(n), np.ones(n, bool)
    for _ in range(int(30 / step)):
        if not rolling.any():
            break
        k1 = slope(y)
        k2 = slope(y + step / 2 * k1)
        k3 = slope(y + step / 2 * k2)
        k4 = slope(y + step * k3)
        new = y + step / 6 * (k1 + 2 * k2 + 2 * k3 + k4)
        # the share of the step until the first event
        f = np.minimum(np.where(new[1] >= v_rotate, (v_rotate - y[1]) / np.maximum(new[1] - y[1], 1e-12), 1.0), np.where(new[0] >= LONGEST_M, (LONGEST_M - y[0]) / np.maximum(new[0] - y[0], 1e-12), 1.0))
        y = np.where(rolling, y + np.clip(f, 0, 1) * (new - y), y)
        t = np.where(rolling, t + np.clip(f, 0, 1) * step, t)
        rolling &= (new[1] < v_rotate) & (new[0] < LONGEST_M)
    failed = (y[0] >= LONGEST_M - 1e-9) & (y[1] < v_rotate - 1e-9)
    v = np.maximum(v_rotate, 14.0)
    need = weight / np.maximum(0.5 * RHO * v**2 * area, 1e-4)
    untrimmed = (need < cl.min(1)) | (need > cl.max(1))
    left = np.maximum(FLIGHT_S - t, 0)
    cruise = powertrain(v, 0.6, np.clip(y[3], 0, 1))
    completed = ~failed & ~untrimmed
    energy = y[2] / 3600
    return {
        "completed": completed,
        "takeoff_m": y[0],
        "total_m": np.where(completed, y[0] + v * left, y[0]),
        "energy_wh": np.where(completed, energy + cruise["power"] * left / 3600, energy),
        "final_soc": np.where(completed, np.maximum(y[3] - cruise["current"] * left / (3600 * CAPACITY_AH), 0), y[3]),
        "max_current": np.where(completed, np.maximum(powertrain(np.zeros(n), 1.0, np.ones(n))["current"], cruise["current"]), powertrain(np.zeros(n), 1.0, np.ones(n))["current"]),
        "failure": np.where(failed, "takeoff_distance_exceeded", np.where(untrimmed, "cruise_cl_untrimmable", "")),
    }


RESULT = "ld double, alpha double, cm_alpha double, cm_trim double, completed boolean, takeoff_m double, total_m double, energy_wh double, final_soc double, max_current double, failure string"


def simulate(designs: DataFrame, id_col: str) -> DataFrame:
    """Trim and mission of every design (``mass, area, aspect, camber, cd0, oswald, cl``)."""
    ship(designs.sparkSession)
    names = [f.split()[0] for f in RESULT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            c = {k: batch.column(k).to_numpy(zero_copy_only=False) for k in ("mass", "area", "aspect", "camber", "cd0", "oswald", "cl")}
            cl, cd, cm = polar(c["aspect"], c["camber"], c["cd0"], c["oswald"])
            out = trim(c["cl"], cl, cd, cm) | mission(c["mass"], c["area"], cl, cd)
            yield pa.record_batch([batch.column(id_col), *(pa.array(out[k]) for k in names)], [id_col, *names])

    return designs.mapInArrow(run, f"{id_col} long, {RESULT}")
