"""Strapdown propagation as a walk over the samples of a segment, with all its policies; propagation has the parallel form.

A trajectory that ends at a bad step, or has attitudes supplied, is decided sample by sample. Segments don't depend on each other, so a task walks many of them side by side as lanes of arrays; segments, not rows, spread over the cluster, and a long one is walked in pieces that hand on the state.
Input columns: key, t_s (seconds), and triples such as gyro_x, gyro_y, gyro_z; missing values are NaN.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import params as P
from . import lanes
from .attitude import spin, turn
from .propagation import multiply

LANE_ROWS = 100_000  # samples that a task walks at a time
CASE_ROWS = 25_000  # the same where each sample is walked for all cases of a list

# Quaternions (x, y, z, w) in numpy, for the loops below; functions.quaternions has them as columns.


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    v = a[3] * b[:3] + b[3] * a[:3] + np.cross(a[:3], b[:3])
    return np.array([*v, a[3] * b[3] - a[:3] @ b[:3]])


def turned(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    t = 2.0 * np.cross(q[:3], v)
    return v + q[3] * t + np.cross(q[:3], t)


def from_rotvec(r: np.ndarray) -> np.ndarray:
    n = float(np.linalg.norm(r))
    k = 0.5 if n < 1e-12 else np.sin(n / 2) / n
    return np.array([*(k * r), np.cos(n / 2)])


def _triple(pdf: pd.DataFrame, name: str) -> np.ndarray:
    cols = [f"{name}_{a}" for a in "xyz"]
    return pdf[cols].to_numpy(float) if all(c in pdf for c in cols) else np.full((len(pdf), 3), np.nan)


# Strapdown propagation


@dataclass
class State:
    """What a step needs of the one before; the same for batches and streams."""

    t: float
    q: np.ndarray
    v: np.ndarray
    p: np.ndarray
    a: np.ndarray | None = None  # acceleration at the last good sample, none after a skip

    @classmethod
    def of(cls, t: np.ndarray, q: np.ndarray, v: np.ndarray) -> State:
        """Of many lanes at their first samples, as arrays that a walk moves on; no acceleration is not a number there."""
        return cls(t.copy(), q.copy(), v.copy(), np.zeros(v.shape), np.full(v.shape, np.nan))


def advance(s: State, t: float, force: np.ndarray, rate: np.ndarray, supplied: np.ndarray | None = None, max_step: float = P.MAX_INTEGRATION_STEP_S, gyro_bias: np.ndarray | None = None, accel_bias: np.ndarray | None = None, gravity: float = P.STANDARD_GRAVITY_MPS2) -> tuple[State, int]:
    """The next state and its flags. A step that isn't positive or is too long holds velocity and position, and the time moves to the sample's; so does a sample that no sensor could give. A time that isn't finite changes nothing and is an invalid sample.
    With a supplied attitude a rate is checked where there is one."""
    dt = t - s.t
    if not np.isfinite(dt):
        return State(s.t, s.q if supplied is None else supplied, s.v, s.p), 32
    if dt <= 0:
        return State(t, s.q if supplied is None else supplied, s.v, s.p), 8
    if dt > max_step:
        return State(t, s.q if supplied is None else supplied, s.v, s.p), 16
    f = force - (accel_bias if accel_bias is not None else 0.0)
    w = rate - (gyro_bias if gyro_bias is not None else 0.0)
    ok_f = np.isfinite(f).all() and np.linalg.norm(f) <= P.MAX_PLAUSIBLE_SPECIFIC_FORCE_MPS2
    ok_w = np.isfinite(w).all() and np.linalg.norm(w) <= P.MAX_PLAUSIBLE_RATE_RPS
    if not ok_f or not (ok_w or (supplied is not None and np.isnan(rate).all())):
        return State(t, s.q, s.v, s.p), 32
    q = supplied if supplied is not None else product(s.q, from_rotvec(w * dt))
    q = q / np.linalg.norm(q)
    a = turned(q, f) + np.array([0.0, 0.0, -gravity])
    before = a if s.a is None else s.a
    v = s.v + 0.5 * (before + a) * dt
    return State(t, q, v, s.p + 0.5 * (s.v + v) * dt, a), 0


def mechanize(df: DataFrame, key: str = "segment_id", on_gap: str = "skip", supplied: bool = False, max_step: float = P.MAX_INTEGRATION_STEP_S, order: str = "t_s") -> DataFrame:
    """Velocity, position and attitude of each sample from the segment's first: key, t_s, v, p, q and flags.

    Samples are taken in the order of a column, by default of time; give the column of the written order where steps back in time are to be seen.

    The first row gives the state (q_* if present, v0_* if present, else level and at rest). on_gap: skip holds over bad steps, segment ends the trajectory there, fail raises.
    supplied: attitudes come from q_* columns and aren't propagated.
    """
    kind = dict(df.dtypes)[key]
    if on_gap not in ("skip", "segment", "fail"):
        raise ValueError(f"on_gap is skip, segment or fail, not {on_gap}")

    cols = ["v_x", "v_y", "v_z", "p_x", "p_y", "p_z", "q_x", "q_y", "q_z", "q_w"]

    def run(pdf: pd.DataFrame, before: tuple[State, bool] | None) -> tuple[pd.DataFrame, tuple[State, bool]]:
        t, force, rate = pdf["t_s"].to_numpy(float), _triple(pdf, "force"), _triple(pdf, "gyro")
        have_q = all(f"q_{a}" in pdf for a in "xyzw")
        qs = pdf[[f"q_{a}" for a in "xyzw"]].to_numpy(float) if have_q else np.tile([0.0, 0.0, 0.0, 1.0], (len(pdf), 1))
        v0 = np.nan_to_num(_triple(pdf, "v0"))
        values, flags, goes = np.zeros((len(pdf), len(cols))), np.zeros(len(pdf), np.int32), np.ones(len(pdf), bool)
        for some in lanes.batches(pdf, [key]):
            given = some.place(qs) if supplied and have_q else None
            s, ended = before or (State.of(t[some.first], qs[some.first], v0[some.first]), False)
            held, flag = walk(some.place(t), some.place(force), some.place(rate), some.length, s.q, s.v, given, max_step, s)
            stop = np.isin(flag, (8, 16))
            if on_gap == "fail" and stop.any():
                lane, i = np.argwhere(stop)[0]
                at = some.first[lane]
                raise ValueError(f"segment {pdf[key].iloc[at]}: the step to {t[at + i]} can't be integrated")
            values[some.rows], flags[some.rows] = some.taken(held), some.taken(flag)
            if on_gap == "segment":
                gone = np.logical_or.accumulate(stop, axis=1) | ended
                goes[some.rows], ended = some.taken(~gone), gone[-1, -1]
        res = pd.concat([pdf[[key, "t_s"]].astype({"t_s": float}), pd.DataFrame(values, columns=cols)], axis=1)
        goes[: 0 if before is None else 1] = False
        return res.assign(flags=flags)[goes], (s, ended)

    schema = f"`{key}` {kind}, t_s double, " + ", ".join(f"{c} double" for c in cols) + ", flags int"
    return lanes.over(df, [key], [order], run, schema, LANE_ROWS)


def walk(t: np.ndarray, force: np.ndarray, rate: np.ndarray, length: np.ndarray, q0: np.ndarray, v0: np.ndarray, supplied: np.ndarray | None = None, max_step: float = P.MAX_INTEGRATION_STEP_S, s: State | None = None) -> tuple[np.ndarray, np.ndarray]:
    """advance() from each lane's first sample to its last: (v, p and q; flags), arrays (lane, sample). s: the lanes' states at their first samples, moved to the last."""
    count, n = t.shape
    s = s or State.of(t[:, 0], q0, v0)
    q, v, p, a, now = s.q, s.v, s.p, s.a, s.t
    out, flags = np.zeros((count, n, 10)), np.zeros((count, n), np.int32)
    out[:, 0] = np.concatenate([v, p, q], axis=1)
    size = lambda x: np.linalg.norm(x, axis=2)
    with np.errstate(invalid="ignore"):
        felt = np.isfinite(force).all(axis=2) & (size(force) <= P.MAX_PLAUSIBLE_SPECIFIC_FORCE_MPS2)
        slow = np.isfinite(rate).all(axis=2) & (size(rate) <= P.MAX_PLAUSIBLE_RATE_RPS)
    sensed = felt & (slow if supplied is None else slow | np.isnan(rate).all(axis=2))
    for i in range(1, n):
        with np.errstate(invalid="ignore"):
            dt = t[:, i] - now
            kind = np.select([~np.isfinite(dt), dt <= 0, dt > max_step, ~sensed[:, i]], [32, 8, 16, 32], 0)
        np.copyto(now, t[:, i], where=np.isfinite(dt))
        flags[:, i] = np.where(i < length, kind, 0)
        if supplied is not None:
            held = ~np.isfinite(dt) | (kind == 8) | (kind == 16)
            q[held] = supplied[held, i]
        a[kind != 0] = np.nan
        at = np.flatnonzero(kind == 0)
        if len(at):
            step = dt[at, None]
            turned_to = supplied[at, i] if supplied is not None else multiply(q[at], spin(rate[at, i] * step))
            q[at] = turned_to / np.linalg.norm(turned_to, axis=1, keepdims=True)
            new = turn(q[at], force[at, i]) - [0.0, 0.0, P.STANDARD_GRAVITY_MPS2]
            moved = v[at] + 0.5 * (np.where(np.isnan(a[at]), new, a[at]) + new) * step
            p[at], v[at], a[at] = p[at] + 0.5 * (v[at] + moved) * step, moved, new
        out[:, i] = np.concatenate([v, p, q], axis=1)
    return out, flags


# Bias sensitivity


def bias_sensitivity(df: DataFrame, key: str = "segment_id", gyro=P.GYRO_PERTURBATIONS_RPS, accel=P.ACCEL_PERTURBATIONS_MPS2, max_step: float = P.MAX_INTEGRATION_STEP_S) -> DataFrame:
    """How far the end of each trajectory moves if a bias is put on one axis of one sensor: a row per segment and case of a fixed list.

    A segment is shipped once and walked once, for all cases and beside other segments as lanes of arrays, the first case being the one without a bias.
    """
    kind = dict(df.dtypes)[key]
    grid = [("gyro", i, float(m)) for m in gyro for i in range(3)] + [("accel", i, float(m)) for m in accel for i in range(3)]
    off = {s: np.array([[0.0] * 3] + [[m if s == sensor and i == axis else 0.0 for i in range(3)] for sensor, axis, m in grid]) for s in ("gyro", "accel")}
    cases = len(grid) + 1

    def ends(t: np.ndarray, force: np.ndarray, rate: np.ndarray, s: State) -> np.ndarray:
        """Positions (lane, case) at the lanes' ends, to which the states of all lanes and cases are moved; a lane's cases have one time."""
        count, n = t.shape
        q, v, p, before, now = s.q, s.v, s.p, s.a, s.t
        for i in range(1, n):
            with np.errstate(invalid="ignore"):
                dt = t[:, i] - now
                fits = (dt > 0) & (dt <= max_step)
            np.copyto(now, t[:, i], where=np.isfinite(dt))
            f, w = (force[:, i, None] - off["accel"]).reshape(-1, 3), (rate[:, i, None] - off["gyro"]).reshape(-1, 3)
            with np.errstate(invalid="ignore"):
                good = np.repeat(fits, cases) & (np.linalg.norm(f, axis=1) <= P.MAX_PLAUSIBLE_SPECIFIC_FORCE_MPS2) & (np.linalg.norm(w, axis=1) <= P.MAX_PLAUSIBLE_RATE_RPS)
            before[~good] = np.nan
            at = np.flatnonzero(good)
            if not len(at):
                continue
            step, f, last = np.repeat(dt, cases)[at, None], f[at], before[at]
            new = multiply(q[at], spin(w[at] * step))
            q[at] = new = new / np.linalg.norm(new, axis=1, keepdims=True)
            before[at] = a = turn(new, f) - [0.0, 0.0, P.STANDARD_GRAVITY_MPS2]
            dv = 0.5 * (np.where(np.isnan(last), a, last) + a) * step
            p[at] += (v[at] + 0.5 * dv) * step
            v[at] += dv
        return p.reshape(count, cases, 3)

    def run(pdf: pd.DataFrame, before: State | None) -> tuple[pd.DataFrame, State]:
        t, force, rate = pdf["t_s"].to_numpy(float), _triple(pdf, "force"), _triple(pdf, "gyro")
        first, moved = [], []
        for some in lanes.batches(pdf, [key], 2 * CASE_ROWS):
            count = len(some.first) * cases
            s = before or State.of(t[some.first], np.tile([0.0, 0.0, 0.0, 1.0], (count, 1)), np.zeros((count, 3)))
            p = ends(some.place(t), some.place(force), some.place(rate), s)
            first.append(some.first)
            moved.append(np.linalg.norm(p[:, 1:] - p[:, :1], axis=2))
        who = np.repeat(np.concatenate(first), len(grid))
        each = {"sensor": [g[0] for g in grid], "axis": [g[1] for g in grid], "magnitude": [g[2] for g in grid]}
        out = pd.DataFrame({c: np.tile(np.array(v), len(who) // len(grid)) for c, v in each.items()})
        out.insert(0, key, pdf[key].iloc[who].array)
        return out.assign(divergence_m=np.concatenate(moved).ravel()), s

    return lanes.over(df, [key], ["t_s"], run, f"`{key}` {kind}, sensor string, axis int, magnitude double, divergence_m double", CASE_ROWS, at_end=True)
