"""The attitude filter over recordings: gyroscope rates turn the attitude, what is felt near rest pulls it level, a trusted field pulls its heading.

Every correction depends on the attitude before it, so a recording is walked sample by sample; but recordings don't depend on each other, and a group walks many of them at once, as lanes of arrays, so a step costs a few array operations for
all of them. Spark deals whole recordings over the cluster and sorts them; a task walks about LANE_ROWS samples at a time, a longer recording in pieces that hand on the attitude.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import params as P
from ..functions import vectors as V
from . import evaluation, frames, lanes
from .propagation import multiply
from .store import Tables
from .timeline import _key

LANE_ROWS = 100_000
INTEGRATED, SKIPPED, SATURATED, NONE = 1, 2, 3, 0


def turn(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    t = 2.0 * np.cross(q[:, :3], v)
    return v + q[:, 3:] * t + np.cross(q[:, :3], t)


def spin(r: np.ndarray) -> np.ndarray:
    """Quaternions of rotation vectors."""
    n = np.linalg.norm(r, axis=1, keepdims=True)
    k = np.where(n < 1e-12, 0.5, np.sin(n / 2) / np.where(n < 1e-12, 1.0, n))
    return np.concatenate([k * r, np.cos(n / 2)], axis=1)


def shortest_to_up(v: np.ndarray) -> np.ndarray:
    """Quaternions of the shortest rotations of unit vectors onto up; half a turn about x where they point down."""
    q = np.column_stack([v[:, 1], -v[:, 0], np.zeros(len(v)), 1.0 + v[:, 2]])
    q = np.where(v[:, 2:] < -1 + 1e-12, [1.0, 0.0, 0.0, 0.0], q)
    return q / np.linalg.norm(q, axis=1, keepdims=True)


def walk(t: np.ndarray, gyro: np.ndarray, accel: np.ndarray, mag: np.ndarray, length: np.ndarray, up: np.ndarray, weight: np.ndarray, has_gyro: np.ndarray, gravity_gain: float = P.GRAVITY_GAIN_HZ, magnetic_gain: float = P.MAGNETIC_GAIN_HZ, start: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(attitudes, level corrections, heading corrections, how each step's rate was used) of lanes: arrays (lane, sample) of samples that are there up to each lane's length.

    up: the direction felt at rest, from which a lane starts level (not a number: from no turn), unless its first sample has an attitude (start); weight: the field's trust. A rate is used over the step after it, if the step is positive and no longer than MAX_INTEGRATION_STEP_S; the corrections are made
    after every positive step, as if it were no longer than that.
    """
    lanes, n = t.shape
    q = np.where(np.isfinite(up).all(axis=1)[:, None], shortest_to_up(np.nan_to_num(up)), [0.0, 0.0, 0.0, 1.0]) if start is None else start.copy()
    out, level, north, used = np.zeros((lanes, n, 4)), np.zeros((lanes, n), bool), np.zeros((lanes, n), bool), np.zeros((lanes, n), np.int8)
    size = np.linalg.norm(accel, axis=2)
    with np.errstate(invalid="ignore"):
        calm = np.abs(size - P.STANDARD_GRAVITY_MPS2) <= P.LOW_DYNAMIC_ACCEL_TOLERANCE_MPS2
        step = np.diff(t, axis=1, prepend=np.nan)
        fits, speed = (step > 0) & (step <= P.MAX_INTEGRATION_STEP_S), np.linalg.norm(gyro, axis=2)
        held = np.minimum(step, P.MAX_INTEGRATION_STEP_S)
    known = np.isfinite(gyro).all(axis=2)
    field = np.isfinite(mag).all(axis=2) & (np.linalg.norm(np.nan_to_num(mag), axis=2) >= P.MIN_VECTOR_NORM) & (weight > 0)[:, None]
    out[:, 0] = q
    for i in range(1, n):
        here = (i < length) & has_gyro
        kind = np.where(~fits[:, i] | ~known[:, i - 1], SKIPPED, np.where(speed[:, i - 1] > P.MAX_PLAUSIBLE_RATE_RPS, SATURATED, INTEGRATED))
        used[:, i] = np.where(here, kind, NONE)
        at = np.flatnonzero(used[:, i] == INTEGRATED)
        if len(at):
            q[at] = multiply(q[at], spin(gyro[at, i - 1] * step[at, i, None]))
        at = np.flatnonzero(calm[:, i] & (step[:, i] > 0) & (i < length))
        if len(at):
            pull = shortest_to_up(turn(q[at], accel[at, i] / size[at, i, None]))
            n_axis = np.linalg.norm(pull[:, :3], axis=1, keepdims=True)
            angle = 2 * np.arctan2(n_axis, pull[:, 3:]) * np.minimum(1.0, gravity_gain * held[at, i])[:, None]
            q[at] = multiply(spin(np.where(n_axis < P.MIN_VECTOR_NORM, 0.0, pull[:, :3] / np.where(n_axis < P.MIN_VECTOR_NORM, 1.0, n_axis)) * angle), q[at])
            level[at, i] = True
            at = at[field[at, i]]
        if len(at):
            f = turn(q[at], mag[at, i] / np.linalg.norm(mag[at, i], axis=1, keepdims=True))
            flat = np.hypot(f[:, 0], f[:, 1]) >= 1e-3
            off = np.where(flat, np.arctan2(f[:, 0], f[:, 1]), 0.0)  # of the horizontal field from north, about up; a turn by it brings the field to north
            about = np.zeros((len(at), 3))
            about[:, 2] = off * np.minimum(1.0, magnetic_gain * weight[at] * held[at, i])
            q[at] = multiply(spin(about), q[at])
            north[at, i] = flat
        q /= np.linalg.norm(q, axis=1, keepdims=True)
        out[:, i] = q
    return out, level, north, used


def orientation(df: DataFrame, key: str, order: list[str], accel: str = "accel", gyro: str | None = None, mag: str | None = None, gravity: str | None = None, lane_rows: int = LANE_ROWS) -> DataFrame:
    """Attitude (navigation from phone) of each sample: key, order, t_s, q_x .. q_w, confidence, level_corrected, heading_corrected and step (integrated, skipped, saturated, or none for the first sample and without a gyroscope).

    Samples are in the order of t_s and then of `order`. A recording starts level by its gravity estimate (its gravity channel first) and heads where it heads. The confidence is the recording's gravity confidence, halved without a gyroscope, and at most 0.5 where no trusted field fixes the heading.
    """
    k, tables = _key(key), Tables(df.sparkSession, "orientation")
    triples = [p for p in (accel, gyro, mag, gravity) if p]
    rows = df.select(*k, *order, F.col("t_s").cast("double").alias("t_s"), *[V.clean(F.col(f"{p}_{a}")).alias(f"{p}_{a}") for p in triples for a in "xyz"])
    facts = frames.gravity_estimate(rows, key, accel, gravity, gyro)
    has = F.count_if(V.all_finite(*V.vector(gyro))) > 0 if gyro else F.lit(False)
    facts = facts.join(rows.groupBy(*k).agg(F.coalesce(F.max(has) if not gyro else has, F.lit(False)).alias("has_gyro")), k)
    if mag:
        down = facts.where("up_x IS NOT NULL").select(*k, *[(-F.col(f"up_{a}")).alias(f"down_{a}") for a in "xyz"])
        timed = rows.join(down, k, "left").withColumn("__us", F.round(F.col("t_s") * 1e6).cast("long"))
        facts = facts.join(frames.magnetometer(timed, key, ["__us", *order], "__us", mag, "down").select(*k, F.col("weight").alias("mag_weight")), k, "left")
    else:
        facts = facts.withColumn("mag_weight", F.lit(None).cast("double"))
    confidence = evaluation.attitude_confidence(F.col("gravity_confidence"), F.col("mag_weight"), F.col("has_gyro"))
    facts, _ = tables.keep(facts.select(*k, "has_gyro", *[f"up_{a}" for a in "xyz"], F.coalesce("mag_weight", F.lit(0.0)).alias("mag_weight"), confidence.alias("confidence")))
    kinds = ", ".join(f"`{c}` {dict(df.dtypes)[c]}" for c in (*k, *order))
    schema = f"{kinds}, t_s double, " + ", ".join(f"q_{a} double" for a in "xyzw") + ", confidence double, level_corrected boolean, heading_corrected boolean, step string"
    names = np.array(["none", "integrated", "skipped", "saturated"], object)

    qs, xyz = [f"q_{a}" for a in "xyzw"], lambda p: [f"{p}_{a}" for a in "xyz"]

    def run(pdf: pd.DataFrame, before: np.ndarray | None) -> tuple[pd.DataFrame, np.ndarray]:
        t, values = pdf["t_s"].to_numpy(float), {p: pdf[xyz(p)].to_numpy(float) for p in triples if p != gravity}
        q, level, north, used = np.zeros((len(pdf), 4)), np.zeros(len(pdf), bool), np.zeros(len(pdf), bool), np.zeros(len(pdf), np.int8)
        for some in lanes.batches(pdf, k):
            at = some.place(t)
            sensed = [some.place(values[p]) if p else np.broadcast_to(np.nan, (*at.shape, 3)) for p in (gyro, accel, mag)]
            head = pdf.iloc[some.first]
            found = walk(at, *sensed, some.length, head[xyz("up")].to_numpy(float), head["mag_weight"].to_numpy(float), head["has_gyro"].to_numpy(bool), start=before)
            q[some.rows], level[some.rows], north[some.rows], used[some.rows] = (some.taken(x) for x in found)
        out = pd.concat([pdf[[*k, *order, "t_s"]], pd.DataFrame(q, columns=qs), pdf[["confidence"]]], axis=1)
        return out.assign(level_corrected=level, heading_corrected=north, step=names[used])[0 if before is None else 1 :], q[-1:]

    facing = rows.drop(*(xyz(gravity) if gravity else [])) if gravity not in (accel, gyro, mag) else rows
    return lanes.over(facing.join(facts, k), k, ["t_s", *order], run, schema, lane_rows)


def supports(df: DataFrame, key: str, accel: str = "accel", gyro: str | None = None, mag: str | None = None, gravity: str | None = None) -> DataFrame:
    """A row per key: how its roll and pitch (observed, unresolved) and its yaw (observed, dead_reckoned, unresolved) are known."""
    k = _key(key)
    g = frames.gravity_estimate(df, key, accel, gravity, gyro).select(*k, "gravity_method", *[f"up_{a}" for a in "xyz"])
    has = df.groupBy(*k).agg((F.count_if(V.all_finite(*V.vector(gyro))) > 0 if gyro else F.max(F.lit(False))).alias("has"))
    out = g.join(has, k)
    if mag:
        down = g.where("up_x IS NOT NULL").select(*k, *[(-F.col(f"up_{a}")).alias(f"down_{a}") for a in "xyz"])
        timed = df.join(down, k, "left").withColumn("__us", F.round(F.col("t_s") * 1e6).cast("long"))
        out = out.join(frames.magnetometer(timed, key, ["__us"], "__us", mag, "down").select(*k, F.col("weight").alias("w")), k, "left")
    else:
        out = out.withColumn("w", F.lit(0.0))
    level = F.when(F.col("gravity_method") == "unavailable", "unresolved").otherwise("observed")
    yaw = F.when(F.coalesce("w", F.lit(0.0)) > 0, "observed").when(F.col("has"), "dead_reckoned").otherwise("unresolved")
    return out.select(*k, level.alias("roll_support"), level.alias("pitch_support"), yaw.alias("yaw_support"))
