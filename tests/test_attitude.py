"""The attitude filter in lanes against a plain walk, and figures worked out by hand."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright import params as P
from tracewright.operators import attitude as A
from tracewright.operators import generators as GN

G = P.STANDARD_GRAVITY_MPS2


def rotate(q, v):
    u, w = np.array(q[:3]), q[3]
    return v + 2 * w * np.cross(u, v) + 2 * np.cross(u, np.cross(u, v))


def times(a, b):
    return np.array([*(a[3] * b[:3] + b[3] * a[:3] + np.cross(a[:3], b[:3])), a[3] * b[3] - a[:3] @ b[:3]])


def about(axis, angle):
    return np.array([*(np.sin(angle / 2) * np.array(axis)), np.cos(angle / 2)])


def plain(t, gyro, accel, mag, up, weight):
    """One sample after the other."""
    def level(v):
        axis, c = np.cross(v, [0, 0, 1.0]), v[2]
        n = np.linalg.norm(axis)
        return (np.array([1.0, 0, 0]), math.pi if c < 0 else 0.0) if n < 1e-12 else (axis / n, math.atan2(n, c))
    q = np.array([0, 0, 0, 1.0]) if up is None else about(*level(up))
    out, kinds = [q], ["none"]
    for i in range(1, len(t)):
        dt, kind = t[i] - t[i - 1], "skipped"
        if 0 < dt <= 0.5 and np.isfinite(gyro[i - 1]).all():
            n = np.linalg.norm(gyro[i - 1])
            kind = "saturated" if n > 35 else "integrated"
            if n <= 35 and n > 0:
                q = times(q, about(gyro[i - 1] / n, n * dt))
        size = np.linalg.norm(accel[i])
        if dt > 0 and abs(size - G) <= 0.5:
            axis, angle = level(rotate(q, accel[i] / size))
            q = times(about(axis, angle * min(1, 0.5 * min(dt, 0.5))), q)
            if weight > 0 and np.isfinite(mag[i]).all():
                f = rotate(q, mag[i] / np.linalg.norm(mag[i]))
                if math.hypot(f[0], f[1]) >= 1e-3:
                    q = times(about([0, 0, 1.0], math.atan2(f[0], f[1]) * min(1, 0.05 * weight * min(dt, 0.5))), q)
        q = q / np.linalg.norm(q)
        out.append(q)
        kinds.append(kind)
    return np.array(out), kinds


def made(rng, n):
    t = np.cumsum(rng.choice([0.05, 0.1, 0.0, 0.7, 3.0], n, p=[0.5, 0.4, 0.04, 0.03, 0.03]))
    gyro = rng.normal(0, 0.4, (n, 3)) * np.where(rng.random(n) < 0.03, 200, 1)[:, None]
    accel = np.tile([1.0, 2.0, 9.5], (n, 1)) + rng.normal(0, 0.3, (n, 3))
    mag = np.tile([15.0, 30.0, -30.0], (n, 1)) + rng.normal(0, 1, (n, 3))
    gyro[rng.random(n) < 0.03], accel[rng.random(n) < 0.03], mag[rng.random(n) < 0.03] = np.nan, np.nan, np.nan
    return t, gyro, accel, mag


def test_lanes_equal_the_plain_walk():
    rng = np.random.default_rng(4)
    length = np.array([1, 2, 60, 200, 17])
    weight, has = np.array([0.0, 1.0, 0.7, 0.0, 0.3]), np.ones(5, bool)
    up = np.array([[0, 0, 1.0], [np.nan] * 3, [0.6, 0.0, 0.8], [0, 0.8, -0.6], [0, 0, -1.0]])
    t, v = np.full((5, 200), np.nan), np.full((3, 5, 200, 3), np.nan)
    for j, n in enumerate(length):
        t[j, :n], v[0, j, :n], v[1, j, :n], v[2, j, :n] = made(rng, n)
    q, _, north, used = A.walk(t, *v, length, up, weight, has)
    for j, n in enumerate(length):
        want, kinds = plain(t[j, :n], *v[:, j, :n], None if np.isnan(up[j]).any() else up[j], weight[j])
        assert np.abs(q[j, :n] - want).max() < 1e-12
        assert [["none", "integrated", "skipped", "saturated"][x] for x in used[j, :n]] == kinds
    assert north[2].any() and not north[3].any()


def test_heading_is_pulled_to_north():
    """A level device whose field points east of its y axis turns until the field is north; not while it accelerates."""
    n = 400
    t, gyro, accel, mag = np.arange(n)[None] * 0.1, np.zeros((1, n, 3)), np.tile([0.0, 0.0, G], (1, n, 1)), np.tile([20.0, 20.0, -30.0], (1, n, 1))
    go = lambda a: A.walk(t, gyro, a, mag, np.array([n]), np.array([[0, 0, 1.0]]), np.ones(1), np.ones(1, bool))
    q, _, north, _ = go(accel)
    first, last = (A.turn(x[None], mag[0, :1])[0] for x in (q[0, 0], q[0, -1]))
    assert north.sum() == n - 1 and abs(math.atan2(last[0], last[1])) < 0.2 * abs(math.atan2(first[0], first[1]))
    assert not go(accel * np.where(np.arange(n) > 0, 1.3, 1.0)[None, :, None])[2].any()


def test_correction_after_a_long_step_counts_half_a_second():
    """Felt up is 0.2 rad off; after 9 s without samples it is corrected by 0.5 Hz times 0.5 s, a quarter of it."""
    felt = np.array([[[0.0, 0.0, G], [G * math.sin(0.2), 0.0, G * math.cos(0.2)]]])
    none = np.full((1, 2, 3), np.nan)
    q, level, _, used = A.walk(np.array([[0.0, 9.0]]), np.zeros((1, 2, 3)), felt, none, np.array([2]), np.array([[0, 0, 1.0]]), np.zeros(1), np.ones(1, bool))
    assert used.tolist() == [[0, 2]] and level.tolist() == [[False, True]]
    assert 2 * math.acos(q[0, 1, 3]) == pytest.approx(0.05, abs=1e-9)


@pytest.mark.parametrize("lane_rows", [400_000, 50])
def test_recordings(spark, lane_rows):
    df = GN.drive(spark, "a", (0.25881904510252074, 0.0, 0.0, 0.9659258262890683), rest_s=10.0, drive_s=20.0, sigma=0.01).unionByName(GN.drive(spark, "b", rest_s=3.0, drive_s=2.0, sigma=0.01))
    df = df.unionByName(df.where("segment_id = 'b' AND i < 5").withColumn("segment_id", F.lit("c")))
    rows = A.orientation(df, "segment_id", ["i"], gyro="gyro", mag="mag", gravity="gravity", lane_rows=lane_rows).toPandas().sort_values(["segment_id", "i"])
    assert rows.groupby("segment_id").size().to_dict() == {"a": 601, "b": 101, "c": 5}
    for k in ("a", "b"):
        own = df.where(F.col("segment_id") == k).toPandas().sort_values("i")
        triple = lambda p, own=own: own[[f"{p}_{x}" for x in "xyz"]].to_numpy(float)
        got = rows[rows["segment_id"] == k]
        up = triple("gravity").mean(axis=0)
        want, kinds = plain(own["t_s"].to_numpy(), triple("gyro"), triple("accel"), triple("mag"), up / np.linalg.norm(up), _weight(spark, df, k))
        assert np.abs(got[["q_x", "q_y", "q_z", "q_w"]].to_numpy() - want).max() < 1e-9 and got["step"].tolist() == kinds
    felt = rows[rows["segment_id"] == "a"]["confidence"].iloc[0]
    assert 0.9 < felt <= 1.0  # a steady channel, a trusted field
    alone = A.orientation(df, "segment_id", ["i"], gravity="gravity").where("segment_id = 'a'").first()
    assert alone.confidence == pytest.approx(0.5, abs=1e-3) and alone.step == "none"  # no gyroscope: half of it
    s = {r.segment_id: r for r in A.supports(df, "segment_id", gyro="gyro", gravity="gravity").collect()}
    assert (s["a"].roll_support, s["a"].yaw_support) == ("observed", "dead_reckoned") and s["c"].roll_support == "unresolved"


def _weight(spark, df, k):
    from tracewright.operators import frames

    g = df.where(F.col("segment_id") == k).withColumns({"us": F.round(F.col("t_s") * 1e6).cast("long"), **{f"down_{a}": -F.col(f"gravity_{a}") / G for a in "xyz"}})
    return frames.magnetometer(g, "segment_id", ["us", "i"], "us", "mag", "down").first()["weight"]
