"""Mounting alignment over blocks of recordings against the same estimate in memory, and against known mountings."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright import params as P
from tracewright.operators import alignment as A
from tracewright.operators import asof, frames, lags
from tracewright.operators import generators as GN

TILT = (0.25881904510252074, 0.0, 0.0, 0.9659258262890683)  # 30 degrees about x


def recordings(spark):
    """Drives with all their channels: k, i, t and columns of accel, gravity, gyro, mag and speed."""
    late = GN.drive(spark, "late", TILT, sigma=0.02, seed=3)
    late = late.withColumn("speed", F.when(F.col("t_s") - 1.6 > 20, 7.5 * (1 - F.cos((F.col("t_s") - 21.6) * (2 * math.pi / 20)))).otherwise(0.0))
    still = GN.drive(spark, "still", rest_s=30.0, drive_s=0.0)
    noise = GN.drive(spark, "noise", sigma=0.02, seed=9).withColumn("accel_x", F.sin(F.col("t_s") * (2 * math.pi / 5))).withColumn("accel_y", F.cos(F.col("t_s") * (2 * math.pi / 5)))
    parts = [GN.drive(spark, "plain", sigma=0.02), GN.drive(spark, "turned", (0.0, 0.0, math.sin(0.6), math.cos(0.6)), sigma=0.02, jitter_s=0.01), late, still, noise, GN.drive(spark, "short", drive_s=2.0)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    holes = [F.when((F.col("i") % 97 == 5), float("nan")).otherwise(F.col(c)).alias(c) if c in ("accel_y", "speed") else F.col(c) for c in out.columns if c not in ("segment_id", "t_s")]
    return out.select(F.col("segment_id").alias("k"), F.round(F.col("t_s") * 1e6).cast("long").alias("t"), *holes)


@pytest.fixture(scope="module")
def drives(spark):
    df = recordings(spark)
    return df, df.toPandas().sort_values(["k", "t"])


@pytest.mark.parametrize(("channels", "block_s"), [({}, 300.0), ({"gravity": "gravity", "gyro": "gyro", "mag": "mag"}, 7.0)])
def test_blocks_equal_the_buffer(spark, drives, channels, block_s):
    df, pdf = drives
    got = {r.k: r for r in A.alignment(df, "k", "t", ["i"], block_s=block_s, **channels).collect()}
    assert set(got) == {"plain", "turned", "late", "still", "noise", "short"}
    for k, own in pdf.groupby("k"):
        triple = lambda p, own=own: own[[f"{p}_{a}" for a in "xyz"]].to_numpy(float)
        more = {c: triple(c) for c in channels}
        want = A.estimate(own["t"].to_numpy() / 1e6, triple("accel"), own["speed"].to_numpy(float), assess_field=bool(channels), **more)
        r = got[k]
        assert (r.status, r.gravity_method, r.dynamic_n) == (want["status"], want["gravity_method"], want["dynamic_n"]), k
        for c in ("confidence", "lag_s", "correlation", "margin", "disagreement_rad", "gravity_confidence"):
            assert (math.nan if r[c] is None else r[c]) == pytest.approx(want[c], abs=1e-7, nan_ok=True), (k, c)
        assert (r.rotation is None) == (want["rotation"] is None)
        if r.rotation is not None:
            assert r.rotation == pytest.approx(want["rotation"].ravel(), abs=1e-9)
    assert (got["late"].lag_s - 1.6 + 0.21) % 10 <= 0.42  # the drive repeats its sign every 10 s
    assert got["turned"].status == got["plain"].status == "SUCCESS"
    assert got["still"].status == "INSUFFICIENT_MOTION" and got["still"].roll_deg is not None and got["still"].yaw_deg is None
    assert got["turned"].yaw_deg == pytest.approx(math.degrees(1.2), abs=1.0)
    assert got["plain"].longitudinal_correlation > 0.9 and (got["plain"].reversed_fraction or 0) < 0.05
    assert got["plain"].gravity_method == ("gravity_channel" if channels else "accel_low_dynamic")


def test_a_field_that_cannot_stand_in(spark):
    rows = recordings(spark).where("k = 'noise'").withColumn("mag_x", F.col("mag_x") + 300.0)
    of = lambda **more: A.alignment(rows, "k", "t", ["i"], gravity="gravity", max_lag_s=0.0, **more).first()
    assert of().status == "LOW_HEADING_CONFIDENCE"
    r = of(mag="mag")
    assert r.status == "MAG_DISTURBED" and r.mag_weight == 0.0 and r.rotation is None and r.confidence == 0.0


def test_gravity_falls_back(spark):
    up = [("a", 0.0, 0.0, 9.80665, 0.0, 9.8, 0.0, 0.01)] * 30
    rows = [("channel", *r[1:]) for r in up] + [("few", *r[1:5], *((9.8, 0.0) if i < 19 else (float("nan"), 0.0)), 0.01) for i, r in enumerate(up)] + [("turning", *r[1:7], 0.5) for r in up[:10]] + [("turning", *r[1:5], 0.0, 0.0, 0.01) for r in up[:25]] + [("none", 0.0, 0.0, 20.0, 0.0, 0.0, 0.0, 0.0)] * 40
    df = spark.createDataFrame(rows, "k string, a_x double, a_y double, a_z double, c_x double, c_y double, c_z double, w_x double").withColumns({"w_y": F.lit(0.0), "w_z": F.lit(0.0)})
    got = {r.k: r for r in frames.gravity_estimate(df, "k", "a", "c", "w").collect()}
    assert got["channel"].gravity_method == "gravity_channel" and got["channel"].up_y == pytest.approx(1) and got["channel"].gravity_n == 30
    assert got["few"].gravity_method == "accel_low_dynamic" and got["few"].up_z == pytest.approx(1)
    assert got["turning"].gravity_n == 25 and got["turning"].candidates == 35  # rows of fast rotation don't count
    assert got["none"].gravity_method == "unavailable" and got["none"].up_x is None and got["none"].gravity_confidence == 0.0
    # no spread, 0.00665 off: times half and 30 of 200
    assert got["few"].gravity_confidence == pytest.approx((1 - 0.0 / 0.35) * 1.0 * (0.5 + 0.5 * 0.15), abs=1e-6)


def in_memory(t, v, rt, rv, max_lag=15.0):
    """Correlation of the smoothed rates at each lag, over whole arrays."""
    def smooth(x, t):
        out, ok = np.full(len(t), np.nan), np.isfinite(x)
        if ok.sum() >= 2:
            out[ok] = np.gradient(x[ok], t[ok])
        return A.trailing_mean(out, t, P.SMOOTHING_WINDOW_S)
    own = smooth(v, t)
    return {j: A.pearson(own, smooth(np.interp(t + j * 0.2, rt, rv, left=np.nan, right=np.nan), t)) for j in range(-int(max_lag / 0.2), int(max_lag / 0.2) + 1)}


@pytest.mark.parametrize("block_s", [300.0, 4.0])
def test_residual_lags_of_blocks(spark, block_s):
    rng = np.random.default_rng(2)
    t = np.cumsum(rng.choice([50_000, 100_000, 230_000, 900_000], 700))
    v = np.cumsum(rng.normal(0, 1, 700)) * 0.3 + 12
    rt = np.arange(0, t[-1] - 20_000_000, 310_000)
    rv = np.interp(rt, t + 2_400_000, v) + rng.normal(0, 0.02, len(rt))
    track = spark.createDataFrame([("a", int(x), float(y)) for x, y in zip(t, v, strict=True)], "k string, t long, speed double")
    ref = spark.createDataFrame([("a", int(x), float(y)) for x, y in zip(rt, rv, strict=True)], "k string, t long, speed double")
    want = in_memory(t / 1e6, v, rt / 1e6, rv)
    best = max(want, key=lambda j: want[j])
    r = lags.residual_lag(track, ref, "k", "t", block_s=block_s).first()
    assert r.accepted and r.lag_s == pytest.approx(best * 0.2) == pytest.approx(2.4) and r.correlation == pytest.approx(want[best], abs=1e-9)
    assert r.zero_correlation == pytest.approx(want[0], abs=1e-9) and r.margin == pytest.approx(want[best] - np.nanmedian(list(want.values())), abs=1e-9)


def test_rounding_is_no_variation(spark):
    """A speed that rises evenly, felt evenly: what rounding leaves of its rate correlates with nothing."""
    rows = spark.range(1200).selectExpr("'a' AS k", "cast(id AS int) AS i", "id * 100000 AS t", "0.7 * id / 10 + 5 AS speed", "0.7D AS accel_x", "0D AS accel_y", "9.80665D AS accel_z", "0D AS gravity_x", "0D AS gravity_y", "9.80665D AS gravity_z")
    r = A.alignment(rows, "k", "t", ["i"], gravity="gravity", block_s=30.0).first()
    assert r.correlation is None and r.margin is None and r.rotation is None and r.status == "LOW_HEADING_CONFIDENCE" and r.lag_s == 0


def test_correlation_without_variation(spark):
    rows = spark.createDataFrame([("even", float(i), 2.0) for i in range(9)] + [("odd", float(i), -3.0 * i) for i in range(9)] + [("one", 1.0, 1.0)], "k string, x double, y double")
    got = {r.k: r.c for r in rows.groupBy("k").agg(asof.guarded_corr(F.col("x"), F.col("y")).alias("c")).collect()}
    assert got == {"even": None, "odd": pytest.approx(-1.0, abs=1e-12), "one": None}
