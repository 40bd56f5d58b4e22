"""Values worked out by hand from the definitions of the data model, and never by another program."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright import params as P
from tracewright.operators import alignment, asof, evaluation, frames, ordered, quality, scans, timeline
from tracewright.operators import generators as GN


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_forward_confidence(spark):
    f = lambda *a: value(spark, frames.forward_confidence(*[F.lit(x).cast("double") for x in a]))
    # strength (0.65 - 0.3) / 0.7 = 0.5; support 100 / 250 = 0.4, so 0.64; agreement 1 - 0.13 / 0.26 = 0.5, so 0.65
    assert P.MIN_FORWARD_SAMPLES == 50 and f(0.65, 100, 0.13) == pytest.approx(0.5 * 0.64 * 0.65)
    assert f(0.65, 1000, None) == pytest.approx(0.5 * 1.0 * (0.3 + 0.7 * 0.5))
    assert f(-0.9, 1000, 0.0) == 0 and f(None, 1000, 0.0) == 0 and f(1.0, 1000, 9.0) == pytest.approx(0.3)


def test_gravity_confidence(spark):
    rows = spark.createDataFrame([("s", 0.0, 0.0, 10.787315)] * 40, "k string, a_x double, a_y double, a_z double")
    r = frames.gravity_direction(rows, "k", "a").first()
    # 0.1 g off: half of 0.2 g; no spread; 40 of 200 samples
    assert r.magnitude_error == pytest.approx(0.980665) and r.spread_rad == pytest.approx(0, abs=1e-7) and r.down_z == pytest.approx(-1)
    assert r.confidence == pytest.approx(0.5 * (0.5 + 0.5 * 0.2), abs=1e-6)


def test_field_weight(spark):
    def of(norms, step_s=1.0):
        rows = [("s", i, int(i * step_s * 1e6), n, 0.0, 0.0) for i, n in enumerate(norms)]
        return frames.magnetometer(spark.createDataFrame(rows, "k string, i int, t long, m_x double, m_y double, m_z double"), "k", ["i"], "t", "m").first()

    assert of([50.0] * 10).weight == 1.0
    r = of([80.0] * 10)  # out of range is one sign; the median is within half to twice the Earth's
    assert (r.issues, r.weight) == (1, 0.3)
    assert of([131.0] * 10).weight == 0 and of([12.0] * 10).weight == 0 and of([50.0]).weight == 0
    rows = [("s", i, i * 100_000, 50.0 * math.cos(a), 50.0 * math.sin(a), 0.0) for i, a in enumerate([0.0] * 50 + [0.5] + [0.5] * 50)]
    r = frames.magnetometer(spark.createDataFrame(rows, "k string, i int, t long, m_x double, m_y double, m_z double"), "k", ["i"], "t", "m").first()
    assert r.rate_max == pytest.approx(5.0) and (r.issues, r.weight) == (2, 0.3)  # one jump is enough


def test_quality_scores(spark):
    s = quality.sub_scores(F.lit(3), F.lit(12), F.lit(12.5), F.lit("irregular"), F.lit(0.33335))
    got = spark.range(1).select(*[c.alias(f"c{k}") for k, c in enumerate(s)], quality.quality_score(*s).alias("q")).first()
    assert list(got)[:4] == pytest.approx([0.75, 0.875, 0.4, 0.3334], abs=1.1e-4) and got.q == pytest.approx((0.75 + 0.875 + 0.4 + 0.3333) / 4, abs=1e-4)
    empty = quality.sub_scores(F.lit(0), F.lit(0), F.lit(None).cast("double"), F.lit("unknown"), F.lit(None).cast("double"))
    assert list(spark.range(1).select(*[c.alias(f"c{k}") for k, c in enumerate(empty)]).first()) == [0, 0, 0, 0]
    assert value(spark, timeline.sampling_class(F.lit(1.01))) == "severely_irregular"


def test_constant_columns_need_a_band(spark):
    p = quality.profile(spark.createDataFrame([("7", 1.0, 2.5)] * 3, "engine_speed string, other double, gyro_yaw double"), ["engine_speed", "other", "gyro_yaw"])
    got = {(r.column, r.interpretation) for r in quality.range_findings(p, "column").collect()}
    assert got == {("engine_speed", "possible_sensor_artifact"), ("gyro_yaw", "possible_sensor_artifact")}


def test_updates_and_holds(spark):
    """Times 0 1 2 5 5 9 20, values a a b c c d d, and no fix at the first row."""
    rows = [("s", i, t * 1_000_000, v, i > 0) for i, (t, v) in enumerate(zip([0, 1, 2, 5, 5, 9, 20], "aabccdd", strict=True))]
    df = spark.createDataFrame(rows, "k string, i int, t long, v string, fix boolean")
    r = ordered.update_intervals(df, "k", ["i"], "t", ["v"], F.col("fix")).first()
    # updates at 1 (the first fix), 2, 5, 9: intervals 1, 3, 4
    assert (r.n_rows, r.updates, r.median_s, r.max_s) == (7, 4, 3.0, 4.0) and r.availability == pytest.approx(6 / 7)
    assert r.p90_s == pytest.approx(3.8) and r.rate_hz == pytest.approx(3 / 8)
    held = ordered.holds(df, "k", ["i"], "t", ["v"], 3.0).orderBy("start_us").collect()
    assert [(h.start_us // 1_000_000, h.duration_s) for h in held] == [(2, 3.0), (5, 4.0)]  # the last value's 11 seconds end in no update


def test_clock_overlap(spark):
    stream = lambda times: spark.createDataFrame([("p", i, int(t * 1e6)) for i, t in enumerate(times)], "k string, i int, t long")
    r = asof.overlap(stream([7200.0, 7210.0, 7300.0]), stream([1.0, 50.0, 101.0]), "k", "t").first()
    assert (r.offset_start_s, r.offset_end_s, r.whole_hours) == (7199.0, 7199.0, 2) and r.interpretation == "constant_offset_whole_hour_likely_timezone" and r.residual_s == -1
    r = asof.overlap(stream([7200.0, 7300.0]), stream([0.0, 99.0]), "k", "t").first()
    assert r.drift_s == pytest.approx(1.0) and r.drift_ppm == pytest.approx(1e6 / 99) and r.interpretation == "variable_offset_possible_drift"
    r = asof.overlap(stream([5.0, 3.0, 9.0]), stream([1.0, 2.0, 5.0]), "k", "t", ["i"]).first()
    assert (r.offset_start_s, r.offset_end_s, r.interpretation) == (4.0, 4.0, "constant_offset")  # the first row's time, not the least


def test_synchronize(spark):
    rows = [("signal", 40.0, 0.9, 0.3, 100.0, 1100.0, 50.0, 1060.0), ("weak", 40.0, 0.2, 0.3, 100.0, 1100.0, 50.0, 1060.0), ("short", 40.0, 0.9, 0.3, 100.0, 150.0, 50.0, 100.0), ("none", None, None, None, None, None, 50.0, 100.0)]
    df = spark.createDataFrame(rows, "k string, off double, r double, m double, a0 double, a1 double, b0 double, b1 double")
    got = {r.k: r for r in asof.synchronize(df, "off", "r", "m", ("a0", "a1", "b0", "b1")).collect()}
    r = got["signal"]
    # clocks: (50 + 40) / 2 = 45, drift 40 - 50; shifted by 40 the phone runs from 60 to 1060
    assert (r.clock_offset_s, r.drift_estimate_s, r.drift_detected, r.estimated_offset_s, r.overlap_start_s, r.overlap_end_s) == (45, -10, True, 40, 60, 1060)
    assert (r.offset_method, r.offset_confidence, r.status) == ("speed_cross_correlation", "high", "CONFIRMED_BY_SIGNAL")
    r = got["weak"]
    assert (r.estimated_offset_s, r.overlap_s, r.offset_method, r.offset_confidence, r.status) == (45, 1000, "clock_difference", "low", "CLOCK_ONLY")
    assert (got["short"].status, got["short"].offset_confidence, got["none"].status, got["none"].offset_method) == ("UNRESOLVED", "none", "UNRESOLVED", "none")


def test_step_flags():
    level, g = np.array([0.0, 0.0, 0.0, 1.0]), P.STANDARD_GRAVITY_MPS2
    s = scans.State(1.0, level, np.zeros(3), np.zeros(3))
    up, still = np.array([0.0, 0.0, g]), np.zeros(3)
    assert [(scans.advance(s, t, up, still)[0].t, scans.advance(s, t, up, still)[1]) for t in (1.1, 1.0, 0.5, 9.0, math.nan)] == [(1.1, 0), (1.0, 8), (0.5, 8), (9.0, 16), (1.0, 32)]
    fast, none = np.array([100.0, 0, 0]), np.full(3, np.nan)
    assert scans.advance(s, 1.1, up, fast, supplied=level)[1] == 32 and scans.advance(s, 1.1, up, none, supplied=level)[1] == 0 and scans.advance(s, 1.1, up, none)[1] == 32


def test_start_of_a_segment(spark):
    c = lambda *cols: list(spark.range(1).select(*[x.alias(f"c{k}") for k, x in enumerate(cols)]).first())
    assert c(*evaluation.initial_heading(F.lit(3.0), F.lit(4.0))) == pytest.approx([0.6, 0.8]) and c(*evaluation.initial_heading(F.lit(0.0), F.lit(0.0))) == [1.0, 0.0]
    east = (F.lit(0.6), F.lit(0.8))
    none = F.lit(None).cast("double")
    assert c(*evaluation.initial_velocity(F.lit(True), F.lit(9.0), east)) == [0, 0, "zero_stationary"]
    assert c(*evaluation.initial_velocity(F.lit(False), F.lit(10.0), east)) == [6.0, 8.0, "reference_speed"] and c(*evaluation.initial_velocity(F.lit(False), none, east)) == [0, 0, "zero_assumed"]
    conf = lambda g, w, gyro: c(evaluation.attitude_confidence(F.lit(g).cast("double"), F.lit(w).cast("double"), F.lit(gyro)))[0]
    # no trusted field: capped at a half; a field of weight 0.5: times 0.6 + 0.2; no gyroscope: half
    assert [conf(0.9, 0.0, True), conf(0.9, 0.5, True), conf(0.8, None, False), conf(None, 1.0, True)] == pytest.approx([0.5, 0.72, 0.4, 0.0])
    rows = [("a", i, i * 1_000_000, 2 <= i <= 8) for i in range(20)] + [("b", i, i * 1_000_000, 6 <= i <= 12) for i in range(20)] + [("c", i, i * 1_000_000, False) for i in range(3)]
    out = evaluation.begins_at_rest(spark.createDataFrame(rows, "k string, i int, t long, m boolean"), "k", ["i"], "t", "m").collect()
    assert {r.k: (r.rest_s, r.begins_at_rest) for r in out} == {"a": (6.0, True), "b": (6.0, False), "c": (None, False)}


def test_curves(spark):
    """A track at 1 m/s to the north, a reference that is 3 m to the east and 2 seconds later in time: exact at the lag, once heading is turned by nothing."""
    track = spark.createDataFrame([("s", i, i * 1_000_000, 0.0, float(i) * 3, 0.0, 0.0, 3.0, 0.0) for i in range(10)], "k string, i int, t long, px double, py double, pz double, vx double, vy double, vz double")
    ref = spark.createDataFrame([("s", i, i * 1_000_000 + 500_000, 3.0, 359.0 if i % 2 else 1.0, 3.0, (i + 0.5 - 2) * 3, 0.0) for i in range(12)], "k string, i int, t long, speed double, heading_deg double, e double, n double, u double")
    rows = evaluation.error_curves(track, ref, "k", "t", ["i"], 2.0).orderBy("t").collect()
    assert [(r.speed_error, r.horizontal_error, r.position_error) for r in rows[:9]] == [pytest.approx((0, 3, 3))] * 9
    assert rows[9].horizontal_error == pytest.approx(3) and all(abs(r.heading_error_deg) < 1e-6 for r in rows)
    assert evaluation.error_curves(track, ref, "k", "t", ["i"], 0.0).orderBy("t").first().horizontal_error is None  # before the reference's first row
    s = evaluation.compare(evaluation.error_curves(track, ref, "k", "t", ["i"], 2.0), "k", "t", ["i"]).first()
    assert (s.duration_s, s.distance) == (9.0, 27.0) and s.horizontal_error_rmse == pytest.approx(3) and s.drift_per_second == pytest.approx(3 / 9) and s.drift_per_distance == pytest.approx(3 / 27) and s.drift_speed == pytest.approx(0)


def test_alignment_figures():
    t = np.arange(0, 140, 0.05)
    along = np.where(t > 20, 2.0 * np.sin((t - 20) * 0.5) * np.cos((t - 20) * 0.13), 0.0)
    speed = 20 + np.cumsum(along) * 0.05
    accel = np.stack([np.zeros_like(t), along, np.full_like(t, P.STANDARD_GRAVITY_MPS2)], axis=1)  # forward is the phone's y
    r = alignment.estimate(t, accel, speed)
    assert r["status"] == "SUCCESS" and r["rotation"].round(2).tolist() == [[0, 1, 0], [-1, 0, 0], [0, 0, 1]] and r["gravity_residual_deg"] == pytest.approx(0, abs=1e-6)
    assert abs(r["lag_s"]) <= 0.2 and r["margin"] > P.MIN_LAG_PEAK_MARGIN and r["disagreement_rad"] < 0.05 and 0.2 < r["confidence"] <= 1
    late = alignment.estimate(t, accel, np.interp(t - 3.0, t, speed))  # the speed comes three seconds late, so it has to be read three seconds on
    assert late["lag_s"] == pytest.approx(3.0, abs=0.21) and late["status"] == "SUCCESS"
    assert alignment.estimate(t, accel, np.full_like(t, 20.0))["status"] == "INSUFFICIENT_MOTION"
    assert alignment.estimate(t, accel * 2, speed)["status"] == "LOW_GRAVITY_CONFIDENCE" and alignment.estimate(t, accel, np.full_like(t, np.nan))["rotation"] is None
    assert alignment.estimate(t, accel, speed, valid=np.zeros(len(t), bool))["status"] == "INSUFFICIENT_MOTION"


def test_residual_lag(spark):
    t = np.arange(0, 120, 0.1)
    wave = lambda x: 10 + 3 * math.sin(0.7 * x) + 2 * math.sin(0.31 * x)
    rows = [("late", int(round(x * 1e6)), float(wave(x) + 0.4 * x), 0.0, 0.0) for x in t] + [("ramp", int(round(x * 1e6)), float(x), 0.0, 0.0) for x in t]  # with a drift of 0.4 m/s a second
    track = spark.createDataFrame([*rows, ("alone", 0, 1.0, 0.0, 0.0)], "k string, t long, vx double, vy double, vz double")
    ref = spark.createDataFrame([("late", int(round(x * 1e6)), float(wave(x - 2.0))) for x in t] + [("ramp", int(round(x * 1e6)), float(x)) for x in t] + [("none", 0, 1.0)], "k string, t long, speed double")
    got = {r.k: r for r in evaluation.residual_lag(track, ref, "k", "t").collect()}
    assert set(got) == {"late", "ramp", "alone"}
    assert got["late"].accepted and got["late"].lag_s == pytest.approx(2.0) and got["late"].correlation > 0.99 > got["late"].zero_correlation
    assert not got["ramp"].accepted and got["ramp"].lag_s == 0 and not got["alone"].accepted


def test_checks_summaries_and_choice(spark):
    w = lambda i: math.sin(i / 7.0)
    v = lambda i: 10 + 5 * math.cos(i / 11.0)
    turn = [0.0, 1.0, 0.0, -1.0, 0.0, 0.0, 0.0, 0.0, 1.0]  # vehicle x is the phone's y, vehicle y its negative x
    rows = [("s", i, i * 1_000_000, v(i), -v(i) * w(i), (v(i + 1) - v(i - 1)) / 2, 0.0, 0.0, 0.0, w(i), w(i) * 2 + 1, turn) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, i int, t long, v double, a_x double, a_y double, a_z double, g_x double, g_y double, g_z double, yaw double, r array<double>")
    c = evaluation.alignment_checks(df, "k", ["i"], "t", "r", "a", "v", "g", "yaw").first()
    assert [c.longitudinal_correlation, c.lateral_correlation, c.angular_correlation] == pytest.approx([1.0, 1.0, 1.0])
    assert evaluation.alignment_checks(df, "k", ["i"], "t", "r", "a", "v").first().lateral_correlation is None
    states = spark.createDataFrame([("s", i, i * 2_000_000, float(x), float(y), 0.0, 3.0 * i, 4.0 * i, 0.0, i) for i, (x, y) in enumerate([(0, 0), (3, 4), (3, 0)])], "k string, i int, t long, px double, py double, pz double, vx double, vy double, vz double, flags int")
    s = evaluation.trajectory_summary(states, "k", ["i"], "t", "flags").first()
    assert (s.samples, s.duration_s, s.final_speed_mps, s.max_speed_mps, s.displacement_m, s.path_length_m, s.flagged) == (3, 4.0, 10.0, 10.0, 3.0, 9.0, 2)
    runs = spark.createDataFrame([(n, d) for n, d in zip("abcde", [1.0, 9.0, 5.0, 4.0, 6.0], strict=True)], "n string, d double")
    assert [r.n for r in evaluation.nearest_to_median(runs, "d", ["n"], 3).collect()] == ["c", "d", "e"]


def test_reference_of_a_recording(spark):
    rows = [("a", 0, 0, 1.0, True, None, 10.0), ("a", 1, 1, 2.0, False, None, 20.0), ("b", 0, 0, 3.0, None, 5.0, 30.0), ("c", 0, 0, 4.0, True, None, None)]
    df = spark.createDataFrame(rows, "k string, i int, t long, v double, fresh boolean, car double, phone double")
    e = F.col("v") * 10
    got = [(r.k, r.speed, r.e, r.heading_deg, r.heading_source) for r in evaluation.reference_track(df, "k", F.col("v"), (e, e, e), F.col("fresh"), ["car", "phone"], ["i"], "t").orderBy("k", "i").collect()]
    assert got == [("a", 1.0, 10.0, 10.0, "phone"), ("a", 2.0, None, 20.0, "phone"), ("b", 3.0, None, 5.0, "car"), ("c", 4.0, 40.0, None, "none")]


def test_pieces_and_run_summary(spark):
    one = spark.createDataFrame([(0.0, 1.0)], "t_s double, px double")
    both = evaluation.concatenate([one, one.withColumn("vx", F.lit(2.0))]).orderBy("piece").collect()
    assert [(r.piece, r.px, r.vx) for r in both] == [(0, 1.0, None), (1, 1.0, 2.0)]
    with pytest.raises(ValueError):
        evaluation.concatenate([])
    t = evaluation.total_counters(spark.createDataFrame([("a", 3, 1, True), ("a", 4, 0, False)], "k string, integrated int, irregular int, heading_observed boolean"), "k").first()
    assert (t.integrated, t.irregular, t.heading_observed) == (7, 1, False)
    rows = [(True, True, True, 4.0, 2.0, 1.0, -3.0, True), (True, False, True, 6.0, float("nan"), 2.0, 0.0, False), (True, True, False, None, None, None, None, None), (False, False, None, 9.0, 9.0, 9.0, 9.0, True)]
    r = evaluation.run_summary(spark.createDataFrame(rows, "succeeded boolean, aligned boolean, compared boolean, zero_rmse double, best_rmse double, position_drift double, lag_s double, lag_accepted boolean")).first()
    assert list(r) == [4, 3, 2, 1, 2, 5.0, 2.0, 1.5, 1, 3.0]


def test_retimed(spark):
    stamps = spark.createDataFrame([("s", i, t) for i, t in enumerate([0.0, 0.1, 0.1, 5.0])], "segment_id string, i long, t_s double")
    got = GN.retimed(stamps, accel=(2.0, 0.0, 0.0), v0=(1.0, 0.0, 0.0)).orderBy("i").collect()
    assert [(r.true_v_x, r.true_p_x) for r in got] == [pytest.approx(x) for x in ((1, 0), (1.2, 0.11), (1.2, 0.11), (11, 30))]
