"""Evaluation of whole segments, and the command that runs it."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from tracewright import navigate
from tracewright import params as P
from tracewright.functions import flags as FL
from tracewright.functions import quaternions as Q
from tracewright.functions import rotations as R
from tracewright.functions import vectors as V
from tracewright.operators import generators as GN
from tracewright.operators import navigation, scans
from tracewright.plans import frame_queries, segments


def canonical(spark):
    """Three phones: one that drives east after a rest, one with too few samples, one that lies still; with fixes of the true way."""
    drive = GN.drive(spark, "drive", rest_s=20.0, drive_s=60.0, rate_hz=10.0, sigma=0.01)
    still = GN.drive(spark, "still", rest_s=40.0, drive_s=0.0, rate_hz=10.0, sigma=0.01)
    few = GN.drive(spark, "few", rest_s=5.0, drive_s=0.0, rate_hz=10.0)
    rows = drive.unionByName(still).unionByName(few)
    phase = (F.col("t_s") - 20.0) * (2 * math.pi / 20)
    way = F.when((F.col("t_s") > 20) & (F.col("segment_id") == "drive"), 7.5 * ((F.col("t_s") - 20) - F.sin(phase) * (20 / (2 * math.pi)))).otherwise(0.0)
    lon = -1.5 + F.degrees(way / (P.WGS84_SEMI_MAJOR_M * math.cos(math.radians(52.4))))
    return rows.select(
        "segment_id", F.concat(F.lit("S-"), "segment_id").alias("session_id"), F.concat("segment_id", F.lit(".csv")).alias("source_file"), F.col("i").alias("row_idx"), F.round(F.col("t_s") * 1e6).cast("long").alias("t_us"), F.col("t_s").alias("analysis_time_s"),
        *[f"{s}_{a}" for s in ("accel", "gyro", "mag", "gravity") for a in "xyz"], F.lit(52.4).alias("latitude"), lon.alias("longitude"), F.lit(100.0).alias("altitude_m"), (F.col("i") % 10 == 0).alias("gnss_position_fresh"),
        F.lit(None).cast("double").alias("gnss_speed_mps"), F.col("speed").alias("ref_speed_mps"), F.lit(90.0).alias("ref_heading_deg"), F.lit(None).cast("double").alias("gnss_heading_deg"), F.lit("smartphone").alias("stream"),
    )


@pytest.fixture(scope="module")
def made(spark):
    rows = canonical(spark)
    return rows, segments.evaluate(rows)


def test_evaluations(made):
    _, out = made
    got = {r.segment_id: r for r in out["evaluations"].collect()}
    assert set(got) == {"drive", "still", "few"}
    assert got["few"].error == "fewer than 300 samples with an acceleration" and got["few"].sample_count is None
    d, s = got["drive"], got["still"]
    assert d.error is None and d.sample_count == 801 and d.integrated_steps == 800 and d.skipped_steps == 0
    assert d.alignment_status == "SUCCESS" and d.alignment_available and d.heading_observed and d.begins_at_rest and d.velocity_source == "zero_stationary"
    assert s.alignment_status == "INSUFFICIENT_MOTION" and not s.alignment_available and s.stationary_fraction > 0.9 and s.max_speed_mps < 2.0
    assert d.gyro_bias_magnitude_rps < 0.01 and d.accel_bias_magnitude_mps2 < 0.02 and d.best_lag_speed_rmse_mps < 6.0 and d.path_length_m > 100
    t = {r.segment_id: r.flags for r in out["trajectories"].groupBy("segment_id").agg(F.bit_or("flags").alias("flags")).collect()}
    n = FL.NAVIGATION
    assert t["still"] == n["ALIGNMENT_UNAVAILABLE"] | n["STATIONARY"] and not t["drive"] & (n["ALIGNMENT_UNAVAILABLE"] | n["LARGE_TIME_GAP"])
    r = segments.summary(out["evaluations"]).first()
    assert (r.segments_processed, r.segments_propagated, r.segments_with_alignment, r.segments_without_alignment, r.segments_compared) == (3, 2, 1, 2, 2)
    f = segments.frame_summary(out["alignments"]).first()
    assert f.statuses == {"SUCCESS": 1, "INSUFFICIENT_MOTION": 1} and (f.segments, f.yaw_resolved) == (2, 1)


def test_trajectory_is_the_walk_of_samples(spark, made):
    """The sums of expressions equal the walk with the same attitudes, biases and start."""
    rows, out = made
    track = out["trajectories"].where("segment_id = 'drive'")
    bias = out["biases"].where("segment_id = 'drive'").first()
    own = rows.where("segment_id = 'drive'").join(track.select("row_idx", *[f"q_{a}" for a in "xyzw"]), "row_idx")
    own = own.select("segment_id", F.col("row_idx").alias("i"), (F.col("t_us") / 1e6).alias("t_s"), *[(F.col(f"accel_{a}") - bias[f"accel_bias_{a}"]).alias(f"force_{a}") for a in "xyz"], *[(F.col(f"gyro_{a}") - bias[f"gyro_bias_{a}"]).alias(f"gyro_{a}") for a in "xyz"], *[f"q_{a}" for a in "xyzw"])
    want = scans.mechanize(own, supplied=True, order="i").orderBy("t_s").collect()
    got = track.orderBy("row_idx").collect()
    assert len(got) == len(want) == 801
    for a, b in zip(got, want, strict=True):
        assert [a.vx, a.vy, a.vz, a.px, a.py, a.pz] == pytest.approx([b.v_x, b.v_y, b.v_z, b.p_x, b.p_y, b.p_z], abs=1e-8)


def test_the_command_goes_on_where_it_was(spark, tmp_path):
    rows = canonical(spark).withColumn("is_canonical_copy", F.lit(True))
    rows.write.partitionBy("stream").parquet(str(tmp_path / "in"))
    go = lambda limit=None: navigate.run(spark, str(tmp_path / "in"), str(tmp_path / "out"), limit)
    there = lambda name: sorted(r[0] for r in spark.read.parquet(str(tmp_path / "out" / name)).select("segment_id").distinct().collect())
    assert go(1) == 0 and there("evaluations") == ["drive"]
    assert go() == 0 and there("evaluations") == ["drive", "few", "still"] and there("trajectories") == ["drive", "still"]
    n = spark.read.parquet(str(tmp_path / "out/evaluations")).count()
    assert go() == 1 and n == 3
    assert spark.read.json(str(tmp_path / "out/summary")).first().segments_processed == 3


def test_bias_from_the_longest_rest(spark):
    """Rates of 0.01 over the longer of two rests; 9.85 felt along up, so 0.04335 too much; a rest of one sample tells nothing of the acceleration."""
    rows = [("a", i, i * 100_000, i >= 50 or i < 10, 0.0 if i < 50 else 0.01, 9.85 if i >= 50 else 20.0) for i in range(100)] + [("b", 0, 0, True, 0.5, 9.9), ("c", 0, 0, False, 0.0, 9.8)]
    df = spark.createDataFrame(rows, "k string, i int, t long, rest boolean, g_x double, a_z double").withColumns({"g_y": F.lit(0.0), "g_z": F.lit(0.0), "a_x": F.lit(0.0), "a_y": F.lit(0.0), "u_x": F.lit(0.0), "u_y": F.lit(0.0), "u_z": F.lit(1.0)})
    got = {r.k: r for r in navigation.bias_from_longest_rest(df, "k", ["i"], "t", "rest", "a", "u", "g").collect()}
    assert got["a"].gyro_bias_x == pytest.approx(0.01) and got["a"].gyro_sigma_x == pytest.approx(0, abs=1e-12) and got["a"].accel_bias_z == pytest.approx(0.04335) and got["a"].rest_samples == 50
    assert got["b"].gyro_bias_x == 0.0 and got["b"].accel_bias_z == 0.0 and got["c"].rest_samples == 0  # 0.5 is no plausible bias


def test_frames_of_a_state(spark):
    turn = R.FrameRotation.from_quaternion(Q.from_axis_angle(V.constant(0, 0, 1), F.lit(math.pi / 2)), "vehicle", "phone")
    out = navigation.navigation_from_vehicle(Q.from_axis_angle(V.constant(0, 0, 1), F.lit(math.pi / 2)), turn)
    assert (out.to, out.of) == ("navigation", "vehicle")
    assert [c for c in spark.range(1).select(*R.apply(out.matrix, V.constant(1, 0, 0))).first()] == pytest.approx([1, 0, 0], abs=1e-12)
    with pytest.raises(ValueError):
        navigation.navigation_from_vehicle(Q.identity(), turn.inverse())
    none = spark.createDataFrame([(None,)], "r array<double>")
    assert none.select(navigation.resolve_alignment(F.col("r"))).first()[0] is None
    with pytest.raises(Exception, match="no rotation"):
        none.select(navigation.resolve_alignment(F.col("r"), "require")).collect()


def test_orientation_against_the_recording(spark):
    """Roll is 3 degrees off and a whole turn, pitch 4 degrees; yaw has a value in nine of twelve rows only, which are too few."""
    q = Q.from_euler(F.lit(0.1), F.lit(-0.2), F.lit(0.3))
    turned = spark.range(12).select(F.lit("s").alias("segment_id"), F.col("id").alias("row_idx"), *[c.alias(f"q_{a}") for c, a in zip(q, "xyzw", strict=True)])
    yaw = F.when(F.col("id") < 9, 5.0).when(F.col("id") == 9, float("nan"))
    rows = spark.range(12).select(F.lit("s").alias("segment_id"), F.col("id").alias("row_idx"), F.lit(math.degrees(0.1) + 360.0 - 3.0).alias("orientation_roll"), F.lit(math.degrees(-0.2) + 4.0).alias("orientation_pitch"), yaw.alias("orientation_yaw"))
    r = segments.orientation_rmse(turned, rows).first()
    assert (r.roll_rmse_deg, r.pitch_rmse_deg, r.roll_n) == (pytest.approx(3.0), pytest.approx(4.0), 12) and (r.yaw_rmse_deg, r.yaw_n) == (None, 9)
    assert segments.orientation_rmse(turned, rows.drop("orientation_pitch")).first().pitch_rmse_deg is None
    few = segments.orientation_rmse(turned, rows, least=9).first()
    assert few.yaw_rmse_deg == pytest.approx(abs(math.degrees(0.3) - 5.0))


def test_a_recording_loses_accelerations_only_where_too_few_are_left(spark, tmp_path):
    for n, short in ((29 * 6 - 1, True), (29 * 7, False)):
        i = F.col("id")
        e = spark.range(2 * n).select(i.alias("event_id"), F.timestamp_micros(1_700_000_000_000_000 + i).cast("timestamp_ntz").alias("ts"), i.alias("user_id"), F.when(i < n, "signup").otherwise("view").alias("event_type"), F.lit(1.0).alias("value"))
        e.write.parquet(str(tmp_path / f"{n}/events.parquet"))
        got = {r.k: (r.n, r.gone) for r in frame_queries._lost(spark, str(tmp_path / str(n)), 7).groupBy("k").agg(F.count("*").alias("n"), F.count_if("lost").alias("gone")).collect()}
        assert got == {"signup": (n, n - 6 if short else 0), "view": (n, 0)}
