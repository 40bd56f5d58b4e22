"""Choices and figures of the reports, against tables worked by hand."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from tracewright.functions import flags as FL
from tracewright.functions import quaternions as Q
from tracewright.functions import rotations as R
from tracewright.operators import asof
from tracewright.plans import reports

FILES = "source_file string, session_id string, stream string, n_rows long, sampling string, availability double, n_findings long, outages long, outage_s double, overlap_s double, timestamp_score double"


def test_representatives(spark):
    rows = [
        ("b", "1", "smartphone", 90, "stable", 1.0, 0, 2, 30.0, 50.0, 1.0),  # clean, and the longest outages and overlap, which stay empty
        ("a", "2", "smartphone", 80, "stable", 1.0, 0, 0, None, None, 1.0),
        ("v", "3", "vehicle", 999, "stable", 1.0, 9, 1, 5.0, None, 0.0),  # no phone: neither clean nor difficult
        ("d", "4", "smartphone", 50, "irregular", 0.5, 4, 0, None, None, 0.7),
        ("c", "5", "smartphone", 50, "severely_irregular", 0.5, 4, 0, None, None, 0.2),  # as many findings as d, an earlier path
        ("e", "6", "smartphone", 0, "irregular", None, 7, 0, None, None, 0.0),  # no rows
        ("n", "7", "smartphone", 999, None, None, None, None, None, None, None),
    ]
    got = {r.category: (r.source_file, r.session_id, r.value) for r in reports.representatives(spark.createDataFrame(rows, FILES)).collect()}
    assert got == {"clean": ("b", "1", 90.0), "difficult_motion": ("c", "5", 4.0)}
    got = {r.category: r.source_file for r in reports.representatives(spark.createDataFrame([r for r in rows if r[0] not in "bc"], FILES)).collect()}
    assert got == {"clean": "a", "gnss_gap": "v", "difficult_motion": "d"}  # d is the most irregular one as well
    assert reports.representatives(spark.createDataFrame([], FILES)).count() == 0


def test_examples(spark):
    rows = [
        ("s1", "SUCCESS", 0.9, True, 10.0, None), ("s2", "SUCCESS", 0.9, True, 20.0, None), ("s3", "SUCCESS", 0.1, True, 30.0, None), ("s4", "LOW_HEADING_CONFIDENCE", 0.2, True, 30.0, None),
        ("s5", "INSUFFICIENT_MOTION", None, False, 99.0, "failed"), ("s6", "INSUFFICIENT_MOTION", None, False, None, None), ("s7", "LOW_HEADING_CONFIDENCE", 0.8, True, 25.0, None),
    ]
    df = spark.createDataFrame(rows, "segment_id string, alignment_status string, alignment_confidence double, alignment_available boolean, duration_s double, error string")
    pick = lambda n: [r.segment_id for r in reports.examples(df, n).orderBy("example").collect()]
    assert pick(3) == ["s2", "s3", "s6"] and pick(2) == ["s2", "s3"] and pick(9) == ["s2", "s3", "s6", "s4", "s7", "s1"]
    assert reports.examples(df.limit(0)).count() == 0


def test_canonical_figures(spark):
    q = FL.QUALITY
    one = [("smartphone", "f", "f/0", i, i * 60.0, 0, s) for i, s in enumerate([5.0, None, 4.0, 4.5])] + [("smartphone", "f", "f/1", 4, 0.0, q["NON_MONOTONIC_TIMESTAMP"], 5.0)]
    two = [("smartphone", "g", "g/0", i, i * 120.0, q["SCHEMA_REPAIR"] | q["GNSS_STALE"], 1.0 + i) for i in range(2)] + [("vehicle", "v", "v/0", 0, None, 0, None)]
    df = spark.createDataFrame(one + two, "stream string, source_file string, segment_id string, row_idx int, elapsed_s double, quality_flags int, source_time_s double")
    got = {r.stream: r for r in reports.canonical_figures(df).collect()}
    p = got["smartphone"]
    assert (p.n_rows, p.files, p.segments, p.multi_segment_files, p.reordered_files, p.counter_reset_files, p.repaired_files, p.encoding_warned_files) == (7, 2, 3, 1, 1, 1, 1, 0)
    assert p.median_segment_min == 2.0 and p.total_h == pytest.approx(300 / 3600) and got["vehicle"].total_h is None


def test_label_figures(spark):
    df = spark.createDataFrame([(10, 5, 2.0, 0.5), (10, 10, 0.0, 1.0), (20, 0, None, None), (10, 10, 4.0, 0.1)], "n_rows long, labelled_rows long, mean_label_mps double, stationary_fraction double")
    r = reports.label_figures(df).first()
    assert (r.files, r.labelled_files, r.labelled_rows, r.labelled_share, r.median_label_mps, r.median_stationary_fraction) == (4, 3, 25, 0.5, 3.0, 0.5)


def test_overlap_with_the_offset_taken_off(spark):
    a = spark.createDataFrame([("s", 3_600_000_000), ("s", 3_610_000_000)], "k string, t long")
    b = spark.createDataFrame([("s", 0), ("s", 12_000_000)], "k string, t long")
    r = asof.overlap(a, b, "k", "t").first()
    assert r.overlap_s == 0.0 and r.aligned_overlap_s == pytest.approx(10.0)  # the mean offset is 3,599 s


@pytest.mark.parametrize("pitch", [0.3, math.pi / 2, -math.pi / 2])
def test_angles_of_a_frame_rotation(spark, pitch):
    q = Q.from_euler(F.lit(0.4), F.lit(pitch), F.lit(-1.1))
    f = R.FrameRotation.from_quaternion(q, "navigation", "phone")
    rows, f = f.kept(spark.range(1), "m")
    got = rows.select(*f.euler_deg(), *[F.degrees(c) for c in Q.to_euler(q)]).first()
    assert list(got[:3]) == pytest.approx(list(got[3:]), abs=1e-5)


@pytest.mark.parametrize("angle", [0.0, 1e-9, 0.5, math.pi - 1e-9, math.pi])
def test_angle_between_frame_rotations(spark, angle):
    axis = tuple(F.lit(x) for x in (0.6, 0.0, 0.8))
    f = R.FrameRotation.from_quaternion(Q.from_axis_angle(axis, F.lit(angle)), "navigation", "phone")
    assert spark.range(1).select(f.angle_to(R.FrameRotation.identity_between("navigation", "phone"))).first()[0] == pytest.approx(angle, abs=1e-12)
