"""Synchronisation and labels of sessions made up so that the answer is known."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright.functions import flags as FL
from tracewright.operators import asof, runs, timeline

COLS = "dataset_family string, session_id string, stream string, source_file string, segment_id string, row_idx long, time_of_day_s double, gnss_speed_mps double, ref_speed_mps double, gnss_position_fresh boolean, quality_flags int"


def speed(t):
    return 12 + 6 * math.sin(t / 9.0) + 3 * math.sin(t / 4.1)


def session(name, n=1200, shift=3.4, same=True, car=True, low=40_000.0):
    """A phone whose clock is ahead of the car's by `shift`; its recording starts 2 and ends 2 seconds after the car's."""
    phone = [("f", name, "smartphone", f"S-{name}", f"p{name}", i, low + 2 + shift + i * 0.1, speed(2 + i * 0.1) if same else (i * 7919 % 13) * 1.0, None, i % 5 == 0, 0) for i in range(n)]
    vehicle = [("f", name, "vehicle", f"V-{name}", f"v{name}", i, low + i * 0.1, None, speed(i * 0.1), None, 0) for i in range(n)]
    return phone + (vehicle if car else [])


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(session("A") + session("B", same=False) + session("C", car=False) + session("D", n=300), COLS).cache()


def test_sync(spark, rows):
    got = {r.session_id: r for r in runs.synchronize(rows).collect()}
    a, b, d = got["A"], got["B"], got["D"]
    assert set(got) == {"A", "B", "D"} and a.pair_id == "f:A"
    # the clocks' ends differ by 5.4 s, of which 3.4 are the shift
    assert a.clock_offset_s == pytest.approx(5.4) and a.estimated_offset_s == pytest.approx(3.4) and a.correlation == pytest.approx(1.0, abs=1e-4)
    assert (a.status, a.offset_method, a.offset_confidence, a.drift_detected) == ("CONFIRMED_BY_SIGNAL", "speed_cross_correlation", "high", False)
    assert a.overlap_s == pytest.approx(117.9)
    assert (b.status, b.offset_confidence) == ("CLOCK_ONLY", "low") and b.estimated_offset_s == b.clock_offset_s
    assert (d.status, d.offset_confidence, d.correlation) == ("UNRESOLVED", "none", None)


def test_labels(spark, rows):
    labelled = runs.label(rows, runs.synchronize(rows)).cache()
    got = {r.session_id: r for r in runs.coverage(labelled).collect()}
    assert {k: (r.label_source, r.label_quality, r.n_rows) for k, r in got.items()} == {
        "A": ("TIER_1_VEHICLE_SYNCED", "high", 1200), "B": ("TIER_2_VEHICLE_CLOCK", "medium", 1200), "C": ("TIER_3_SMARTPHONE_GNSS", "low", 1200), "D": ("TIER_3_SMARTPHONE_GNSS", "low", 300)
    }
    assert got["A"].labelled_rows == 1180 and got["C"].labelled_rows == 240 and got["D"].labelled_rows == 60
    off = labelled.where("session_id = 'A' AND label_available").select(F.max(F.abs(F.col("ref_velocity_mps") - F.col("gnss_speed_mps")))).first()[0]
    assert off < 1e-3
    flags = {r[0]: r[1] for r in labelled.groupBy("session_id").agg(F.bit_or("quality_flags")).collect()}
    low, unsure = FL.QUALITY["REFERENCE_LOW_CONFIDENCE"], FL.QUALITY["SYNC_UNRESOLVED"]
    assert flags == {"A": 0, "B": 0, "C": low, "D": low | unsure}


def test_lags_against_brute_force(spark):
    rng = np.random.default_rng(5)
    n, h = 700, 23
    x, y = rng.normal(50, 3, n), rng.normal(-20, 2, n)
    y[11:] += 0.8 * (x[:-11] - 50)
    x[rng.random(n) < 0.1] = np.nan
    y[rng.random(n) < 0.1] = np.nan
    scores = {}
    for lag in range(-h, h + 1):
        i = np.arange(max(0, -lag), min(n, n - lag))
        ok = np.isfinite(x[i]) & np.isfinite(y[i + lag])
        scores[lag] = (np.corrcoef(x[i][ok], y[i + lag][ok])[0, 1], int(ok.sum()))
    rows = [("k", i, None if math.isnan(a) else float(a), None if math.isnan(b) else float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))]
    rows += [("flat", i, 5.0, float(i % 7)) for i in range(60)]
    df = spark.createDataFrame(rows, "k string, i long, x double, y double")
    for block in (64, 4096):
        r = asof.lag_search(df, "k", "i", "x", "y", h, block=block).collect()
        assert [q.k for q in r] == ["k"]
        best = max(scores, key=lambda q: scores[q][0])
        assert (r[0].lag, r[0].n) == (best, scores[best][1]) == (11, scores[11][1])
        assert r[0].correlation == pytest.approx(scores[best][0], abs=1e-12) and r[0].margin == pytest.approx(scores[best][0] - np.median([s for s, _ in scores.values()]), abs=1e-12)


def test_rows_are_sorted_within_their_segment(spark):
    s = 1_000_000
    times = [None, 0, 2 * s, 3 * s // 2, None, 3 * s, 1000 * s, 1001 * s, 950 * s, 951 * s]
    df = spark.createDataFrame([("r", i, t) for i, t in enumerate(times)], "k string, i int, t long")
    seg = timeline.segment(df, "k", ["i"], "t")
    out = timeline.arrange(seg, "k", ["i"], "t").orderBy("position").collect()
    # the gap before 1000 s (more than 100 median steps) and the reset to 950 s begin segments; only the first has a step back, so its rows without a time go last
    assert [r.i for r in out] == [1, 3, 2, 5, 0, 4, 6, 7, 8, 9]
    assert [r.i for r in out if r.backward] == [3] and [r.i for r in out if r.boundary] == [1, 6, 8]
    rec = timeline.segment_records(seg, "k", "t", ["i"]).orderBy("segment_no").collect()
    assert [(r.n_rows, r.reason, r.gap_before_s, r.short) for r in rec] == [(6, "start", None, True), (2, "gap", 997.0, True), (2, "clock_reset", -51.0, True)]
    one = spark.createDataFrame([("r", 0, 5)], "k string, i int, t long")
    assert not timeline.segment_records(timeline.segment(one, "k", ["i"], "t"), "k", "t", ["i"]).first().short
