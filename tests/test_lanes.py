"""Recordings walked side by side, against one alone."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tracewright.operators import attitude, lanes, propagation, scans


def test_whole_recordings_of_batches():
    rows = pd.DataFrame({"k": [1] * 7 + [2] + [3] * 40 + [None] * 2, "i": range(50)})
    for size in (1, 3, 11, 60):
        got = list(lanes.whole((rows.iloc[i : i + size] for i in range(0, 50, size)), ["k"], 8))
        assert np.concatenate([p["i"] for p in got]).tolist() == list(range(50))
        owners = [set(p["k"].fillna(-1)) for p in got]
        assert sum(map(len, owners)) == 4  # no recording is cut
    assert list(lanes.whole(iter([]), ["k"], 8)) == []


def test_lanes_walk_as_advance_does():
    rng = np.random.default_rng(5)
    length = np.array([40, 25, 33])
    t = np.cumsum(rng.choice([0.1, 0.2, 0.7, 0.0, -0.05], (3, 40), p=[0.5, 0.3, 0.1, 0.05, 0.05]), axis=1)
    t[rng.random(t.shape) < 0.05] = np.nan
    t[:, 0] = 0
    force, rate = rng.normal(0, 5, (3, 40, 3)) + [0, 0, 9.8], rng.normal(0, 1, (3, 40, 3))
    rate[rng.random((3, 40)) < 0.1] = np.nan
    force[rng.random((3, 40)) < 0.1] = np.nan
    given = rng.normal(0, 1, (3, 40, 4))
    given /= np.linalg.norm(given, axis=2, keepdims=True)
    for supplied in (None, given):
        got, flags = scans.walk(t, force, rate, length, given[:, 0], np.ones((3, 3)), supplied)
        for j, n in enumerate(length):
            s = scans.State(t[j, 0], given[j, 0], np.ones(3), np.zeros(3))
            for i in range(1, n):
                s, flag = scans.advance(s, t[j, i], force[j, i], rate[j, i], None if supplied is None else supplied[j, i])
                assert flag == flags[j, i] and np.concatenate([s.v, s.p, s.q]) == pytest.approx(got[j, i], abs=1e-9)


def test_running_joins_of_stretches():
    rng = np.random.default_rng(6)
    length = [1, 2, 9, 1, 17]
    at = np.concatenate([np.arange(n) for n in length])
    q = rng.normal(0, 1, (len(at), 4))
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    got, sums = propagation.products(q, at), propagation.running(q, at, np.add)
    for i, n in enumerate(at):
        want = q[i - n]
        for j in range(i - n + 1, i + 1):
            want = propagation.multiply(want, q[j])
        assert got[i] == pytest.approx(want) and sums[i] == pytest.approx(q[i - n : i + 1].sum(axis=0))


def test_a_long_recording_comes_in_pieces(spark):
    """A task holds no more than the rows asked for and one batch, however long a recording is."""
    rows = pd.DataFrame({"k": [1] * 7 + [2] + [3] * 400 + [None] * 2, "i": range(410)})
    for size in (1, 3, 11, 60):
        got = list(lanes.pieces((rows.iloc[i : i + size] for i in range(0, 410, size)), ["k"], 8))
        assert max(len(p) for p, _, _ in got) < 8 + size
        assert np.concatenate([p["i"].iloc[int(begun) :] for p, begun, _ in got]).tolist() == list(range(410))
        assert all(p["i"].iloc[0] == before["i"].iloc[-1] for (before, _, _), (p, begun, _) in zip(got, got[1:], strict=False) if begun)
        assert all(begun != ends for (_, _, ends), (_, begun, _) in zip(got, got[1:], strict=False)) and got[-1][2]

    def seen(pdf, before):
        return pd.DataFrame({"n": [len(pdf)], "held": [before or 0]}), int(pdf["id"].iloc[-1])

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)
    try:
        got = lanes.over(spark.range(2000).selectExpr("id", "0 AS k"), ["k"], ["id"], seen, "n long, held long", 100).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert max(r.n for r in got) < 150 and max(r.held for r in got) > 1800


def drives(spark):
    """Three recordings, one of them far longer than the others, with gaps, steps back and samples that a sensor lost."""
    i, k = F.col("id"), F.col("k")
    rows = spark.range(700).withColumn("k", F.when(i < 20, "a").when(i < 650, "b"))
    lost = lambda n, c: F.when(i % n > 0, c)
    sense = {"force_x": lost(41, F.sin(i) * 3), "force_y": F.cos(i * 2), "force_z": F.lit(9.7), "gyro_x": F.sin(i * 3) / 3, "gyro_y": lost(37, F.cos(i) / 2), "gyro_z": (i % 5 - 2) / 8.0}
    return rows.select(F.coalesce(k, F.lit("c")).alias("k"), i.alias("i"), (i * 0.1 + F.when(i >= 300, 2.0).otherwise(0.0) - F.when(i % 53 == 0, 0.15).otherwise(0.0)).alias("t_s"), *[c.alias(n) for n, c in sense.items()])


def test_pieces_walk_as_whole_recordings_do(spark, monkeypatch):
    df = drives(spark)
    felt = df.select("k", "i", "t_s", *[F.col(f"force_{a}").alias(f"accel_{a}") for a in "xyz"], *[f"gyro_{a}" for a in "xyz"], F.lit(15.0).alias("mag_x"), (30 + F.sin("i")).alias("mag_y"), F.lit(-30.0).alias("mag_z"))
    every = lambda: {
        "orientation": attitude.orientation(felt, "k", ["i"], gyro="gyro", mag="mag", lane_rows=scans.LANE_ROWS), "bias": scans.bias_sensitivity(df, "k"), "given": scans.mechanize(df.withColumns({"q_x": F.lit(0.0), "q_y": F.sin("i") / 9, "q_z": F.lit(0.0), "q_w": F.sqrt(1 - F.sin("i") ** 2 / 81)}), "k", supplied=True),
        **{gap: scans.mechanize(df, "k", gap, order="i") for gap in ("skip", "segment")},
    }
    rows = lambda: {n: sorted(map(str, d.collect())) for n, d in every().items()}
    whole = rows()
    monkeypatch.setattr(scans, "LANE_ROWS", 16)
    monkeypatch.setattr(scans, "CASE_ROWS", 16)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 16)
    try:
        parts = rows()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(whole["skip"]) == len(whole["orientation"]) == 700 and len(whole["bias"]) == 3 * 24 and len(whole["segment"]) < 700
    for n in whole:
        assert parts[n] == whole[n], n
