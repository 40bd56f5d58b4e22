"""Propagation by blocks against the walk over samples."""

from __future__ import annotations

import math
from functools import reduce

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.operators import generators as GN
from tracewright.operators import navigation, propagation, scans

COLUMNS = ["v_x", "v_y", "v_z", "p_x", "p_y", "p_z", "q_x", "q_y", "q_z", "q_w", "flags"]


@pytest.fixture(scope="module")
def segments(spark):
    rate = GN.with_gap(GN.trajectory(GN.clock(spark, "gap", 9.0, 20.0), accel=(0.5, -0.2, 0.0), body_rate=(0.1, -0.2, 0.3)), 4.0, 2.0)
    bad = GN.corrupted(GN.trajectory(GN.clock(spark, "bad", 9.0, 20.0), body_rate=(0.4, 0.1, -0.3)), 20)  # samples 19, 39, .., some of them last in their block
    twice = GN.with_duplicate_times(GN.stationary(spark, 3.0, 20.0), 7, 0.05)
    one = GN.stationary(spark, 0.0, 20.0).withColumn("segment_id", F.lit("one"))
    lost = GN.irregular(spark, 4.0, 20.0).withColumn("t_s", F.when(F.col("i") > 70, float("nan")).otherwise(F.col("t_s"))).withColumn("segment_id", F.lit("lost"))
    parts = [f(spark) for f in GN.FIXTURES if f is not GN.stationary] + [rate, bad, twice, one, lost]
    return reduce(lambda a, b: DataFrame.unionByName(a, b, allowMissingColumns=True), parts)


@pytest.mark.parametrize("block_s", [60.0, 1.0, 0.07])
def test_blocks_equal_the_walk(spark, segments, block_s):
    rows = segments.select("segment_id", "i", "t_s", *propagation.VECTORS)
    want = {(r.segment_id, r.i): r for r in walked(rows)}
    got = propagation.mechanize(rows, ties=["i"], block_s=block_s).collect()
    assert len(got) == len(want) and {r.flags for r in got} == {0, 8, 16, 32}
    for r in got:
        assert [r[c] for c in COLUMNS] == pytest.approx([want[r.segment_id, r.i][c] for c in COLUMNS], abs=1e-9), (r.segment_id, r.i)


def walked(rows):
    """scans.mechanize with the sample numbers, which it doesn't give out."""
    out = []
    pdf = rows.toPandas()
    for k, own in pdf.groupby("segment_id"):
        own = own.sort_values(["t_s", "i"], kind="stable")
        df = rows.sparkSession.createDataFrame(own.assign(n=range(len(own))))
        got = scans.mechanize(df, order="n").toPandas()
        for i, r in zip(own["i"], got.itertuples(), strict=True):
            out.append(type("R", (), {"segment_id": k, "i": i, "__getitem__": lambda s, c: getattr(s.r, c), "r": r})())
    return out


def test_known_trajectories(spark):
    truth = reduce(DataFrame.unionByName, [f(spark) for f in GN.FIXTURES])
    out = propagation.mechanize(truth, ties=["i"], block_s=1.3)
    off = F.sqrt(sum(((F.col(f"p_{a}") - F.col(f"true_p_{a}")) ** 2 for a in "xyz"), F.lit(0.0)))
    worst = out.join(truth.select("segment_id", "i", *[f"true_p_{a}" for a in "xyz"]), ["segment_id", "i"]).groupBy("segment_id").agg(F.max(off).alias("off"), F.count("*").alias("n")).collect()
    assert {r.segment_id: r.n for r in worst} == {"constant_acceleration": 501, "constant_velocity": 501, "irregular": 501, "pure_rotation": 501, "stationary": 1001, "tilted": 501}
    assert all(r.off < 1e-6 for r in worst)


def test_a_long_recording_is_many_groups(spark):
    rows = GN.trajectory(GN.clock(spark, "long", 80.0, 20.0), body_rate=(0.0, 0.0, 0.2))
    plan = propagation.mechanize(rows, block_s=10.0)
    assert plan.count() == 1601 and math.isclose(plan.agg(F.max(F.abs("q_z"))).first()[0], 1.0, abs_tol=1e-2)
    groups = rows.select(F.floor(F.col("t_s") / 10.0)).distinct().count()
    assert groups >= 8


@pytest.mark.parametrize("block_s", [0.05, 1.0, 300.0])
def test_given_attitudes_by_blocks_equal_the_walk(spark, block_s):
    """Blocks of one row, of some and of all: a block's first steps need two rows before it, wherever they lie."""
    i, k = F.col("i"), F.col("segment_id")
    rows = spark.range(600).select(F.col("id").alias("i"), F.when(F.col("id") < 570, F.concat(F.lit("s"), F.col("id") % 2)).alias("segment_id"))
    gap = F.when(i > 200, 4.0).otherwise(0.0) + F.when(i > 400, F.when(i < 410, (i - 400) * 40.0).otherwise(400.0)).otherwise(0.0)
    sense = {"force_x": F.when(i % 41 > 0, F.sin(i) * 3), "force_y": F.cos(i * 2), "force_z": F.when(i % 97 > 0, 9.7).otherwise(900.0), "gyro_x": F.when(i % 37 > 0, F.sin(i * 3) / 3), "gyro_y": F.cos(i) / 2, "gyro_z": F.lit(0.1)}
    rows = rows.select("segment_id", "i", F.round((i * 0.033 + gap) * 1e6).cast("long").alias("us"), *[c.alias(n) for n, c in sense.items()], F.lit(0.0).alias("q_x"), (F.sin(i) / 9).alias("q_y"), F.lit(0.0).alias("q_z"), F.sqrt(1 - F.sin(i) ** 2 / 81).alias("q_w"), F.lit(2.0).alias("v0_x"), F.lit(0.0).alias("v0_y"), F.lit(0.0).alias("v0_z"))
    got = {r.i: r for r in navigation.propagate(rows, "segment_id", ["i"], "us", block_s=block_s).collect()}
    names = [f"{p}_{a}" for p in "vp" for a in "xyz"]
    want = scans.mechanize(rows.where(k.isNotNull()).withColumn("t_s", F.col("us") / 1e6), supplied=True, order="i").withColumn("us", F.round(F.col("t_s") * 1e6).cast("long")).join(rows.select("segment_id", "us", "i"), ["segment_id", "us"]).collect()
    assert len(got) == 600 and len(want) == 570 and sum(r.segment_id is None for r in got.values()) == 30  # no segment's name is a segment too
    for r in want:
        assert [got[r.i][n] for n in names] == pytest.approx([r[n] for n in names], abs=1e-7) and got[r.i].flags & 56 == r.flags, r.i
