from __future__ import annotations

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright.operators import generators as GN
from tracewright.operators import scans
from tracewright.plans import scan_queries
from tracewright.streaming.calibration import PROVIDER, calibrate, calibrate_batch, collect, estimates, final
from tracewright.streaming.propagation import propagate


def run(spark, rows, tmp_path, op, mode, key, parts=3):
    """Feeds rows in time order, a file for each trigger."""
    n = rows.count()
    schema = rows.schema
    for k in range(parts):
        rows.where(f"i >= {n // parts * k} AND i < {n // parts * (k + 1) if k < parts - 1 else n}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = []
    q = op(src).writeStream.outputMode(mode).foreachBatch(lambda df, _: out.extend(df.collect())).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    return out


def test_stream_equals_batch(spark, tmp_path):
    rows = GN.with_gap(GN.trajectory(GN.clock(spark, "a", 3.0, 20.0), accel=(0.5, -0.2, 0.0), body_rate=(0.0, 0.0, 0.1)), 1.5, 2.0)
    batch = {round(r.t_s, 6): r for r in scans.mechanize(rows.drop("q_x", "q_y", "q_z", "q_w")).collect()}
    got = run(spark, rows, tmp_path, propagate, "append", "segment_id")
    assert len(got) == len(batch) == 61 and {r.flags for r in got} == {0, 16}
    for r in got:
        assert all(r[c] == pytest.approx(batch[round(r.t_s, 6)][c], abs=1e-12) for c in ("v_x", "v_y", "p_x", "p_y", "p_z"))


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, PROVIDER)
    yield
    spark.conf.set(name, before)


def drive(spark, **more):
    rows = GN.drive(spark, "d", (0.0, 0.0, float(np.sin(0.3)), float(np.cos(0.3))), sigma=0.01, **more).withColumnRenamed("segment_id", "device")
    rows = rows.withColumn("speed", F.when(F.col("i") % 50 == 7, float("nan")).otherwise(F.col("speed"))).withColumn("accel_x", F.when(F.col("i") == 9, float("nan")).otherwise(F.col("accel_x")))
    return rows.withColumn("finish", F.lit(False))


def finish_at(rows, i):
    last = rows.limit(1).withColumns({"i": F.lit(i).cast(rows.schema["i"].dataType), "finish": F.lit(True)})
    return rows.unionByName(last)


def test_calibration_equals_the_batch(spark, tmp_path, rocks):
    rows = drive(spark)
    got = run(spark, finish_at(rows, 2801), tmp_path, calibrate, "update", "device")
    assert [r.finished for r in got] == [False, False, True] and got[0].status == "COLLECTING" and "acceleration while moving" not in got[1].waiting_for
    r, batch = got[-1], calibrate_batch(rows).first()
    assert (r.n, r.rejected, r.status) == (2800, 1, "SUCCESS") and batch.n == 2800 and r.gravity_method == batch.gravity_method == "gravity_channel"
    for c in ("rotation", "confidence", "correlation", "lag_s"):
        assert r[c] == pytest.approx(batch[c], abs=1e-12)


def test_calibration_ends_once(spark, tmp_path, rocks):
    """A second finish, samples after the end, and a restart from the checkpoint."""
    rows = drive(spark, drive_s=60.0)
    head, late = finish_at(rows.where("i < 1500"), 1500), finish_at(rows.where("i < 40"), 40)
    schema, out = rows.schema, []

    def go(df):
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        src = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        q = calibrate(src).writeStream.outputMode("update").foreachBatch(lambda b, _: out.extend(b.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()

    go(rows.where("i < 300"))
    go(head.where("i >= 300"))
    go(late)
    a, b, c = out
    assert not a.finished and a.waiting_for and b.finished and c.finished and b.n == c.n == 1499 and (b.rejected, c.rejected) == (1, 41)
    assert b.rotation == c.rotation and b.confidence == c.confidence and b.status == c.status
    assert b.rotation == pytest.approx(calibrate_batch(rows.where("i < 1500")).first().rotation, abs=1e-12)


def test_an_idle_session_ends_by_its_timer(spark, tmp_path, rocks):
    rows = drive(spark, rest_s=4.0, drive_s=15.0).drop("finish")
    out = []
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = calibrate(src, idle_s=1.0).writeStream.outputMode("update").foreachBatch(lambda b, _: out.extend(b.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="1 second").start()
    until = time.time() + 60
    while time.time() < until and not any(r.finished for r in out):
        time.sleep(0.5)
    time.sleep(3)
    q.stop()
    assert [r.finished for r in out] == [False, True] and out[0].waiting_for == ["time"]
    assert out[1].n == 380 and out[1].rotation is None and out[1].status in ("LOW_HEADING_CONFIDENCE", "MAG_DISTURBED")


def test_calibration_keeps_the_first_samples(spark, tmp_path, rocks):
    got = run(spark, finish_at(drive(spark, drive_s=10.0), 601), tmp_path, lambda df: calibrate(df, retain=100), "update", "device")
    assert (got[-1].n, got[-1].rejected) == (100, 501) and got[-1].finished
    assert final(np.zeros((0, 14)))["status"] == "FAILED"


def test_collected_sessions_have_the_estimate_of_all_samples(spark, tmp_path, rocks):
    rows = drive(spark)
    schema, out = rows.schema, str(tmp_path / "out")

    def go(df):
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        src = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        q = collect(src).writeStream.outputMode("update").foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(f"{out}/trigger={i}")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()

    empty = rows.limit(1).withColumns({"device": F.lit("none"), "finish": F.lit(True)})
    open_ = rows.where("i < 50").withColumn("device", F.lit("open"))
    go(rows.where("i < 1500").unionByName(open_))
    go(finish_at(rows.where("i >= 1500"), 2801).unionByName(empty))
    go(finish_at(rows.where("i < 40"), 40))
    got = {r.device: r for r in estimates(spark.read.parquet(out)).collect()}
    r, batch = got["d"], calibrate_batch(rows).first()
    assert set(got) == {"d", "none"} and r.finished and (r.n, r.rejected, r.status) == (2800, 1 + 40, batch.status) and r.gravity_method == batch.gravity_method
    assert r.lag_s == pytest.approx(batch.lag_s) and r.confidence == pytest.approx(batch.confidence, abs=1e-6) and r.correlation == pytest.approx(batch.correlation, abs=1e-6)
    assert r.rotation == pytest.approx(batch.rotation, abs=1e-6)
    assert (got["none"].status, got["none"].n, got["none"].confidence, got["none"].gravity_method, got["none"].rotation) == ("FAILED", 0, 0.0, "unavailable", None)


def test_a_session_of_more_samples_than_a_state_retains(spark, tmp_path):
    i, n = F.col("id"), 61_000
    e = spark.range(n).select(i.alias("event_id"), F.timestamp_micros(1_700_000_000_000_000 + i * 1_000_000).cast("timestamp_ntz").alias("ts"), F.lit(1).cast("long").alias("user_id"), F.lit("view").alias("event_type"), (50 + 40 * F.sin(i / 9)).alias("value"))
    e.write.parquet(str(tmp_path / "events.parquet"))
    got = scan_queries.calibration_stream(spark, str(tmp_path)).collect()
    assert [(r.k, r.n) for r in got] == [("view", n)]
