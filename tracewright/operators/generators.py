"""Synthetic recordings with known truth, as DataFrames of expressions. Noise comes from hashes, so it doesn't depend on partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import quaternions as Q
from ..functions import vectors as V
from ..params import STANDARD_GRAVITY_MPS2

SWEEP_DEG = (0.0, 15.0, 30.0, 45.0, 90.0)


def noise(seed: int, *on: Column) -> Column:
    """A standard normal number from a hash of the columns (Box-Muller)."""
    u = lambda k: (F.pmod(F.xxhash64(F.lit(seed), F.lit(k), *on), F.lit(1 << 40)) + 1).cast("double") / float((1 << 40) + 1)
    return F.sqrt(-2.0 * F.log(u(1))) * F.cos(2.0 * 3.141592653589793 * u(2))


def clock(spark: SparkSession, segment: str, duration_s: float, rate_hz: float, jitter_s: float = 0.0, seed: int = 0) -> DataFrame:
    """(segment_id, i, t_s): samples in time order; jitter below half a step keeps them strictly increasing."""
    rows = spark.range(int(round(duration_s * rate_hz)) + 1).select(F.lit(segment).alias("segment_id"), F.col("id").alias("i"))
    wobble = F.greatest(F.lit(-0.45 / rate_hz), F.least(F.lit(0.45 / rate_hz), noise(seed, F.col("i")) * jitter_s))
    return rows.withColumn("t_s", F.col("i") / F.lit(float(rate_hz)) + (F.when(F.col("i") > 0, wobble).otherwise(0.0) if jitter_s else F.lit(0.0)))


def trajectory(times: DataFrame, accel=(0.0, 0.0, 0.0), v0=(0.0, 0.0, 0.0), p0=(0.0, 0.0, 0.0), q0=(0.0, 0.0, 0.0, 1.0), body_rate=(0.0, 0.0, 0.0), accel_bias=(0.0, 0.0, 0.0), gyro_bias=(0.0, 0.0, 0.0), sigma: float = 0.0, seed: int = 0, gravity: float = STANDARD_GRAVITY_MPS2) -> DataFrame:
    """What a perfect unit would measure under a constant acceleration and body rate, with the truth (true_v, true_p, true_q) beside it."""
    t = F.col("t_s")
    a, w = V.constant(*accel), V.constant(*body_rate)
    speed = sum(x * x for x in body_rate) ** 0.5
    start = tuple(F.lit(float(x)) for x in q0)
    turn = Q.from_axis_angle(w, t * speed) if speed else Q.identity()
    q = Q.multiply(start, turn)
    up = V.constant(0.0, 0.0, gravity)
    force = Q.rotate(Q.conjugate(q), V.add(a, up))
    dirty = lambda v, bias, k: [c + float(b) + (noise(seed + k + j, F.col("i")) * sigma if sigma else F.lit(0.0)) for j, (c, b) in enumerate(zip(v, bias, strict=True))]
    named = lambda v, n, axes="xyz": [c.alias(f"{n}_{x}") for c, x in zip(v, axes, strict=True)]
    return times.select(
        "*", *named(dirty(force, accel_bias, 10), "force"), *named(dirty(w, gyro_bias, 20), "gyro"), *named(q, "q", "xyzw"), *[F.lit(float(x)).alias(f"v0_{c}") for x, c in zip(v0, "xyz", strict=True)],
        *[(F.lit(float(v)) + x * t).alias(f"true_v_{c}") for v, x, c in zip(v0, a, "xyz", strict=True)],
        *[(F.lit(float(p)) + float(v) * t + x * t * t / 2).alias(f"true_p_{c}") for p, v, x, c in zip(p0, v0, a, "xyz", strict=True)],
    )


def stationary(spark: SparkSession, duration_s: float = 20.0, rate_hz: float = 50.0) -> DataFrame:
    return trajectory(clock(spark, "stationary", duration_s, rate_hz))


def constant_acceleration(spark: SparkSession, value: float = 1.5, duration_s: float = 10.0, rate_hz: float = 50.0) -> DataFrame:
    return trajectory(clock(spark, "constant_acceleration", duration_s, rate_hz), accel=(value, 0.0, 0.0))


def constant_velocity(spark: SparkSession, speed: float = 12.0, duration_s: float = 10.0, rate_hz: float = 50.0) -> DataFrame:
    return trajectory(clock(spark, "constant_velocity", duration_s, rate_hz), v0=(speed, 0.0, 0.0))


def pure_rotation(spark: SparkSession, rate: float = 0.3, duration_s: float = 10.0, rate_hz: float = 50.0) -> DataFrame:
    return trajectory(clock(spark, "pure_rotation", duration_s, rate_hz), body_rate=(0.0, 0.0, rate))


def irregular(spark: SparkSession, duration_s: float = 10.0, rate_hz: float = 50.0, jitter_s: float = 0.004, seed: int = 3) -> DataFrame:
    return trajectory(clock(spark, "irregular", duration_s, rate_hz, jitter_s, seed), accel=(0.5, -0.2, 0.0), v0=(1.0, 2.0, 0.0))


def tilted(spark: SparkSession, duration_s: float = 10.0, rate_hz: float = 50.0) -> DataFrame:
    return trajectory(clock(spark, "tilted", duration_s, rate_hz), accel=(0.3, 0.4, 0.1), q0=(0.2, -0.1, 0.3, (1 - 0.14) ** 0.5))


FIXTURES = (stationary, constant_acceleration, constant_velocity, pure_rotation, irregular, tilted)


def rotation_sweep(spark: SparkSession, axis=(0.0, 0.0, 1.0), angles=SWEEP_DEG) -> DataFrame:
    """(angle_deg, q_x .. q_w)."""
    rows = spark.createDataFrame([(float(a),) for a in angles], "angle_deg double")
    q = Q.from_axis_angle(V.constant(*axis), F.radians("angle_deg"))
    return rows.select("angle_deg", *[c.alias(f"q_{n}") for c, n in zip(q, "xyzw", strict=True)])


def retimed(stamps: DataFrame, **made: object) -> DataFrame:
    """A trajectory made anew on other stamps (segment_id, i, t_s) from the arguments it was made with: readings and truth belong to the new times, where the disturbances below keep those of the old ones."""
    return trajectory(stamps, **made)


def with_duplicate_times(df: DataFrame, count: int, step: float) -> DataFrame:
    """The first `count` odd samples take the time of the sample before them."""
    return df.withColumn("t_s", F.when((F.col("i") % 2 == 1) & (F.col("i") < 2 * count), F.col("t_s") - step).otherwise(F.col("t_s")))


def with_gap(df: DataFrame, at_s: float, gap_s: float) -> DataFrame:
    return df.withColumn("t_s", F.when(F.col("t_s") >= at_s, F.col("t_s") + gap_s).otherwise(F.col("t_s")))


def corrupted(df: DataFrame, every: int, value: float = float("nan")) -> DataFrame:
    return df.withColumn("force_x", F.when((F.col("i") % every == every - 1), F.lit(value)).otherwise(F.col("force_x")))


def drive(spark: SparkSession, segment: str = "drive", q_vehicle_phone=(0.0, 0.0, 0.0, 1.0), rate_hz: float = 20.0, rest_s: float = 20.0, drive_s: float = 120.0, cruise: float = 15.0, jitter_s: float = 0.0, sigma: float = 0.0, field_ut: float = 48.0, seed: int = 1) -> DataFrame:
    """A car at rest, then speeding up and slowing down again and again along one line, measured by a phone with a known mounting: accel, gyro, mag and gravity in phone axes, speed, and the truth."""
    t = F.col("t_s")
    rows = clock(spark, segment, rest_s + drive_s, rate_hz, jitter_s, seed)
    phase = (t - rest_s) * (2 * 3.141592653589793 / 20.0)
    moving = t > rest_s
    speed = F.when(moving, cruise * 0.5 * (1.0 - F.cos(phase)) + 0.0).otherwise(0.0)
    along = F.when(moving, cruise * 0.5 * F.sin(phase) * (2 * 3.141592653589793 / 20.0)).otherwise(0.0)
    zero = F.lit(0.0)
    back = Q.conjugate(tuple(F.lit(float(x)) for x in q_vehicle_phone))
    to_phone = lambda v: Q.rotate(back, v)
    dirty = lambda v, k: [c + (noise(seed + k + j, F.col("i")) * sigma if sigma else zero) for j, c in enumerate(v)]
    named = lambda v, n: [c.alias(f"{n}_{x}") for c, x in zip(v, "xyz", strict=True)]
    g = F.lit(STANDARD_GRAVITY_MPS2)
    return rows.select(
        "segment_id", "i", "t_s", speed.alias("speed"), *named(dirty(to_phone((along, zero, g)), 30), "accel"), *named(dirty((zero, zero, zero), 40), "gyro"),
        *named(dirty(to_phone((F.lit(0.6 * field_ut), zero, F.lit(-0.8 * field_ut))), 50), "mag"), *named(to_phone((zero, zero, g)), "gravity"),
    )


def disturbed_magnetometer(df: DataFrame, offset=(30.0, 0.0, 0.0)) -> DataFrame:
    return df.withColumns({f"mag_{c}": F.col(f"mag_{c}") + float(o) for c, o in zip("xyz", offset, strict=True)})
