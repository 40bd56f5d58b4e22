"""Trajectories of segments whose attitudes are given: what a bias from rest takes off, how a segment starts, the strapdown sums with a flag for every step, and the states' frame.

With attitudes given, velocity and position are running sums of built-in expressions, so a segment needs no loop; sums run within blocks of time, and a scan over blocks links them, so no task holds a long segment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import params as P
from ..functions import flags as FL
from ..functions import quaternions as Q
from ..functions import rotations as R
from ..functions import vectors as V
from . import lags, ordered
from .timeline import US, _key

AXES = "xyz"


def resolve_alignment(rotation: Column, policy: str = "diagnostic") -> Column:
    """The rotation (vehicle from phone) that a segment is propagated with: null, for phone axes as a diagnostic, where there is none; under the policy `require` the query fails there, as identity would claim a mounting that nobody measured."""
    if policy not in ("require", "diagnostic"):
        raise ValueError(f"policy is require or diagnostic, not {policy}")
    return rotation if policy == "diagnostic" else F.coalesce(rotation, F.raise_error(F.lit("no rotation from phone to vehicle is available")).cast("array<double>"))


def navigation_from_vehicle(q: Q.Quaternion, alignment: R.FrameRotation) -> R.FrameRotation:
    """Navigation from vehicle, from an attitude (navigation from phone) and an alignment (vehicle from phone); frames are checked when the plan is made."""
    if alignment.to != "vehicle":
        raise ValueError(f"an alignment leads to the vehicle, not to {alignment.to}")
    return R.FrameRotation.from_quaternion(q, "navigation", "phone").compose(alignment.inverse())


def bias_from_longest_rest(df: DataFrame, key, order: list[str], t: str, rest: str, accel: str, up: str, gyro: str | None = None, gravity: float = P.STANDARD_GRAVITY_MPS2) -> DataFrame:
    """A row per key: gyro_bias (mean rate over the longest rest, with sigma, the sample deviation) and accel_bias, the excess over gravity along the given up direction; zeros where rest, samples or plausibility are missing.

    Only what lies along gravity can be told from a rest. The acceleration needs two finite samples, a rate one.
    """
    k = _key(key)
    span = ordered.longest_run(df, key, [t, *order], t, rest).select(*k, F.col("start_us").alias("__from"), F.col("end_us").alias("__to"))
    rows = df.join(span, k).where((F.col(t) >= F.col("__from")) & (F.col(t) <= F.col("__to")) & F.col(rest))
    a, u = V.vector(accel), V.vector(up)
    g = V.vector(gyro) if gyro else tuple(F.lit(None).cast("double") for _ in AXES)
    seen, turning = V.all_finite(*a), V.all_finite(*g)
    mean = lambda ok, c: F.avg(F.when(ok, c))
    sums = rows.groupBy(*k).agg(
        F.count_if(seen).alias("na"), F.count_if(turning).alias("ng"), *[mean(seen, c).alias(f"a{n}") for c, n in zip(a, AXES, strict=True)], *[mean(turning, c).alias(f"g{n}") for c, n in zip(g, AXES, strict=True)],
        *[F.stddev_samp(F.when(turning, c)).alias(f"gyro_sigma_{n}") for c, n in zip(g, AXES, strict=True)], *[F.first(c).alias(f"u{n}") for c, n in zip(u, AXES, strict=True)],
    )
    m, d, w = (tuple(F.col(f"{p}{n}") for n in AXES) for p in "aug")
    sums = sums.withColumn("__excess", V.dot(m, d) - gravity)
    fine = (F.col("na") >= 2) & d[0].isNotNull() & (F.abs("__excess") <= P.MAX_PLAUSIBLE_ACCEL_BIAS_MPS2)
    steady = (F.col("ng") >= 1) & (V.norm(w) <= P.MAX_PLAUSIBLE_GYRO_BIAS_RPS)
    zero = lambda ok, c: F.when(F.coalesce(ok, F.lit(False)), c).otherwise(0.0)
    found = sums.select(*k, "na", *[zero(steady, c).alias(f"gyro_bias_{n}") for c, n in zip(w, AXES, strict=True)], *[f"gyro_sigma_{n}" for n in AXES], *[zero(fine, c * F.col("__excess")).alias(f"accel_bias_{n}") for c, n in zip(d, AXES, strict=True)])
    every = df.select(*k).distinct().join(found, k, "left")
    return every.select(*k, F.coalesce("na", F.lit(0)).alias("rest_samples"), *[F.coalesce(f"{b}_bias_{n}", F.lit(0.0)).alias(f"{b}_bias_{n}") for b in ("gyro", "accel") for n in AXES], *[f"gyro_sigma_{n}" for n in AXES])


def median_step(df: DataFrame, key, order: list[str], t: str) -> DataFrame:
    """(key, median_s): the median of the positive steps."""
    w = W.partitionBy(*_key(key)).orderBy(t, *order)
    steps = df.where(F.col(t).isNotNull()).select(*_key(key), ((F.col(t) - F.lag(t).over(w)) / US).alias("s"))
    return steps.groupBy(*_key(key)).agg(F.median(F.when(F.col("s") > 0, F.col("s"))).alias("median_s"))


def propagate(df: DataFrame, key, order: list[str], t: str, force: str = "force", gyro: str | None = "gyro", attitude: str = "q", max_step_s: float = P.MAX_INTEGRATION_STEP_S, block_s: float = lags.BLOCK_S) -> DataFrame:
    """Adds v_*, p_* and flags to rows with attitudes, in the order of t and then of `order`.

    Columns that are there are used: v0_* (start velocity), accel_bias_* and gyro_bias_*, median_s (for irregular steps: over IRREGULAR_DT_FACTOR times the median or under its inverse), stationary, alignment_confidence (null: no
    alignment, as where the column is missing). Flags: 1 weak and 2 no alignment at integrated samples, 4 irregular, 8 time that doesn't advance, 16 too long a step, 32 a sensor that can't be, 64 at rest; the first sample has none. A step with 8, 16 or 32 holds velocity
    and position, and the sample after it uses its own acceleration for both ends. A segment whose gyroscope never gives a rate is judged by its force alone.

    A block of block_s knows the two rows before it, which its first steps need, and sums as if it started at rest; the sums of the blocks before it give the velocity and position that it starts with.
    """
    k, us = _key(key), int(round(block_s * US))
    have = lambda c: F.col(c) if c in df.columns else None
    bias = lambda p: tuple(F.coalesce(F.col(f"{p}_{a}"), F.lit(0.0)) if f"{p}_{a}" in df.columns else F.lit(0.0) for a in AXES)
    at = F.struct(t, *order)
    rows = df.where(F.col(t).isNotNull()).withColumns({"__k": F.struct(*k), "__b": F.floor(F.col(t) / us).cast("bigint")})  # keys in a struct are equal where both are null
    step = lambda df, v, name, axes=AXES: df.select(*df.columns, *[c.alias(f"{name}{a}") for c, a in zip(v, axes, strict=True)])
    rows = step(rows, V.subtract(tuple(V.clean(c) for c in V.vector(force)), bias("accel_bias")), "__f")
    rates = V.subtract(tuple(V.clean(c) for c in V.vector(gyro)), bias("gyro_bias")) if gyro else tuple(F.lit(None).cast("double") for _ in AXES)
    rows = step(rows, rates, "__w")
    f, rate = tuple(F.col(f"__f{a}") for a in AXES), tuple(F.col(f"__w{a}") for a in AXES)
    rows = step(rows, Q.rotate(Q.quaternion(attitude), f), "__a").withColumn("__az", F.col("__az") - P.STANDARD_GRAVITY_MPS2)
    rows = rows.join(rows.groupBy("__k").agg(F.count_if(V.all_finite(*rate)).alias("__rates")), "__k")
    sensed = V.plausible(f, P.MAX_PLAUSIBLE_SPECIFIC_FORCE_MPS2) & ((F.col("__rates") == 0) | V.plausible(rate, P.MAX_PLAUSIBLE_RATE_RPS))
    rows = rows.withColumn("__own", F.struct(F.col(t).alias("t"), F.coalesce(sensed, F.lit(False)).alias("s"), *[F.col(f"__a{a}").alias(a) for a in AXES]))
    rows = rows.repartition("__k", "__b")

    w = W.partitionBy("__k", "__b").orderBy(t, *order)
    upto = w.rowsBetween(W.unboundedPreceding, W.currentRow)
    blocks = W.partitionBy("__k").orderBy("__b")
    rows = rows.withColumns({"__l": F.lag("__own").over(w), "__ll": F.lag("__own", 2).over(w)})
    ends = rows.groupBy("__k", "__b").agg(F.max_by(F.struct("__own", "__l"), at).alias("__e"))
    rows = rows.join(ends.select("__k", "__b", F.lag("__e").over(blocks).alias("__p"), F.lag("__e", 2).over(blocks).alias("__pp")), ["__k", "__b"])
    earlier = F.when(F.col("__l").isNotNull(), F.col("__p.__own.t")).otherwise(F.coalesce("__p.__l.t", "__pp.__own.t"))
    rows = rows.withColumns({"__last": F.coalesce("__l", "__p.__own"), "__then": F.coalesce(F.col("__ll.t"), earlier)})
    first, was = F.col("__last").isNull(), (F.col("__last.t") - F.col("__then")) / US
    rows = rows.withColumn("__dt", (F.col(t) - F.col("__last.t")) / US)
    rows = rows.withColumn("__bad", F.when(first, 0).when(F.col("__dt") <= 0, 8).when(F.col("__dt") > max_step_s, 16).when(~F.col("__own.s"), 32).otherwise(0))
    rows = rows.withColumns({"__ok": ~first & (F.col("__bad") == 0), "__held": F.coalesce((was > 0) & (was <= max_step_s) & F.col("__last.s"), F.lit(False))})
    dv = lambda a: F.when(F.col("__ok"), 0.5 * (F.when(F.col("__held"), F.col(f"__last.{a}")).otherwise(F.col(f"__a{a}")) + F.col(f"__a{a}")) * F.col("__dt")).otherwise(0.0)
    running = lambda c: F.coalesce(F.sum(c).over(upto), F.lit(0.0))
    rows = rows.withColumns({f"__dv{a}": dv(a) for a in AXES})
    rows = rows.withColumns({f"__v{a}": running(F.col(f"__dv{a}")) for a in AXES} | {f"__s{a}": F.when(F.col("__ok") & F.col(f"__dv{a}").isNotNull(), F.col("__dt")).otherwise(0.0) for a in AXES})
    rows = rows.withColumns({f"__p{a}": running((F.col(f"__v{a}") - 0.5 * F.col(f"__dv{a}")) * F.col(f"__s{a}")) for a in AXES} | {f"__s{a}": running(F.col(f"__s{a}")) for a in AXES})

    start = [(F.col(f"v0_{a}") if f"v0_{a}" in df.columns else F.lit(0.0)).alias(a) for a in AXES]
    sums = rows.groupBy("__k", "__b").agg(F.min_by(F.struct(*start), at).alias("__v0"), F.max_by(F.struct(*[f"__{c}{a}" for c in "vps" for a in AXES]), at).alias("__e"))
    before = blocks.rowsBetween(W.unboundedPreceding, -1)
    total = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0.0))
    sums = sums.withColumns({f"__v0{a}": F.coalesce(F.first(f"__v0.{a}").over(blocks.rowsBetween(W.unboundedPreceding, W.currentRow)), F.lit(0.0)) + total(f"__e.__v{a}") for a in AXES})
    sums = sums.select("__k", "__b", *[f"__v0{a}" for a in AXES], *[total(F.col(f"__e.__p{a}") + F.col(f"__v0{a}") * F.col(f"__e.__s{a}")).alias(f"__p0{a}") for a in AXES])
    rows = rows.join(sums, ["__k", "__b"])
    rows = rows.withColumns({f"v_{a}": F.col(f"__v0{a}") + F.col(f"__v{a}") for a in AXES} | {f"p_{a}": F.col(f"__p0{a}") + F.col(f"__v0{a}") * F.col(f"__s{a}") + F.col(f"__p{a}") for a in AXES})
    n = FL.NAVIGATION
    timed = ~first & ~F.col("__bad").isin(8, 16)
    flags = F.col("__bad")
    if (m := have("median_s")) is not None:
        ratio = F.col("__dt") / m
        flags = FL.set_if(flags, F.coalesce(timed & (m > 0) & ((ratio > P.IRREGULAR_DT_FACTOR) | (ratio < 1.0 / P.IRREGULAR_DT_FACTOR)), F.lit(False)), n["IRREGULAR_DT"])
    if (rest := have("stationary")) is not None:
        flags = FL.set_if(flags, ~first & F.coalesce(rest, F.lit(False)), n["STATIONARY"])
    trust = have("alignment_confidence")
    flags = FL.set_if(flags, F.col("__ok") & (F.lit(True) if trust is None else trust.isNull()), n["ALIGNMENT_UNAVAILABLE"])
    if trust is not None:
        flags = FL.set_if(flags, F.col("__ok") & F.coalesce(trust < P.LOW_ALIGNMENT_CONFIDENCE, F.lit(False)), n["ALIGNMENT_LOW_CONFIDENCE"])
    return rows.select(*df.columns, *[f"{p}_{a}" for p in "vp" for a in AXES], flags.cast("int").alias("flags"))
