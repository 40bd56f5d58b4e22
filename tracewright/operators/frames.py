"""Directions, biases and confidences of sensor axes, as aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import params as P
from ..functions import flags as FL
from ..functions import vectors as V
from .asof import guarded_corr
from .timeline import US, _key


def _clamp(c: Column) -> Column:
    return F.when(c.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)))  # the two functions skip nulls


def gravity_direction(df: DataFrame, key, prefix: str, where: Column | None = None, least: int = P.MIN_GRAVITY_SAMPLES) -> DataFrame:
    """A row per key: down (the negated mean direction of what is felt at rest), its spread, the mean norm less g, n and confidence.

    The confidence is a product: 1 - spread / MAX_DIRECTION_SPREAD_RAD, 1 - |norm error| / (0.2 g), and half to all by n up to 10 * least.

    Two aggregations; the mean direction is joined back in between, by key, so both share one partitioning.
    """
    k, v = _key(key), V.vector(prefix)
    rows = df.where(V.all_finite(*v) & (F.lit(True) if where is None else where)).select(*k, *[c.alias(a) for c, a in zip(v, "xyz", strict=True)])
    means = rows.groupBy(*k).agg(*[F.avg(a).alias(f"m{a}") for a in "xyz"], F.count("*").alias("n"))
    m = V.unit(tuple(F.col(f"m{a}") for a in "xyz"))
    means = means.select(*k, "n", *[(-c).alias(f"down_{a}") for c, a in zip(m, "xyz", strict=True)])
    down = V.vector("down")
    own = tuple(F.col(a) for a in "xyz")
    off = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), -V.dot(V.unit(own), down))))
    spread = rows.join(means, k).groupBy(*k).agg(F.sqrt(F.avg(off * off)).alias("spread_rad"), (F.avg(V.norm(own)) - P.STANDARD_GRAVITY_MPS2).alias("magnitude_error"))
    out = means.join(spread, k)
    consistency, magnitude = _clamp(1.0 - F.col("spread_rad") / P.MAX_DIRECTION_SPREAD_RAD), _clamp(1.0 - F.abs("magnitude_error") / (0.2 * P.STANDARD_GRAVITY_MPS2))
    support = _clamp(F.col("n") / (10.0 * least))
    return out.withColumn("confidence", F.when(F.col("n") >= least, consistency * magnitude * (0.5 + 0.5 * support)).otherwise(0.0))


def gravity_estimate(df: DataFrame, key, accel: str, channel: str | None = None, gyro: str | None = None, least: int = P.MIN_GRAVITY_SAMPLES) -> DataFrame:
    """A row per key: up (unit, as felt at rest), magnitude (mean norm), spread_rad, gravity_n, candidates, gravity_confidence and gravity_method.

    The gravity channel counts first, where `least` of its rows or more are finite and not zero (method gravity_channel); else the acceleration's mean over rows of low dynamics, of slow rotation where the key has
    any rates (accel_low_dynamic); else there is no direction (unavailable) and no confidence. Both means come from one pass; the spread about the chosen one takes a second.
    """
    k, a = _key(key), V.vector(accel)
    c = V.vector(channel) if channel else None
    g = V.vector(gyro) if gyro else None
    by_channel = V.all_finite(*c) & (V.norm(c) > P.MIN_VECTOR_NORM) if c else F.lit(False)
    has_rate = V.all_finite(*g) if g else F.lit(False)
    still = V.all_finite(*a) & (F.abs(V.norm(a) - P.STANDARD_GRAVITY_MPS2) <= P.LOW_DYNAMIC_ACCEL_TOLERANCE_MPS2)
    slow = still & has_rate & (V.norm(g) <= P.LOW_DYNAMIC_GYRO_TOLERANCE_RPS) if g else F.lit(False)
    zeros = tuple(F.lit(None).cast("double") for _ in "xyz")
    rows = df.select(
        *k, F.coalesce(by_channel, F.lit(False)).alias("c"), F.coalesce(still, F.lit(False)).alias("s"), F.coalesce(slow, F.lit(False)).alias("w"), has_rate.alias("r"),
        *[x.alias(f"c{n}") for x, n in zip(c or zeros, "xyz", strict=True)], *[x.alias(f"a{n}") for x, n in zip(a, "xyz", strict=True)],
    )
    mean = lambda m, p: [F.avg(F.when(F.col(m), F.col(f"{p}{n}"))).alias(f"{m}{n}_") for n in "xyz"]
    sums = rows.groupBy(*k).agg(F.count("*").alias("candidates"), *[F.count_if(m).alias(f"n_{m}") for m in "cswr"], *mean("c", "c"), *mean("s", "a"), *mean("w", "a"))
    use = F.when(F.col("n_c") >= least, "c").when(F.col("n_r") > 0, "w").otherwise("s")
    sums = sums.withColumn("use", use)
    pick = lambda f: F.when(F.col("use") == "c", f("c")).when(F.col("use") == "w", f("w")).otherwise(f("s"))
    sums = sums.select(*k, "candidates", "use", pick(lambda m: F.col(f"n_{m}")).alias("gravity_n"), *[pick(lambda m, n=n: F.col(f"{m}{n}_")).alias(n) for n in "xyz"])
    up = V.unit(tuple(F.col(n) for n in "xyz"))
    enough = F.col("gravity_n") >= least
    sums = sums.select(*k, "candidates", "use", "gravity_n", *[F.when(enough, u).alias(f"up_{n}") for u, n in zip(up, "xyz", strict=True)])
    met = rows.join(sums, k)
    chosen = F.when(F.col("use") == "c", F.col("c")).when(F.col("use") == "w", F.col("w")).otherwise(F.col("s"))
    own = [F.when(F.col("use") == "c", F.col(f"c{n}")).otherwise(F.col(f"a{n}")).alias(f"own_{n}") for n in "xyz"]
    met = met.where(chosen).select(*k, *own, "up_x", "up_y", "up_z")
    met = met.withColumn("size", V.norm(V.vector("own")))  # a column of its own, and so is the cosine
    met = met.withColumn("cosine", V.dot(V.vector("own"), V.vector("up")) / F.col("size"))
    off = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("cosine"))))
    spread = met.groupBy(*k).agg(F.sqrt(F.avg(off * off)).alias("spread_rad"), F.avg("size").alias("magnitude"))
    out = sums.join(spread, k, "left")
    have = F.col("up_x").isNotNull()
    consistency, size = _clamp(1.0 - F.col("spread_rad") / P.MAX_DIRECTION_SPREAD_RAD), _clamp(1.0 - F.abs(F.col("magnitude") - P.STANDARD_GRAVITY_MPS2) / (0.2 * P.STANDARD_GRAVITY_MPS2))
    confidence = F.when(have, consistency * size * (0.5 + 0.5 * _clamp(F.col("gravity_n") / (10.0 * least)))).otherwise(0.0)
    method = F.when(~have, "unavailable").when(F.col("use") == "c", "gravity_channel").otherwise("accel_low_dynamic")
    return out.select(*k, "up_x", "up_y", "up_z", F.when(have, F.col("magnitude")).alias("magnitude"), F.when(have, F.col("spread_rad")).alias("spread_rad"), "gravity_n", "candidates", confidence.alias("gravity_confidence"), method.alias("gravity_method"))


def magnetometer(df: DataFrame, key, order: list[str], t: str, prefix: str, down: str | None = None) -> DataFrame:
    """A row per key: share of plausible fields, variation, the direction's greatest rate, dip range, issue bits and weight.

    A median field of over twice the greatest or under half the least of the Earth's is another field, and has no weight.
    """
    k, v = _key(key), V.vector(prefix)
    rows = df.where(V.all_finite(*v)).withColumn("__n", V.norm(v))
    u = V.unit(v)
    rows = rows.select(*k, *order, t, "__n", *[c.alias(f"__u{a}") for c, a in zip(u, "xyz", strict=True)], *([F.col(f"{down}_{a}") for a in "xyz"] if down else []))
    w = W.partitionBy(*k).orderBy(*order)
    now = tuple(F.col(f"__u{a}") for a in "xyz")
    last = tuple(F.lag(f"__u{a}").over(w) for a in "xyz")
    dt = (F.col(t) - F.lag(t).over(w)) / US
    clip = lambda c: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c))
    rows = rows.withColumn("__rate", F.when(dt > 0, F.acos(clip(V.dot(now, last))) / dt))
    rows = rows.withColumn("__dip", F.degrees(F.acos(clip(V.dot(now, V.vector(down))))) if down else F.lit(None).cast("double"))
    good = (F.col("__n") >= P.EARTH_FIELD_MIN_UT) & (F.col("__n") <= P.EARTH_FIELD_MAX_UT)
    out = rows.groupBy(*k).agg(
        F.count("*").alias("n"), F.avg(good.cast("double")).alias("good_fraction"), (F.stddev_pop("__n") / F.avg("__n")).alias("cv"), F.median("__n").alias("median_ut"),
        F.max("__rate").alias("rate_max"), (F.percentile("__dip", F.lit(0.95)) - F.percentile("__dip", F.lit(0.05))).alias("dip_range_deg"),
    )
    bit = lambda c, b: F.when(F.coalesce(c, F.lit(False)), b).otherwise(0)
    f = FL.MAGNETOMETER
    issues = (
        bit(F.col("good_fraction") < P.GOOD_SAMPLE_FRACTION, f["MAGNITUDE_OUT_OF_RANGE"]) + bit(F.col("rate_max") > P.MAX_DIRECTION_RATE_RPS, f["ABRUPT_DIRECTION_CHANGE"])
        + bit(F.col("cv") > P.MAX_MAGNITUDE_CV, f["UNSTABLE_MAGNITUDE"]) + bit(F.col("dip_range_deg") > P.MAX_DIP_VARIATION_DEG, f["DIP_INCONSISTENT"]) + bit(F.col("n") < 2, f["UNUSABLE"])
    )
    out = out.withColumn("issues", issues.cast("int"))
    n_issues = F.bit_count("issues")
    unusable = FL.has(F.col("issues"), f["UNUSABLE"]) | ~F.coalesce(F.col("median_ut").between(0.5 * P.EARTH_FIELD_MIN_UT, 2.0 * P.EARTH_FIELD_MAX_UT), F.lit(False)) | (n_issues >= 2)
    weight = F.when(unusable, 0.0).when(n_issues == 1, 0.3).otherwise(F.col("good_fraction") * _clamp(1.0 - F.col("cv") / P.MAX_MAGNITUDE_CV))
    return out.withColumn("weight", weight)


def direction_fit(df: DataFrame, key, horizontal: str, rate: str, up: V.Vector | None = None, least: int = P.MIN_FORWARD_SAMPLES) -> DataFrame:
    """A row per key: the horizontal direction along which acceleration follows the rate of speed (sum of h * s), its correlation, and n; null below `least` samples."""
    k, h, s = _key(key), V.vector(horizontal), F.col(rate)
    up = up or V.constant(0, 0, 1)
    rows = df.where(V.all_finite(*h, s)).select(*k, *[c.alias(a) for c, a in zip(h, "xyz", strict=True)], s.alias("s"))
    sums = rows.groupBy(*k).agg(*[F.sum(F.col(a) * F.col("s")).alias(f"s{a}") for a in "xyz"], F.count("*").alias("n"))
    # Each step is a column of its own: nested, every use would copy the whole expression below it, and the aggregate's code would outgrow what can be compiled.
    steps = lambda df, v, name: df.select(*df.columns, *[c.alias(f"{name}{a}") for c, a in zip(v, "xyz", strict=True)])
    named = lambda name: tuple(F.col(f"{name}{a}") for a in "xyz")
    sums = steps(sums, V.unit(named("s")), "raw_")
    sums = sums.withColumn("along", V.dot(named("raw_"), up))
    sums = steps(sums, V.subtract(named("raw_"), V.scale(up, F.col("along"))), "flat_")
    sums = sums.select(*k, "n", *[F.when(F.col("n") >= least, c).alias(f"forward_{a}") for c, a in zip(V.unit(named("flat_")), "xyz", strict=True)])
    fits = rows.join(sums, k).groupBy(*k).agg(guarded_corr(V.dot(tuple(F.col(a) for a in "xyz"), V.vector("forward")), F.col("s")).alias("correlation"))
    return sums.join(fits, k)


def forward_confidence(correlation: Column, n: Column, disagreement_rad: Column, least: int = P.MIN_FORWARD_SAMPLES) -> Column:
    """0 without a correlation or for a negative one; a disagreement that wasn't measured counts as half."""
    strength = _clamp((correlation - P.MIN_FORWARD_CORRELATION) / (1.0 - P.MIN_FORWARD_CORRELATION))
    agreement = F.coalesce(_clamp(1.0 - disagreement_rad / P.MAX_SPLIT_HALF_DISAGREEMENT_RAD), F.lit(0.5))
    return F.when(correlation.isNull(), 0.0).otherwise(strength * (0.4 + 0.6 * _clamp(n / (5.0 * least))) * (0.3 + 0.7 * agreement))


def residual_factor(residual_deg: Column) -> Column:
    return F.greatest(F.lit(0.0), 1.0 - residual_deg / P.MAX_GRAVITY_RESIDUAL_DEG)


def rest_confidence(accel_std: Column, gyro: Column) -> Column:
    """Mean of the margins inside the rest limits; of the first alone where rotation isn't known."""
    a, g = _clamp(1.0 - accel_std / P.MAX_STATIONARY_ACCEL_STD_MPS2), _clamp(1.0 - gyro / P.MAX_STATIONARY_GYRO_RPS)
    return F.coalesce((a + g) / 2.0, a)


def yaw_offset(px: Column, py: Column, rx: Column, ry: Column, least: int = 3) -> Column:
    """Aggregate: the turn about the vertical that brings points p closest to r."""
    return F.when(F.count(px + py + rx + ry) >= least, F.atan2(F.sum(px * ry - py * rx), F.sum(px * rx + py * ry)))


def rmse(x: Column) -> Column:
    return F.sqrt(F.avg(x * x))


def error_summary(df: DataFrame, key, error: str, order: list[str]) -> DataFrame:
    """rmse, mean, greatest size and last value of an error, over rows that have one."""
    e = F.col(error)
    return df.groupBy(*_key(key)).agg(rmse(e).alias("rmse"), F.avg(e).alias("mean"), F.max(F.abs(e)).alias("max_abs"), F.max_by(e, F.when(e.isNotNull(), F.struct(*order))).alias("final"), F.count(e).alias("n"))


def drift(final: Column, duration_s: Column, distance: Column) -> dict[str, Column]:
    """Rates of a final error: per second, as an acceleration, and per distance beyond a metre."""
    return {"per_second": F.when(duration_s > 0, final / duration_s), "as_acceleration": F.when(duration_s > 0, 2.0 * final / (duration_s * duration_s)), "per_distance": F.when(distance > 1.0, final / distance)}


def choose_speed(df: DataFrame, key, primary: str, fallback: str, least_share: float = 0.05) -> DataFrame:
    """Adds speed and speed_source: the primary column if enough of a key's rows have it, else the fallback."""
    k = _key(key)
    share = df.groupBy(*k).agg(F.avg(F.col(primary).isNotNull().cast("double")).alias("__p"), F.avg(F.col(fallback).isNotNull().cast("double")).alias("__f"))
    rows = df.join(share, k)
    use = F.when(F.col("__p") > least_share, F.lit(primary)).when(F.col("__f") > least_share, F.lit(fallback))
    rows = rows.withColumn("speed_source", use)
    return rows.withColumn("speed", F.when(F.col("speed_source") == primary, F.col(primary)).when(F.col("speed_source") == fallback, F.col(fallback))).drop("__p", "__f")
