"""Mounting alignment: which way a phone's axes lie in a vehicle, from gravity and from how horizontal acceleration follows the rate of a speed.

`alignment` works on recordings of any length: gravity, field and checks are aggregations, smoothing is windows of blocks, and the search over lags adds up moments of blocks (lags). `estimate` does the same for the bounded buffer of a
streaming calibration, in memory.

status: LOW_GRAVITY_CONFIDENCE (no vertical), INSUFFICIENT_MOTION (a vertical, too little driving), LOW_HEADING_CONFIDENCE (no direction that the data supports), MAG_DISTURBED (the same, and the field couldn't stand in),
SUCCESS (a rotation), FAILED (nothing to work on); a calibration is NOT_STARTED or COLLECTING before.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import params as P
from ..functions import vectors as V
from . import asof, evaluation, frames, lags, ordered
from .store import Tables
from .timeline import _key

MIN_GRAVITY_CONFIDENCE = 0.2
STATUSES = ("NOT_STARTED", "COLLECTING", "INSUFFICIENT_MOTION", "LOW_GRAVITY_CONFIDENCE", "LOW_HEADING_CONFIDENCE", "MAG_DISTURBED", "SUCCESS", "FAILED")


def _xyz(prefix: str) -> list[str]:
    return [f"{prefix}_{a}" for a in "xyz"]


def alignment(
    df: DataFrame, key, t: str, order: list[str], accel: str = "accel", speed: str = "speed", gravity: str | None = None, gyro: str | None = None, mag: str | None = None, valid: str | None = None, yaw_rate: str | None = None,
    max_lag_s: float = P.MAX_LAG_SEARCH_S, block_s: float = lags.BLOCK_S,
) -> DataFrame:
    """A row per key: status, the rotation (vehicle from phone, nine numbers row by row; null unless SUCCESS), roll, pitch and yaw in degrees, confidence, and the evidence behind them.

    Roll and pitch come from gravity alone and are there whenever it is. Where mag is given, a field that can't be trusted turns a failed heading into MAG_DISTURBED. Vectors are columns prefix_x, _y and _z; null or NaN is unknown.
    """
    k = _key(key)
    tables = Tables(df.sparkSession, "alignment")
    triples = [p for p in (accel, gravity, gyro, mag) if p]
    rows = df.select(*k, t, *order, *[V.clean(F.col(c)).alias(c) for p in triples for c in _xyz(p)], V.clean(F.col(speed)).alias("speed"), (F.col(valid) if valid else F.lit(True)).alias("valid"), (V.clean(F.col(yaw_rate)) if yaw_rate else F.lit(None).cast("double")).alias("yaw_rate"))
    g, _ = tables.keep(frames.gravity_estimate(rows, key, accel, gravity, gyro))
    out = g
    if mag:
        down = g.where("up_x IS NOT NULL").select(*k, *[(-F.col(c)).alias(d) for c, d in zip(_xyz("up"), _xyz("down"), strict=True)])
        field = frames.magnetometer(rows.join(down, k, "left"), key, [t, *order], t, mag, "down").select(*k, F.col("weight").alias("mag_weight"), F.col("issues").alias("mag_issues"))
        out = out.join(field, k, "left").withColumn("mag_weight", F.coalesce("mag_weight", F.lit(0.0)))
    else:
        out = out.withColumn("mag_weight", F.lit(None).cast("double")).withColumn("mag_issues", F.lit(None).cast("int"))
    usable = g.where(F.col("gravity_confidence") >= MIN_GRAVITY_CONFIDENCE).select(*k, *_xyz("up"), "magnitude")
    up = V.vector("up")
    linear = V.subtract(V.vector(accel), V.scale(up, F.col("magnitude")))
    rows = rows.join(usable, k)
    rows = rows.select(*rows.columns, *[c.alias(n) for c, n in zip(linear, _xyz("linear"), strict=True)])
    along = V.dot(V.vector("linear"), up)
    rows = rows.select(*rows.columns, *[c.alias(n) for c, n in zip(V.subtract(V.vector("linear"), V.scale(up, along)), _xyz("flat"), strict=True)])
    rows = ordered.central_difference(rows, key, [t, *order], t, "speed", "rate")
    names = {"hx": "flat_x", "hy": "flat_y", "hz": "flat_z", "hr": "rate"}
    smooth = ordered.trailing_many(rows, key, order, t, names, P.SMOOTHING_WINDOW_S)
    base = F.col("hx_mean").isNotNull() & F.col("speed").isNotNull() & (F.col("speed") >= P.MIN_HEADING_SPEED_MPS) & F.coalesce("valid", F.lit(False))
    h = ["hx_mean", "hy_mean", "hz_mean"]
    smooth, at = tables.keep(smooth.select(*k, t, *order, *h, F.col("hr_mean").alias("rate"), base.alias("base"), *_xyz("up")))
    best = _direction(lags.heading_moments(smooth, key, t, order, h, "rate", "base", max_lag_s, block_s=block_s), usable, key)
    best, _ = tables.keep(best)
    found = best.join(_halves(smooth, best, key, t, order, h), k, "left")
    enough = F.coalesce(F.col("dynamic_n") >= P.MIN_FORWARD_SAMPLES, F.lit(False))
    found = found.withColumn("forward_confidence", F.when(F.col("forward_x").isNull(), 0.0).otherwise(frames.forward_confidence(F.col("correlation"), F.col("dynamic_n"), F.col("disagreement_rad"))))
    totals = df.groupBy(*k).agg(F.count("*").alias("n"), F.count(V.clean(F.col(speed))).alias("__speeds"))
    out = totals.join(out, k).join(found, k, "left")
    has_up, has_forward = F.col("gravity_confidence") >= MIN_GRAVITY_CONFIDENCE, F.coalesce(F.col("forward_confidence"), F.lit(0.0)) > 0
    # Each step is a column of its own, as nested ones would outgrow what can be compiled.
    name = lambda df, v, n: df.select(*df.columns, *[c.alias(x) for c, x in zip(v, _xyz(n), strict=True)])
    out = name(out, V.cross(up, V.vector("forward")), "left")
    hint = tuple(F.when(F.abs("up_x") < 0.9, F.lit(a)).otherwise(F.lit(b)) for a, b in ((1.0, 0.0), (0.0, 1.0), (0.0, 0.0)))
    out = name(out, hint, "hint")
    out = name(out.withColumn("__along", V.dot(V.vector("hint"), up)), V.subtract(V.vector("hint"), V.scale(up, F.col("__along"))), "held")
    out = name(out, V.unit(V.vector("held")), "ahead")
    out = name(out, V.cross(up, V.vector("ahead")), "aside")
    residual = F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), V.dot(up, up)))))  # of gravity as the rotation turns it, from the vehicle's vertical
    out = out.withColumn("gravity_residual_deg", F.when(has_up & has_forward, residual))
    level = F.coalesce(F.col("gravity_residual_deg") <= P.MAX_GRAVITY_RESIDUAL_DEG, F.lit(False))
    moving = (F.col("n") >= P.MIN_FORWARD_SAMPLES) & (F.col("__speeds") > 0) & enough
    status = F.when(~has_up, "LOW_GRAVITY_CONFIDENCE").when(~moving, "INSUFFICIENT_MOTION").when(has_forward & level, "SUCCESS").when(~has_forward & (F.col("mag_weight") <= 0), "MAG_DISTURBED").otherwise("LOW_HEADING_CONFIDENCE")
    out = out.withColumn("status", status)
    done = F.col("status") == "SUCCESS"
    flat = lambda *rows: F.array(*[F.col(c) for p in rows for c in _xyz(p)])
    out = out.withColumn("rotation", F.when(done, flat("forward", "left", "up"))).withColumn("__pose", F.when(has_up, F.coalesce("rotation", flat("ahead", "aside", "up"))))
    m = F.col("__pose")
    roll, pitch, yaw = F.degrees(F.atan2(m[7], m[8])), F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), -m[6])))), F.degrees(F.atan2(m[3], m[0]))
    scale = frames.residual_factor(F.col("gravity_residual_deg"))
    confidence = F.when(has_up & has_forward, F.col("gravity_confidence") * F.col("forward_confidence") * scale).otherwise(0.0)
    out = out.select(
        *k, "status", "rotation", roll.alias("roll_deg"), pitch.alias("pitch_deg"), F.when(done, yaw).alias("yaw_deg"), confidence.alias("confidence"), "gravity_method", "gravity_confidence", "gravity_n", "gravity_residual_deg",
        F.coalesce("forward_confidence", F.lit(0.0)).alias("forward_confidence"), "correlation", F.coalesce("lag_s", F.lit(0.0)).alias("lag_s"), "margin", F.coalesce("dynamic_n", F.lit(0)).cast("long").alias("dynamic_n"), "disagreement_rad", "reversed_fraction", "mag_weight", "mag_issues", "n",
    )
    out, _ = tables.keep(out)
    tables.drop(at)
    checked = rows.join(out.where("rotation IS NOT NULL").select(*k, "rotation"), k)
    return out.join(evaluation.alignment_checks(checked, key, order, t, "rotation", "linear", "speed", gyro, "yaw_rate" if yaw_rate else None), k, "left")


def _direction(moments: DataFrame, up: DataFrame, key) -> DataFrame:
    """(key, lag_s, margin, dynamic_n, correlation, forward): the direction of each lag in closed form, and the lag whose direction correlates best; lag 0 where the peak isn't distinct. Of equal peaks the first."""
    k = _key(key)
    m = moments.join(up.select(*k, *_xyz("up")), k)
    steps = lambda df, v, name: df.select(*df.columns, *[c.alias(n) for c, n in zip(v, _xyz(name), strict=True)])
    m = steps(m, V.unit(tuple(F.col(f"hs{a}") for a in "xyz")), "raw")
    m = m.withColumn("__along", V.dot(V.vector("raw"), V.vector("up")))
    m = steps(m, V.subtract(V.vector("raw"), V.scale(V.vector("up"), F.col("__along"))), "level")
    m = steps(m, tuple(F.when(F.col("n") >= P.MIN_FORWARD_SAMPLES, c) for c in V.unit(V.vector("level"))), "forward")
    f, n = V.vector("forward"), F.col("n")
    mean = V.dot(f, tuple(F.col(f"h{a}") for a in "xyz")) / n
    square = sum((f["xyz".index(a)] * f["xyz".index(b)] * F.col(f"h{a}{b}") * (1 if a == b else 2) for a, b in ("xx", "xy", "xz", "yy", "yz", "zz")), F.lit(0.0)) / n
    cross = V.dot(f, tuple(F.col(f"hs{a}") for a in "xyz")) / n
    m = m.withColumns({"__va": F.greatest(square - mean * mean, F.lit(0.0)), "__vs": F.greatest(F.col("ss") / n - (F.col("s") / n) ** 2, F.lit(0.0)), "__c": cross - mean * F.col("s") / n})
    varied = (F.sqrt("__va") >= P.MIN_VECTOR_NORM) & (F.sqrt("__vs") >= P.MIN_VECTOR_NORM) & (F.col("__va") >= lags.LEAST_SHARE * square) & (F.col("__vs") >= lags.LEAST_SHARE * F.col("ss") / n)
    m = m.withColumn("r", F.when(varied, F.col("__c") / F.sqrt(F.col("__va") * F.col("__vs"))))
    entry = F.struct("lag", F.col("n").cast("long").alias("n"), "r", *_xyz("forward"))
    top = F.max_by(entry, F.when(F.col("r").isNotNull(), F.struct("r", -F.col("lag"))))
    sums = m.groupBy(*k, *_xyz("up")).agg(top.alias("top"), F.median("r").alias("m"), F.max_by(entry, F.when(F.col("lag") == 0, 1)).alias("zero"))
    sums = sums.withColumn("margin", F.col("top.r") - F.col("m"))
    use = F.when(F.col("margin") >= P.MIN_LAG_PEAK_MARGIN, F.col("top")).otherwise(F.col("zero"))
    lag = F.coalesce(F.when(F.col("margin") >= P.MIN_LAG_PEAK_MARGIN, F.col("top.lag")), F.lit(0)) * P.LAG_SEARCH_STEP_S
    sums = sums.withColumn("e", use)
    return sums.select(*k, lag.alias("lag_s"), "margin", F.col("e.n").alias("dynamic_n"), F.col("e.r").alias("correlation"), *[F.col(f"e.{c}").alias(c) for c in _xyz("forward")])


def _halves(rows: DataFrame, best: DataFrame, key, t: str, order: list[str], h: list[str]) -> DataFrame:
    """(key, disagreement_rad, reversed_fraction) at each key's lag: the angle between the directions of the first and the second half of the rows that count, and the share of rows whose acceleration has the other sign."""
    k = _key(key)
    lag = best.select(*k, "lag_s", *_xyz("forward"))
    known = rows.join(best.select(*k, "lag_s"), k)
    read = asof.interpolate_many(rows.where("base").withColumnRenamed("rate", "own"), known.select(*k, t, *order, "rate", "lag_s"), key, t, order, {"far": "rate"}, F.col("lag_s"))
    read = read.join(lag, k).withColumn("s", F.when(F.col("lag_s") == 0, F.col("own")).otherwise(F.col("far"))).where(F.abs("s") >= P.MIN_LONGITUDINAL_ACCEL_MPS2)
    w = W.partitionBy(*k).orderBy(t, *order)
    every = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)  # in the same order, so that one window holds both
    read = read.withColumns({"i": F.row_number().over(w), "half": F.floor(F.count("*").over(every) / 2)})
    v = tuple(F.col(c) for c in h)
    ends = lambda early: tuple(F.sum(F.when((F.col("i") <= F.col("half")) == early, c * F.col("s"))) for c in v)
    turned = F.signum(V.dot(v, V.vector("forward"))) != F.signum("s")
    sums = read.groupBy(*k).agg(F.first("half").alias("half"), F.avg(turned.cast("double")).alias("reversed_fraction"), *[c.alias(f"{p}_{a}") for p, e in (("one", True), ("two", False)) for c, a in zip(ends(e), "xyz", strict=True)])
    cosine = V.dot(V.unit(V.vector("one")), V.unit(V.vector("two")))
    angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))
    return sums.select(*k, F.when((F.col("half") >= P.MIN_FORWARD_SAMPLES // 2) & cosine.isNotNull(), angle).alias("disagreement_rad"), "reversed_fraction")


# The same for a buffer in memory


def unit(v: np.ndarray) -> np.ndarray | None:
    n = float(np.linalg.norm(v))
    return v / n if np.isfinite(n) and n >= P.MIN_VECTOR_NORM else None


def _clamp(x: float) -> float:
    return float(min(1.0, max(0.0, x)))


def felt_gravity(accel: np.ndarray, channel: np.ndarray | None = None, gyro: np.ndarray | None = None) -> dict:
    """up, magnitude, method and confidence of a buffer, as frames.gravity_estimate has them."""
    none = {"up": None, "magnitude": float("nan"), "method": "unavailable", "confidence": 0.0}
    size = lambda v: np.linalg.norm(v, axis=1)
    method, rows = "accel_low_dynamic", None
    if channel is not None:
        good = channel[np.isfinite(channel).all(axis=1)]
        good = good[size(good) > P.MIN_VECTOR_NORM]
        if len(good) >= P.MIN_GRAVITY_SAMPLES:
            method, rows = "gravity_channel", good
    if rows is None:
        with np.errstate(invalid="ignore"):
            use = np.abs(size(accel) - P.STANDARD_GRAVITY_MPS2) <= P.LOW_DYNAMIC_ACCEL_TOLERANCE_MPS2
            if gyro is not None and np.isfinite(gyro).all(axis=1).any():
                use &= size(gyro) <= P.LOW_DYNAMIC_GYRO_TOLERANCE_RPS
        rows = accel[use]
    if len(rows) < P.MIN_GRAVITY_SAMPLES or (up := unit(rows.mean(axis=0))) is None:
        return none
    norms = size(rows)
    spread = np.sqrt(np.mean(np.arccos(np.clip(rows @ up / norms, -1.0, 1.0)) ** 2))
    error = abs(norms.mean() - P.STANDARD_GRAVITY_MPS2)
    trust = _clamp(1 - spread / P.MAX_DIRECTION_SPREAD_RAD) * _clamp(1 - error / (0.2 * P.STANDARD_GRAVITY_MPS2)) * (0.5 + 0.5 * _clamp(len(rows) / (10.0 * P.MIN_GRAVITY_SAMPLES)))
    return {"up": up, "magnitude": float(norms.mean()), "method": method, "confidence": trust}


def field_weight(mag: np.ndarray | None, t: np.ndarray, up: np.ndarray | None) -> float:
    """The trust in a buffer's field, as frames.magnetometer has it."""
    use = np.zeros(len(t), bool) if mag is None else np.isfinite(mag).all(axis=1)
    if use.sum() < 2:
        return 0.0
    v, at = mag[use], t[use]
    n = np.linalg.norm(v, axis=1)
    good, median = float(((n >= P.EARTH_FIELD_MIN_UT) & (n <= P.EARTH_FIELD_MAX_UT)).mean()), float(np.median(n))
    if not 0.5 * P.EARTH_FIELD_MIN_UT <= median <= 2 * P.EARTH_FIELD_MAX_UT:
        return 0.0
    u, dt = v / n[:, None], np.diff(at)
    turn = np.arccos(np.clip((u[1:] * u[:-1]).sum(axis=1), -1, 1))[dt > 0] / dt[dt > 0]
    cv = float(n.std() / n.mean())
    issues = (good < P.GOOD_SAMPLE_FRACTION) + (len(turn) > 0 and turn.max() > P.MAX_DIRECTION_RATE_RPS) + (cv > P.MAX_MAGNITUDE_CV)
    if up is not None:
        dip = np.degrees(np.arccos(np.clip(u @ -up, -1, 1)))
        issues += np.percentile(dip, 95) - np.percentile(dip, 5) > P.MAX_DIP_VARIATION_DEG
    return 0.0 if issues >= 2 else 0.3 if issues == 1 else _clamp(good * max(0.0, 1 - cv / P.MAX_MAGNITUDE_CV))


def trailing_mean(x: np.ndarray, t: np.ndarray, seconds: float) -> np.ndarray:
    """Mean of the finite values of each column from t - seconds to the row, by position."""
    start = np.searchsorted(t, t - seconds - 1e-9, side="left")
    ok = np.isfinite(x)
    pad = lambda v: np.concatenate([np.zeros((1, *x.shape[1:])), np.cumsum(v, axis=0)])
    total, count = pad(np.where(ok, x, 0.0)), pad(ok)
    i = np.arange(1, len(t) + 1)
    n = count[i] - count[start]
    return np.where(n > 0, (total[i] - total[start]) / np.maximum(n, 1), np.nan)


def pearson(a: np.ndarray, b: np.ndarray) -> float:
    ok = np.isfinite(a) & np.isfinite(b)
    a, b = a[ok], b[ok]
    if len(a) < 2 or a.std() < P.MIN_VECTOR_NORM or b.std() < P.MIN_VECTOR_NORM:
        return float("nan")
    return float(np.corrcoef(a, b)[0, 1])


def speed_rate(speed: np.ndarray, t: np.ndarray) -> np.ndarray:
    out = np.full(len(t), np.nan)
    span = t[2:] - t[:-2]
    good = span > 0
    out[1:-1][good] = (speed[2:] - speed[:-2])[good] / span[good]
    return out


class Heading:
    """Horizontal acceleration against the rate of a speed, both smoothed, for one buffer: which way is forward, at which lag."""

    def __init__(self, t: np.ndarray, linear: np.ndarray, up: np.ndarray, speed: np.ndarray, valid: np.ndarray | None = None):
        self.t, self.up = t, up
        self.h = trailing_mean(linear - np.outer(linear @ up, up), t, P.SMOOTHING_WINDOW_S)
        self.s = trailing_mean(speed_rate(speed, t), t, P.SMOOTHING_WINDOW_S)
        with np.errstate(invalid="ignore"):
            self.base = np.isfinite(self.h).all(axis=1) & np.isfinite(speed) & (speed >= P.MIN_HEADING_SPEED_MPS)
        if valid is not None:
            self.base &= valid

    def shifted(self, lag: float) -> np.ndarray:
        if lag == 0:
            return self.s
        ok = np.isfinite(self.s)
        if ok.sum() < 2:
            return np.full(len(self.t), np.nan)
        at = np.round(self.t + lag, 6)  # to the microsecond, so that a sum of decimals meets the row it stands for
        return np.interp(at, self.t[ok], self.s[ok], left=np.nan, right=np.nan)

    def at(self, lag: float) -> tuple[np.ndarray | None, float, np.ndarray]:
        """Direction, correlation and the rows that count at a lag."""
        s = self.shifted(lag)
        with np.errstate(invalid="ignore"):
            use = self.base & np.isfinite(s) & (np.abs(s) >= P.MIN_LONGITUDINAL_ACCEL_MPS2)
        f = unit(s[use] @ self.h[use]) if use.sum() >= P.MIN_FORWARD_SAMPLES else None
        f = None if f is None else unit(f - (f @ self.up) * self.up)
        return f, float("nan") if f is None else pearson(self.h[use] @ f, s[use]), use

    def search(self, max_lag: float) -> tuple[float, float]:
        """(lag, margin over the median of all lags); no lag where the peak isn't distinct. Of equal peaks the first."""
        k = int(max_lag / P.LAG_SEARCH_STEP_S)
        scores = np.array([self.at(j * P.LAG_SEARCH_STEP_S)[1] for j in range(-k, k + 1)])
        if not np.isfinite(scores).any():
            return 0.0, float("nan")
        best = int(np.nanargmax(scores))
        margin = float(scores[best] - np.nanmedian(scores))
        return ((best - k) * P.LAG_SEARCH_STEP_S if margin >= P.MIN_LAG_PEAK_MARGIN else 0.0), margin

    def halves(self, lag: float, use: np.ndarray) -> float:
        """Angle between the directions of the first and the second half of the rows that count; not a number where they are too few."""
        h, s, half = self.h[use], self.shifted(lag)[use], int(use.sum()) // 2
        if half < P.MIN_FORWARD_SAMPLES // 2:
            return float("nan")
        one, two = unit(s[:half] @ h[:half]), unit(s[half:] @ h[half:])
        return float("nan") if one is None or two is None else float(np.arccos(np.clip(one @ two, -1.0, 1.0)))


def estimate(t: np.ndarray, accel: np.ndarray, speed: np.ndarray, max_lag: float = P.MAX_LAG_SEARCH_S, valid: np.ndarray | None = None, gravity: np.ndarray | None = None, gyro: np.ndarray | None = None, mag: np.ndarray | None = None, assess_field: bool = False) -> dict:
    """status, rotation, confidence, correlation, lag_s, margin, dynamic_n and gravity_method of a buffer in the order of time; assess_field: a field that is missing or disturbed shows in the status."""
    nan = float("nan")
    g = felt_gravity(accel, gravity, gyro)
    out = {"status": "LOW_GRAVITY_CONFIDENCE", "rotation": None, "confidence": 0.0, "correlation": nan, "lag_s": 0.0, "margin": nan, "dynamic_n": 0, "gravity_method": g["method"], "gravity_confidence": g["confidence"], "gravity_residual_deg": nan, "disagreement_rad": nan}
    if g["up"] is None or g["confidence"] < MIN_GRAVITY_CONFIDENCE:
        return out
    up = g["up"]
    out["status"] = "INSUFFICIENT_MOTION"
    if len(t) < P.MIN_FORWARD_SAMPLES or not np.isfinite(speed).any():
        return out
    heading = Heading(t, accel - up * g["magnitude"], up, speed, valid)
    lag, margin = heading.search(max_lag)
    f, c, use = heading.at(lag)
    out |= {"lag_s": lag, "margin": margin, "dynamic_n": int(use.sum()), "correlation": c}
    if use.sum() < P.MIN_FORWARD_SAMPLES:
        return out
    forward = 0.0
    if f is not None and np.isfinite(c):
        gap = out["disagreement_rad"] = heading.halves(lag, use)
        agreement = 0.5 if np.isnan(gap) else _clamp(1 - gap / P.MAX_SPLIT_HALF_DISAGREEMENT_RAD)
        forward = _clamp((c - P.MIN_FORWARD_CORRELATION) / (1 - P.MIN_FORWARD_CORRELATION)) * (0.4 + 0.6 * _clamp(use.sum() / (5.0 * P.MIN_FORWARD_SAMPLES))) * (0.3 + 0.7 * agreement)
    if forward <= 0:
        disturbed = assess_field and field_weight(mag, t, up) <= 0
        return out | {"status": "MAG_DISTURBED" if disturbed else "LOW_HEADING_CONFIDENCE"}
    r = np.array([f, np.cross(up, f), up])
    residual = float(np.degrees(np.arccos(np.clip((r @ up)[2], -1.0, 1.0))))
    return out | {"status": "SUCCESS", "rotation": r, "confidence": g["confidence"] * forward * max(0.0, 1 - residual / P.MAX_GRAVITY_RESIDUAL_DEG), "gravity_residual_deg": residual}
