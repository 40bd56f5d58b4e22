"""Comparison of propagated tracks with a reference: error curves at a lag, their summaries and drift, and the evidence on how a segment starts.

A track has columns px, py, pz (metres, east, north and up) and vx, vy, vz; a reference has speed, heading_deg and e, n, u, any of which may be null
where it isn't valid. Both are read in one pass: a union and two ordered windows on the key, so no row is paired with another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import params as P
from ..functions import geodesy as G
from . import asof, frames, lags, ordered
from .timeline import US, _key

ERRORS = ("speed_error", "position_error", "horizontal_error", "heading_error_deg")


def heading_error(vx: Column, vy: Column, east: Column, north: Column) -> Column:
    """Course of the velocity less that of the reference's unit vector, in degrees from -180 on; null below MIN_HEADING_SPEED_MPS of horizontal speed."""
    course = lambda e, n: F.degrees(F.atan2(e, n))
    return F.when(F.sqrt(vx * vx + vy * vy) >= P.MIN_HEADING_SPEED_MPS, G.wrap_deg(course(vx, vy) - course(east, north)))


def error_curves(track: DataFrame, reference: DataFrame, key, t: str, order: list[str], lag_s: Column | float = 0.0, remove_yaw: bool = False) -> DataFrame:
    """Track rows with ERRORS and yaw_rad; the reference is read at t + lag_s, between its rows and never beyond them.

    lag_s may be a column of the reference, the same for all rows of a key. remove_yaw turns each track about the vertical to where it fits best, for tracks whose heading was never observed.
    """
    rad = F.radians("heading_deg")
    ref = reference.withColumn("__east", F.sin(rad)).withColumn("__north", F.cos(rad))  # the unit vector, since angles wrap
    names = {"__speed": "speed", "__he": "__east", "__hn": "__north", "__e": "e", "__n": "n", "__u": "u"}
    rows = asof.interpolate_many(track, ref, key, t, order, names, lag_s)
    k = _key(key)
    x, y, z = F.col("px"), F.col("py"), F.col("pz")
    if remove_yaw:
        rows = rows.join(rows.groupBy(*k).agg(frames.yaw_offset(x, y, F.col("__e"), F.col("__n")).alias("yaw_rad")), k)
        turned = G.rotate_about_z(x, y, F.coalesce("yaw_rad", F.lit(0.0)))
        rows = rows.withColumns({"__x": turned[0], "__y": turned[1]})
    else:
        rows = rows.withColumns({"yaw_rad": F.lit(None).cast("double"), "__x": x, "__y": y})
    flat = (F.col("__x") - F.col("__e")) ** 2 + (F.col("__y") - F.col("__n")) ** 2
    rows = rows.withColumn("speed_error", F.sqrt(F.col("vx") ** 2 + F.col("vy") ** 2 + F.col("vz") ** 2) - F.col("__speed")).withColumn("horizontal_error", F.sqrt(flat))
    rows = rows.withColumn("position_error", F.sqrt(flat + (z - F.col("__u")) ** 2)).withColumn("heading_error_deg", heading_error(F.col("vx"), F.col("vy"), F.col("__he"), F.col("__hn")))
    return rows.drop(*names, "__x", "__y")


def compare(curves: DataFrame, key, t: str, order: list[str]) -> DataFrame:
    """A row per key: rmse, mean, greatest size, last value and count of each error, duration, distance, and drift."""
    k, at = _key(key), F.struct(t, *order)
    aggs = []
    for e in ERRORS:
        c = F.col(e)
        aggs += [frames.rmse(c).alias(f"{e}_rmse"), F.avg(c).alias(f"{e}_mean"), F.max(F.abs(c)).alias(f"{e}_max"), F.max_by(c, F.when(c.isNotNull(), at)).alias(f"{e}_final"), F.count(c).alias(f"{e}_n")]
    out = curves.groupBy(*k).agg(((F.max(t) - F.min(t)) / US).alias("duration_s"), F.first("yaw_rad").alias("yaw_rad"), *aggs)
    length = ordered.path_length(curves, key, [t, *order], ["px", "py", "pz"]).select(*k, F.coalesce("distance", F.lit(0.0)).alias("distance"))
    out = out.join(length, k)
    d = frames.drift(F.col("horizontal_error_final"), F.col("duration_s"), F.col("distance"))
    return out.withColumns({f"drift_{n}": c for n, c in d.items()}).withColumn("drift_speed", F.when(F.col("duration_s") > 0, F.abs("speed_error_final") / F.col("duration_s")))


def begins_at_rest(df: DataFrame, key, order: list[str], t: str, mask: str, least_s: float = 1.0, within_s: float = P.START_REST_TOLERANCE_S) -> DataFrame:
    """A row per key: whether its longest stretch at rest lasts least_s and starts within within_s of the first row, since a trailing window has to fill first."""
    k = _key(key)
    spans = ordered.longest_run(df, key, order, t, mask).select(*k, F.col("start_us").alias("__start"), F.col("duration_s").alias("rest_s"))
    starts = df.groupBy(*k).agg(F.min(t).alias("__first"))
    rows = starts.join(spans, k, "left")
    good = (F.col("rest_s") >= least_s) & ((F.col("__start") - F.col("__first")) / US <= within_s)
    return rows.select(*k, "rest_s", F.coalesce(good, F.lit(False)).alias("begins_at_rest"))


def initial_heading(fx: Column, fy: Column) -> tuple[Column, Column]:
    """The horizontal unit vector of a forward axis in navigation axes; east where it is vertical."""
    n = F.sqrt(fx * fx + fy * fy)
    flat = F.coalesce(n >= 1e-9, F.lit(False))
    return F.when(flat, fx / n).otherwise(1.0), F.when(flat, fy / n).otherwise(0.0)


def initial_velocity(begins: Column, speed: Column, heading: tuple[Column, Column]) -> tuple[Column, Column, Column]:
    """(east, north, source): at rest, or the reference's speed along the heading, or zero by assumption."""
    moving = ~F.coalesce(begins, F.lit(False)) & speed.isNotNull()
    source = F.when(F.coalesce(begins, F.lit(False)), "zero_stationary").when(speed.isNotNull(), "reference_speed").otherwise("zero_assumed")
    return F.when(moving, speed * heading[0]).otherwise(0.0), F.when(moving, speed * heading[1]).otherwise(0.0), source


def attitude_confidence(gravity: Column, field_weight: Column, has_gyro: Column) -> Column:
    """Of an attitude: gravity's, halved without a gyroscope; at most 0.5 where no trusted field fixes the heading, else up to all by its weight."""
    base = F.coalesce(gravity, F.lit(0.0)) * F.when(has_gyro, 1.0).otherwise(0.5)
    trusted = F.coalesce(field_weight > 0, F.lit(False))
    return F.when(trusted, F.least(F.lit(1.0), base * (0.6 + 0.4 * field_weight))).otherwise(F.least(F.lit(0.5), base))


def residual_lag(track: DataFrame, reference: DataFrame, key, t: str) -> DataFrame:
    """A row per key of a track with the figures of lags.residual_lag, the track's speed being that of vx, vy, vz."""
    v = F.sqrt(F.col("vx") ** 2 + F.col("vy") ** 2 + F.col("vz") ** 2)
    return lags.residual_lag(track.select(*_key(key), t, v.alias("speed")), reference, key, t)


def reference_track(rows: DataFrame, key, speed: Column, position: tuple[Column, Column, Column], fresh: Column, headings: list[str], order: list[str], t: str) -> DataFrame:
    """A recording's own reference: speed, position (e, n, u) of fresh fixes only, and the first of the heading columns that has a value in the recording, named in heading_source."""
    k = _key(key)
    rows = rows.withColumn("__k", F.struct(*k))  # keys in a struct are equal where both are null
    rows = rows.join(rows.groupBy("__k").agg(*[F.count(h).alias(f"__have_{h}") for h in headings]), "__k")
    have = [F.col(f"__have_{h}") > 0 for h in headings]
    pick, name = F.lit(None).cast("double"), F.lit("none")
    for h, any_ in reversed(list(zip(headings, have, strict=True))):
        pick, name = F.when(any_, F.col(h).cast("double")).otherwise(pick), F.when(any_, h).otherwise(name)
    ok = F.coalesce(fresh, F.lit(False))
    return rows.select(*k, *order, t, speed.cast("double").alias("speed"), *[F.when(ok, c).alias(n) for c, n in zip(position, "enu", strict=True)], pick.alias("heading_deg"), name.alias("heading_source"))


def alignment_checks(rows: DataFrame, key, order: list[str], t: str, rotation: str, accel: str, speed: str, gyro: str | None = None, yaw_rate: str | None = None) -> DataFrame:
    """A row per key: whether an alignment (array of nine numbers, row by row) makes the vehicle behave like one.

    longitudinal: forward acceleration against the rate of the speed; lateral: sideways acceleration against speed times yaw rate; angular: yaw rate against a reference's. accel is linear acceleration in phone axes.
    """
    k = _key(key)
    r = F.col(rotation)
    turned = lambda prefix, row: sum((r[3 * row + i] * F.col(f"{prefix}_{c}") for i, c in enumerate("xyz")), F.lit(0.0))
    own = rows.select(*k, *order, t, F.col(speed).alias("__v"), turned(accel, 0).alias("__ax"), turned(accel, 1).alias("__ay"), (turned(gyro, 2) if gyro else F.lit(None).cast("double")).alias("__wz"), (F.col(yaw_rate) if yaw_rate else F.lit(None).cast("double")).alias("__ref"))
    w = W.partitionBy(*k).orderBy(*order)
    dt = (F.lead(t).over(w) - F.lag(t).over(w)) / US
    own = own.withColumn("__rate", F.when(dt > 0, (F.lead("__v").over(w) - F.lag("__v").over(w)) / dt))
    c = asof.guarded_corr
    return own.groupBy(*k).agg(c(F.col("__ax"), F.col("__rate")).alias("longitudinal_correlation"), c(F.col("__ay"), F.col("__v") * F.col("__wz")).alias("lateral_correlation"), c(F.col("__wz"), F.col("__ref")).alias("angular_correlation"))


def trajectory_summary(states: DataFrame, key, order: list[str], t: str, flags: str | None = None) -> DataFrame:
    """A row per key: samples, duration, final and greatest speed, displacement and path length; with flags, how many rows have any."""
    k, at = _key(key), F.struct(*order)
    v = F.sqrt(F.col("vx") ** 2 + F.col("vy") ** 2 + F.col("vz") ** 2)
    more = [F.count_if(F.col(flags) != 0).alias("flagged")] if flags else []
    out = states.groupBy(*k).agg(F.count("*").alias("samples"), ((F.max(t) - F.min(t)) / US).alias("duration_s"), F.max_by(v, at).alias("final_speed_mps"), F.max(v).alias("max_speed_mps"), *more)
    length = ordered.path_length(states, key, order, ["px", "py", "pz"]).select(*k, F.coalesce("displacement", F.lit(0.0)).alias("displacement_m"), F.coalesce("distance", F.lit(0.0)).alias("path_length_m"))
    return out.join(length, k)


def nearest_to_median(runs: DataFrame, duration: str, order: list[str], n: int) -> DataFrame:
    """The n runs whose duration is closest to the median of all, the first in order of equals. A report of the top n: no more than that leaves the cluster."""
    middle = runs.agg(F.median(duration).alias("__m")).withColumn("__one", F.lit(1))  # one row
    return runs.withColumn("__one", F.lit(1)).join(F.broadcast(middle), "__one").orderBy(F.abs(F.col(duration) - F.col("__m")), *order).limit(n).drop("__m", "__one")


COUNTERS = ("integrated", "skipped_non_positive", "skipped_too_large", "skipped_not_finite", "irregular", "invalid_sensor", "attitude_updates")


def concatenate(pieces: list[DataFrame]) -> DataFrame:
    """Pieces of a trajectory one below the other, with the piece's number; nothing is made continuous across them."""
    if not pieces:
        raise ValueError("nothing to concatenate")
    out = None
    for i, piece in enumerate(pieces):
        piece = piece.withColumn("piece", F.lit(i))
        out = piece if out is None else out.unionByName(piece, allowMissingColumns=True)
    return out


def total_counters(pieces: DataFrame, key, counters=COUNTERS, all_of=("heading_observed", "is_navigation_grade")) -> DataFrame:
    """Of a row per piece: the sums of its counters, and whether what holds of a trajectory holds of all its pieces."""
    return pieces.groupBy(*_key(key)).agg(*[F.sum(c).alias(c) for c in counters if c in pieces.columns], *[F.bool_and(c).alias(c) for c in all_of if c in pieces.columns])


def run_summary(segments: DataFrame) -> DataFrame:
    """One row over segment rows of (succeeded, aligned, compared, zero_rmse, best_rmse, position_drift, lag_s, lag_accepted): counts, and medians of the compared ones."""
    ok = F.coalesce("succeeded", F.lit(False))
    with_figures = ok & F.coalesce("compared", F.lit(False))
    of = lambda c: F.median(F.when(with_figures & ~F.isnan(c), F.col(c)))
    lag = F.when(with_figures & F.col("lag_accepted"), F.abs("lag_s"))
    return segments.agg(
        F.count("*").alias("processed"), F.count_if(ok).alias("propagated"), F.count_if(ok & F.col("aligned")).alias("with_alignment"), F.count_if(ok & ~F.col("aligned")).alias("without_alignment"), F.count_if(with_figures).alias("compared"),
        of("zero_rmse").alias("median_zero_lag_speed_rmse_mps"), of("best_rmse").alias("median_best_lag_speed_rmse_mps"), of("position_drift").alias("median_position_drift_mps"), F.count(lag).alias("with_accepted_lag"), F.median(lag).alias("median_abs_lag_s"),
    )
