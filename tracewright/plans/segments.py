"""Evaluation of a folder's segments: attitude, alignment, rest and biases, start, propagation and comparison with the recording's own reference, each a table over all segments.

A segment that can't be evaluated has a row that says why. Rows are canonical (sources.raw), with t_us.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import params as P
from ..functions import flags as FL
from ..functions import geodesy as G
from ..functions import quaternions as Q
from ..functions import vectors as V
from ..operators import alignment, attitude, evaluation, frames, lags, navigation, ordered
from ..operators.store import Tables
from ..operators.timeline import US

KEY, AXES = "segment_id", "xyz"
SENSORS = ("accel", "gyro", "mag", "gravity")


def prepared(rows: DataFrame, least: int = P.MIN_SEGMENT_SAMPLES) -> DataFrame:
    """Rows with a time of segments with at least `least` accelerations, in the columns that an evaluation reads; speed and speed_source are those of choose_speed."""
    names = [f"{s}_{a}" for s in SENSORS for a in AXES]
    num = lambda c: (V.clean(F.col(c).cast("double")) if c in rows.columns else F.lit(None).cast("double")).alias(c)
    fresh = F.coalesce(F.col("gnss_position_fresh"), F.lit(False)) if "gnss_position_fresh" in rows.columns else F.lit(False)
    out = rows.where("t_us IS NOT NULL").select(KEY, "session_id", "source_file", "row_idx", "t_us", (F.col("t_us") / US).alias("t_s"), *map(num, [*names, "latitude", "longitude", "altitude_m", "gnss_speed_mps", "ref_speed_mps", "ref_heading_deg", "gnss_heading_deg"]), fresh.alias("fresh"))
    seen = out.groupBy(KEY).agg(F.count_if(V.all_finite(*V.vector("accel"))).alias("__n")).where(F.col("__n") >= least)
    out = out.join(seen.select(KEY), KEY, "left_semi")
    out = out.withColumn("gnss_speed_mps", F.when(F.col("fresh"), F.col("gnss_speed_mps")))
    return frames.choose_speed(out, KEY, "ref_speed_mps", "gnss_speed_mps")


def evaluate(rows: DataFrame, least: int = P.MIN_SEGMENT_SAMPLES) -> dict[str, DataFrame]:
    """evaluations (a row per segment), trajectories (a row per sample), alignments and biases."""
    tables = Tables(rows.sparkSession, "evaluation")
    order = ["row_idx"]
    own, _ = tables.keep(prepared(rows, least))
    sensors = {s: s for s in ("gravity", "gyro", "mag")}
    turned, _ = tables.keep(attitude.orientation(own, KEY, order, **sensors))
    aligned, _ = tables.keep(alignment.alignment(own, KEY, "t_us", order, **sensors))
    norms = own.select(KEY, *order, "t_us", "speed", *[f"{s}_{a}" for s in ("accel", "gyro") for a in AXES], V.norm(V.vector("accel")).alias("__f"), V.norm(V.vector("gyro")).alias("__w"))
    rest = ordered.stationary(norms, KEY, order, "t_us", "__f", "__w").drop("__f", "__w")
    up = frames.gravity_estimate(own, KEY, "accel", "gravity", "gyro").select(KEY, *[f"up_{a}" for a in AXES])
    rest, _ = tables.keep(rest.join(turned.select(KEY, "row_idx", *[f"q_{a}" for a in "xyzw"], F.col("confidence").alias("attitude_confidence")), [KEY, "row_idx"]).join(up, KEY))
    biases, _ = tables.keep(navigation.bias_from_longest_rest(rest, KEY, order, "t_us", "stationary", "accel", "up", "gyro"))
    ref = reference(own)
    start, _ = tables.keep(starts(rest, aligned, KEY, order))
    median = navigation.median_step(own, KEY, order, "t_us")
    facts = aligned.select(KEY, F.when(F.col("rotation").isNotNull(), F.col("confidence")).alias("alignment_confidence"))
    track = navigation.propagate(rest.join(facts, KEY).join(biases, KEY).join(start.select(KEY, *[f"v0_{a}" for a in AXES]), KEY).join(median, KEY), KEY, order, "t_us", "accel", "gyro")
    track, _ = tables.keep(track.select(KEY, "row_idx", "t_us", *[F.col(f"v_{a}").alias(f"v{a}") for a in AXES], *[F.col(f"p_{a}").alias(f"p{a}") for a in AXES], *[f"q_{a}" for a in "xyzw"], "flags", "stationary"))
    lag, _ = tables.keep(evaluation.residual_lag(track, ref, KEY, "t_us"))
    compared = {name: evaluation.compare(evaluation.error_curves(track, r, KEY, "t_us", order, by, remove_yaw=True), KEY, "t_us", order) for name, r, by in (("zero", ref, 0.0), ("best", ref.join(lag.select(KEY, "lag_s"), KEY), F.col("lag_s")))}
    pick = lambda n, cols: compared[n].select(KEY, *[F.col(c).alias(f"{n}_lag_{out}") for c, out in cols.items()])
    zero = pick("zero", {"speed_error_rmse": "speed_rmse_mps", "horizontal_error_rmse": "position_rmse_m"})
    best = pick("best", {"speed_error_rmse": "speed_rmse_mps", "horizontal_error_rmse": "position_rmse_m", "horizontal_error_final": "final_horizontal_error_m", "drift_per_second": "position_drift_mps", "yaw_rad": "yaw_rad"})
    path = evaluation.trajectory_summary(track, KEY, ["t_us", *order], "t_us", "flags").drop("samples", "duration_s")
    count = lambda bit: F.count_if(FL.has(F.col("flags"), bit))
    steps = track.groupBy(KEY).agg(
        F.count("*").alias("sample_count"), ((F.max("t_us") - F.min("t_us")) / US).alias("duration_s"), F.avg(F.col("stationary").cast("double")).alias("stationary_fraction"), (F.count("*") - 1 - count(8 | 16 | 32)).alias("integrated_steps"),
        count(8 | 16).alias("skipped_steps"), count(4).alias("irregular_steps"), count(32).alias("invalid_steps"),
    )
    size = lambda p: F.sqrt(sum((F.col(f"{p}_{a}") ** 2 for a in AXES), F.lit(0.0)))
    out = rows.groupBy(KEY).agg(F.first("session_id").alias("session_id"), F.min("source_file").alias("source_file"))
    out = out.join(steps, KEY, "left").join(aligned.select(KEY, F.col("status").alias("alignment_status"), F.col("confidence").alias("alignment_confidence"), F.col("rotation").isNotNull().alias("alignment_available"), (F.coalesce("mag_weight", F.lit(0.0)) > 0).alias("heading_observed")), KEY, "left")
    out = out.join(biases.select(KEY, size("gyro_bias").alias("gyro_bias_magnitude_rps"), size("accel_bias").alias("accel_bias_magnitude_mps2")), KEY, "left").join(start.select(KEY, "velocity_source", "begins_at_rest"), KEY, "left")
    out = out.join(path, KEY, "left").join(lag.select(KEY, "lag_s", F.col("accepted").alias("lag_accepted")), KEY, "left").join(zero, KEY, "left").join(best, KEY, "left")
    out = out.withColumn("yaw_offset_removed_deg", F.degrees("best_lag_yaw_rad")).drop("best_lag_yaw_rad")
    out = out.withColumn("error", F.when(F.col("sample_count").isNull(), f"fewer than {least} samples with an acceleration"))
    return {"evaluations": out, "trajectories": track, "alignments": aligned, "biases": biases}


def reference(own: DataFrame) -> DataFrame:
    """A segment's own reference: speed, position about its first fresh fix, and the first heading that it has."""
    fix = F.col("fresh") & F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    first = own.groupBy(KEY).agg(F.min_by(F.struct("latitude", "longitude", "altitude_m"), F.when(fix, F.struct("t_us", "row_idx"))).alias("o"))
    placed = own.join(first, KEY)
    e, n, u = G.to_enu(F.col("latitude"), F.col("longitude"), F.col("altitude_m"), F.col("o.latitude"), F.col("o.longitude"), F.col("o.altitude_m"))
    return evaluation.reference_track(placed, KEY, F.col("speed"), (e, n, u), fix, ["ref_heading_deg", "gnss_heading_deg"], ["row_idx"], "t_us")


def starts(rest: DataFrame, aligned: DataFrame, key: str, order: list[str]) -> DataFrame:
    """A row per key: v0_*, where it comes from, and whether the segment begins at rest. A speed is read where the alignment's lag says, from the nearest row within a second."""
    at_rest = evaluation.begins_at_rest(rest, key, order, "t_us", "stationary")
    first = rest.groupBy(key).agg(F.min("t_us").alias("__t0"), F.min_by(F.struct(*[f"q_{a}" for a in "xyzw"]), F.struct("t_us", *order)).alias("__q"))
    known = rest.where("speed IS NOT NULL").join(first.select(key, "__t0"), key).join(aligned.select(key, "lag_s"), key)
    off = F.abs(F.col("t_us") - F.col("__t0") - F.round(F.col("lag_s") * US))
    near = known.where(off <= US).groupBy(key).agg(F.min_by("speed", F.struct(off, "t_us", *order)).alias("__speed"))
    rows = first.join(at_rest, key, "left").join(near, key, "left").join(aligned.select(key, "rotation"), key)
    ahead = tuple(F.coalesce(F.col("rotation")[i], F.lit(x)) for i, x in enumerate((1.0, 0.0, 0.0)))
    east, north, _ = Q.rotate(tuple(F.col(f"__q.q_{a}") for a in "xyzw"), ahead)
    rows = rows.withColumns({"__e": east, "__n": north})
    ve, vn, source = evaluation.initial_velocity(F.col("begins_at_rest"), F.col("__speed"), evaluation.initial_heading(F.col("__e"), F.col("__n")))
    return rows.select(key, "begins_at_rest", ve.alias("v0_x"), vn.alias("v0_y"), F.lit(0.0).alias("v0_z"), source.alias("velocity_source"))


def frame_summary(aligned: DataFrame) -> DataFrame:
    """One row over all segments' alignments: how many there are, by status, how many resolved their yaw, and medians of confidence and lag of those."""
    ok = F.col("rotation").isNotNull()
    of = lambda c: F.median(F.when(ok, c))
    by = F.create_map(*[x for s in alignment.STATUSES for x in (F.lit(s), F.count_if(F.col("status") == s))])
    return aligned.agg(
        F.count("*").alias("segments"), F.count_if(ok).alias("yaw_resolved"), F.map_filter(by, lambda _, n: n > 0).alias("statuses"), of(F.col("confidence")).alias("median_confidence"), of(F.abs("lag_s")).alias("median_abs_lag_s"), of(F.col("correlation")).alias("median_correlation")
    )


def orientation_rmse(turned: DataFrame, rows: DataFrame, least: int = 10) -> DataFrame:
    """(segment, and for roll, pitch and yaw: <axis>_rmse_deg, <axis>_n): the attitudes against the recording's own orientation columns, differences wrapped.

    An axis is compared where both are finite, and null with fewer than `least` such rows or without its column.
    """
    axes = ("roll", "pitch", "yaw")
    own = rows.select(KEY, "row_idx", *[(V.clean(F.col(f"orientation_{c}").cast("double")) if f"orientation_{c}" in rows.columns else F.lit(None).cast("double")).alias(c) for c in axes])
    met = turned.select(KEY, "row_idx", *[F.degrees(c).alias(f"__{n}") for c, n in zip(Q.to_euler(Q.quaternion("q")), axes, strict=True)]).join(own, [KEY, "row_idx"])
    off = {n: G.wrap_deg(V.clean(F.col(f"__{n}")) - F.col(n)) for n in axes}
    return met.groupBy(KEY).agg(*[c for n, d in off.items() for c in (F.when(F.count(d) >= least, F.sqrt(F.avg(d * d))).alias(f"{n}_rmse_deg"), F.count(d).alias(f"{n}_n"))])


def summary(evaluations: DataFrame) -> DataFrame:
    """One row over all evaluations."""
    done, got = F.col("error").isNull(), F.col("lag_accepted")
    med = lambda c, where=None: F.median(F.when(done if where is None else where, F.col(c) if isinstance(c, str) else c))
    return evaluations.agg(
        F.count("*").alias("segments_processed"), F.count_if(done).alias("segments_propagated"), F.count_if("alignment_available").alias("segments_with_alignment"), F.count_if(~F.coalesce("alignment_available", F.lit(False))).alias("segments_without_alignment"),
        F.count("zero_lag_speed_rmse_mps").alias("segments_compared"), med("zero_lag_speed_rmse_mps").alias("median_zero_lag_speed_rmse_mps"), med("best_lag_speed_rmse_mps").alias("median_best_lag_speed_rmse_mps"),
        med("best_lag_position_drift_mps").alias("median_position_drift_mps"), F.count_if(got).alias("segments_with_accepted_lag"), med(F.abs("lag_s"), got).alias("median_abs_lag_s"),
    )
