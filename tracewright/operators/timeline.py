"""Segments, order and timing of recordings.

Every operator takes the columns that name a recording (key), the order in which its rows were written (order) and a time column in
microseconds (integer, so that range windows are exact). Null times take no part in differences.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import params as P

US = 1_000_000


def _key(key) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def step(key, order: list[str], t: str) -> Column:
    """Microseconds since the last known time before this row."""
    before = W.partitionBy(*_key(key)).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return F.col(t) - F.last(t, ignorenulls=True).over(before)


def median_step(df: DataFrame, key, order: list[str], t: str) -> DataFrame:
    """(key, median_us): median of the positive steps of each recording."""
    steps = df.select(*_key(key), step(key, order, t).alias("dt"))
    return steps.groupBy(*_key(key)).agg(F.median(F.when(F.col("dt") > 0, F.col("dt"))).alias("median_us"))


def gap_threshold(median_us: Column, multiple: float = P.SEGMENT_GAP_MULTIPLE, floor_s: float = P.SEGMENT_GAP_MIN_SECONDS) -> Column:
    """Null, so no gaps, where the cadence isn't known."""
    return F.when(median_us.isNotNull(), F.greatest(median_us * multiple, F.lit(floor_s * US)))


def segment(df: DataFrame, key, order: list[str], t: str, multiple: float = P.SEGMENT_GAP_MULTIPLE, floor_s: float = P.SEGMENT_GAP_MIN_SECONDS, reset_s: float = P.CLOCK_RESET_MIN_DROP_S) -> DataFrame:
    """Adds dt_us, reason (null, 'clock_reset' or 'gap'), segment_no (from 0, in written order) and elapsed_us in the segment.

    The recording's median step is joined back, since a median can't be taken over an ordered window; the windows and the join
    share one partitioning by key.
    """
    k = _key(key)
    rows = df.withColumn("dt_us", step(key, order, t))
    cadence = rows.groupBy(*k).agg(F.median(F.when(F.col("dt_us") > 0, F.col("dt_us"))).alias("median_us"))
    rows = rows.join(cadence, k).withColumn("threshold_us", gap_threshold(F.col("median_us"), multiple, floor_s))
    reason = F.when(F.col("dt_us") <= -reset_s * US, "clock_reset").when(F.col("dt_us") > F.col("threshold_us"), "gap")
    rows = rows.withColumn("reason", reason)
    ordered = W.partitionBy(*k).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumn("segment_no", F.sum(F.when(F.col("reason").isNotNull(), 1).otherwise(0)).over(ordered).cast("long"))
    return rows.withColumn("elapsed_us", F.col(t) - F.min(t).over(W.partitionBy(*k, "segment_no"))).drop("median_us", "threshold_us")


def segment_id(payload_hash: Column, number: Column) -> Column:
    return F.concat(F.substring(payload_hash, 1, 12), F.lit(":"), F.lpad(number.cast("string"), 3, "0"))


def segment_records(segmented: DataFrame, key, t: str, order: list[str]) -> DataFrame:
    """A row per segment: rows, start, end, duration, why it begins and after how long a step, its own median interval and rate, and whether it is short (two known times at least, less than SHORT_SEGMENT_SECONDS apart)."""
    k = [*_key(key), "segment_no"]
    own = segmented.withColumn("__dt", step(k, order, t))
    at = F.struct(*order)
    out = own.groupBy(*k).agg(
        F.count("*").alias("n_rows"), F.count(t).alias("__n"), F.min(t).alias("start_us"), F.max(t).alias("end_us"), F.min_by("reason", at).alias("reason"),
        F.min_by(F.when(F.col("reason").isNotNull(), F.col("dt_us") / US), at).alias("gap_before_s"), (F.median(F.when(F.col("__dt") > 0, F.col("__dt"))) / US).alias("median_interval_s"),
    )
    out = out.withColumn("duration_s", (F.col("end_us") - F.col("start_us")) / US).withColumn("rate_hz", 1.0 / F.col("median_interval_s"))
    return out.withColumn("reason", F.coalesce("reason", F.lit("start"))).withColumn("short", (F.col("__n") > 1) & (F.col("duration_s") < P.SHORT_SEGMENT_SECONDS)).drop("__n")


def arrange(segmented: DataFrame, key, order: list[str], t: str) -> DataFrame:
    """Adds backward (a step back inside a segment), position (from 0 in the recording, the order to go on with) and boundary (the first row of a segment in that order).

    Segments stay in written order. Rows of a segment with a step back are sorted by time, stably and those without a time last; the others stay as they were written. No row leaves its segment.
    """
    k = _key(key)
    within = W.partitionBy(*k, "segment_no")
    rows = segmented.withColumn("backward", F.coalesce(step([*k, "segment_no"], order, t) < 0, F.lit(False)))
    rows = rows.withColumn("__t", F.when(F.bool_or("backward").over(within), F.col(t)))
    sort = [F.col("__t").asc_nulls_last(), *order]
    rows = rows.withColumn("position", F.row_number().over(W.partitionBy(*k).orderBy("segment_no", *sort)) - 1)
    return rows.withColumn("boundary", F.col("position") == F.min("position").over(within)).drop("__t")


def duplicate_times(df: DataFrame, key, t: str) -> DataFrame:
    """Adds duplicate: true for all rows of a recording that share their time."""
    n = F.count("*").over(W.partitionBy(*_key(key), t))
    return df.withColumn("duplicate", F.col(t).isNotNull() & (n > 1))


def non_monotonic(df: DataFrame, key, order: list[str], t: str) -> DataFrame:
    """Adds backward: true for a row whose time lies before the last known one."""
    return df.withColumn("backward", F.coalesce(step(key, order, t) < 0, F.lit(False)))


def strictly_increasing(df: DataFrame, key, order: list[str], t: str) -> DataFrame:
    """Rows that are later than everything before them."""
    before = W.partitionBy(*_key(key)).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    seen = df.withColumn("__max", F.max(t).over(before))
    return seen.where(F.col(t).isNotNull() & (F.col("__max").isNull() | (F.col(t) > F.col("__max")))).drop("__max")


def sampling_class(cv: Column) -> Column:
    return F.when(cv.isNull(), "unknown").when(cv <= P.STABLE_CV_MAX, "stable").when(cv <= P.MOSTLY_STABLE_CV_MAX, "mostly_stable").when(cv <= P.IRREGULAR_CV_MAX, "irregular").otherwise("severely_irregular")


def timing(df: DataFrame, key, order: list[str], t: str) -> DataFrame:
    """Interval statistics of each recording, in seconds: of the positive steps, with quartiles, class and counts of other steps."""
    k = _key(key)
    steps = df.where(F.col(t).isNotNull()).select(*k, t, (step(key, order, t) / US).alias("dt"))
    up = F.when(F.col("dt") > 0, F.col("dt"))
    out = steps.groupBy(*k).agg(
        F.count("*").alias("n"), F.avg(up).alias("mean_s"), F.percentile(up, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75), F.lit(0.99))).alias("q"),
        F.stddev_pop(up).alias("std_s"), F.min(up).alias("min_s"), F.max(up).alias("max_s"),
        F.count_if(F.col("dt") < 0).alias("n_negative"), F.count_if(F.col("dt") == 0).alias("n_zero"), (F.count("*") - F.count_distinct(t)).alias("n_duplicate"),
        ((F.max(t) - F.min(t)) / US).alias("duration_s"),
    )
    out = out.withColumn("cv", F.when(F.col("mean_s") > 0, F.col("std_s") / F.col("mean_s"))).withColumn("sampling", sampling_class(F.col("cv")))
    out = out.withColumn("iqr_s", F.col("q")[2] - F.col("q")[0]).withColumn("irregularity", F.when(F.col("q")[1] > 0, F.col("iqr_s") / F.col("q")[1]))
    return out.withColumn("median_s", F.col("q")[1]).withColumn("p99_s", F.col("q")[3]).drop("q")


def step_verdict(dt_s: Column, max_step_s: float = P.MAX_INTEGRATION_STEP_S) -> Column:
    return F.when(dt_s.isNull() | F.isnan(dt_s), "NOT_FINITE").when(dt_s <= 0, "NON_POSITIVE").when(dt_s > max_step_s, "TOO_LARGE").otherwise("VALID")


def is_irregular(dt_s: Column, median_s: Column, factor: float = P.IRREGULAR_DT_FACTOR) -> Column:
    return F.coalesce((dt_s > median_s * factor) | (dt_s < median_s / factor), F.lit(False))
