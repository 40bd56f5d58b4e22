"""The figures of the reports, as aggregates over the artifact views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import params as P
from ..functions import flags as FL
from ..operators import splits

DISCONTINUOUS_CV = 5.0
NEAR_HOUR_S = 60.0
CLEAN_AVAILABILITY = 0.999
SURE_ALIGNMENT = 0.25


def spread(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Median, least, greatest and count of a value: sampling rates by stream, quality scores, offsets, label speeds."""
    v = F.col(value)
    return df.groupBy(*by).agg(F.median(v).alias("median"), F.min(v).alias("least"), F.max(v).alias("greatest"), F.count(v).alias("n"))


def totals(segments: DataFrame, stream: str, n_rows: str, duration_s: str) -> DataFrame:
    """Rows and hours by stream and, where the stream is null, over all."""
    return segments.rollup(stream).agg(F.sum(n_rows).alias("n_rows"), (F.sum(duration_s) / 3600).alias("hours"))


def redundant_copies(groups: DataFrame, n: str) -> DataFrame:
    """Copies beyond the first over all groups of duplicates."""
    return groups.agg(F.coalesce(F.sum(F.greatest(F.col(n) - 1, F.lit(0))), F.lit(0)).alias("redundant"))


def family_sets(files: DataFrame, group: str, family: str) -> DataFrame:
    """How many groups span each set of families."""
    sets = files.groupBy(group).agg(F.array_join(F.array_sort(F.collect_set(family)), ",").alias("families"))
    return sets.groupBy("families").agg(F.count("*").alias("n_groups"))


def discontinuous(timing: DataFrame, name: str, order: list[str], cv: str = "cv", least: float = DISCONTINUOUS_CV) -> DataFrame:
    """Streams whose intervals vary by more than `least`, the first of each name."""
    ranked = timing.where(F.col(cv) > least).withColumn("__k", F.row_number().over(W.partitionBy(name).orderBy(*order)))
    return ranked.where("__k = 1").drop("__k")


def whole_hours(overlap: DataFrame, hours: str = "whole_hours", residual: str = "residual_s") -> DataFrame:
    """Histogram of the whole hours in clock offsets, with the median size of what is left and how many are near a whole hour."""
    left = F.abs(residual)
    return overlap.groupBy(F.col(hours).alias("hours")).agg(F.count("*").alias("n"), F.median(left).alias("median_residual_s"), F.count_if(left <= NEAR_HOUR_S).alias("near_hour"))


def sync_figures(pairs: DataFrame, coverage: str | None = None) -> DataFrame:
    """Offsets of confirmed pairs, median correlation, pairs whose clocks drift by more than a second, pairs of each status, and the median label coverage if there is one."""
    ok = F.col("status") == "CONFIRMED_BY_SIGNAL"
    off = F.when(ok, F.col("estimated_offset_s"))
    aggs = [F.min(off).alias("least_offset_s"), F.max(off).alias("greatest_offset_s"), F.median(off).alias("median_offset_s"), F.median(F.when(ok, F.col("correlation"))).alias("median_correlation"), F.count_if("drift_detected").alias("n_drifting")]
    aggs += [F.count_if(F.col("status") == s).alias(s.lower()) for s in ("CONFIRMED_BY_SIGNAL", "CLOCK_ONLY", "UNRESOLVED")]
    return pairs.agg(*aggs, *([F.median(coverage).alias("median_coverage")] if coverage else []))


def performance(runs: DataFrame, seconds: str, samples: str) -> DataFrame:
    """Mean and 95th percentile of microseconds a sample and of seconds a segment."""
    each: Column = F.when(F.col(samples) > 0, F.col(seconds) * 1e6 / F.col(samples))
    p95 = lambda c: F.percentile(c, F.lit(0.95))
    return runs.agg(F.avg(each).alias("mean_us_a_sample"), p95(each).alias("p95_us_a_sample"), F.avg(seconds).alias("mean_s_a_segment"), p95(F.col(seconds)).alias("p95_s_a_segment"), F.count("*").alias("n_segments"))


def resting_residuals(states: DataFrame, key: list[str], flags: str, accel: tuple[str, str, str], stationary_bit: int = 64) -> DataFrame:
    """Mean size of the compensated acceleration at rest by segment: total, horizontal and vertical."""
    x, y, z = map(F.col, accel)
    rest = states.where((F.col(flags).bitwiseAND(stationary_bit) != 0) & x.isNotNull() & y.isNotNull() & z.isNotNull())
    return rest.groupBy(*key).agg(F.avg(F.sqrt(x * x + y * y + z * z)).alias("total"), F.avg(F.sqrt(x * x + y * y)).alias("horizontal"), F.avg(F.abs(z)).alias("vertical"), F.count("*").alias("n"))


def representatives(files: DataFrame) -> DataFrame:
    """At most five files that show what a folder holds, each with its category, its session and the value that chose it.

    clean: a steady phone recording with all fixes and no finding, with the most rows; gnss_gap: the longest time without fixes; difficult_motion: the phone with the most findings; synchronized_pair: the longest overlap;
    irregular_sampling: the phone with the lowest timestamp score among irregular ones. Of equal values the first path is taken. A file stands for the first of these that it wins, and the others of its wins stay empty.

    files: a row per file with source_file, session_id, stream, n_rows, sampling, availability, n_findings, outages, outage_s, overlap_s and timestamp_score. One aggregation finds all winners.
    """
    c = F.col
    phone = (c("stream") == "smartphone") & (c("n_rows") > 0)
    cases = {
        "clean": (phone & (c("sampling") == "stable") & (c("availability") >= CLEAN_AVAILABILITY) & (c("n_findings") == 0), c("n_rows"), -1.0),
        "gnss_gap": (c("outages") > 0, c("outage_s"), -1.0),
        "difficult_motion": (phone & (c("n_findings") > 0), c("n_findings"), -1.0),
        "synchronized_pair": (c("overlap_s") > 0, c("overlap_s"), -1.0),
        "irregular_sampling": (phone & c("sampling").isin("irregular", "severely_irregular"), c("timestamp_score"), 1.0),
    }
    value = lambda v: v.cast("double")
    best = [F.min_by(F.struct("source_file", "session_id", value(v).alias("value")), F.when(ok & v.isNotNull(), F.struct(value(v) * sign, c("source_file")))).alias(n) for n, (ok, v, sign) in cases.items()]
    won = files.agg(*best).select(F.explode(F.array(*[F.struct(F.lit(i).alias("at"), F.lit(n).alias("category"), c(n).alias("file")) for i, n in enumerate(cases)])).alias("w")).select("w.at", "w.category", "w.file.*")
    return splits.top_per(won.where("source_file IS NOT NULL"), ["source_file"], "at").drop("at")


def examples(evaluations: DataFrame, count: int = 3) -> DataFrame:
    """`count` segments whose runs are worth drawing, chosen by outcome and length alone: the longest of those aligned with confidence, of those aligned with little, of those not aligned, then the longest of the rest.

    Adds example, from 1 on. Segments that weren't propagated aren't chosen; equal lengths go by segment_id. Only the longest few of each outcome meet in one task.
    """
    c = F.col
    sure = F.coalesce(c("alignment_confidence"), F.lit(0.0)) >= SURE_ALIGNMENT
    have = F.coalesce(c("alignment_available"), F.lit(False))
    done = evaluations.where("error IS NULL").withColumn("__kind", F.when((c("alignment_status") == "SUCCESS") & sure, 0).when(have & ~sure, 1).when(~have, 2).otherwise(3))
    length = F.coalesce(c("duration_s"), F.lit(0.0)).desc()
    few = splits.top_per(done, ["__kind"], length, "segment_id", k=count)
    few = few.withColumn("__first", (F.row_number().over(W.partitionBy("__kind").orderBy(length, "segment_id")) == 1) & (c("__kind") < 3))
    turn = F.row_number().over(W.orderBy(F.when(c("__first"), c("__kind")).otherwise(3), length, "segment_id"))
    return few.withColumn("example", turn).where(c("example") <= count).drop("__kind", "__first")


def label_figures(coverage: DataFrame) -> DataFrame:
    """One row over the labels of all files: labelled rows, their share, and medians of the mean label and of the share that stands. coverage: runs.coverage; quality.value_counts counts its files by label source."""
    mean = F.col("mean_label_mps")
    return coverage.agg(
        F.count("*").alias("files"), F.count(mean).alias("labelled_files"), F.sum("labelled_rows").alias("labelled_rows"), (F.sum("labelled_rows") / F.sum("n_rows")).alias("labelled_share"),
        F.median(F.when(mean != 0, mean)).alias("median_label_mps"), F.median(F.when(mean.isNotNull(), F.col("stationary_fraction"))).alias("median_stationary_fraction"),
    )


def canonical_figures(rows: DataFrame) -> DataFrame:
    """A row per stream of canonical rows: rows, files, segments; files of several segments, with rows put in order, with resets of the source's counter, with repaired fields and with doubtful encoding; median minutes and total hours of its segments."""
    flag = lambda name: F.bool_or(FL.has(F.col("quality_flags"), FL.QUALITY[name]))
    before = F.last("source_time_s", True).over(W.partitionBy("source_file").orderBy("row_idx").rowsBetween(W.unboundedPreceding, -1))
    rows = rows.withColumn("__reset", F.coalesce(F.col("source_time_s") - before <= -P.CLOCK_RESET_MIN_DROP_S, F.lit(False)))
    # A segment lies in one file, so its files' figures are sums over segments.
    segments = rows.groupBy("stream", "source_file", "segment_id").agg(
        F.count("*").alias("n"), F.max("elapsed_s").alias("s"), F.bool_or("__reset").alias("reset"), flag("NON_MONOTONIC_TIMESTAMP").alias("reordered"), flag("SCHEMA_REPAIR").alias("repaired"), flag("ENCODING_WARNING").alias("warned")
    )
    files = segments.groupBy("stream", "source_file").agg(F.count("*").alias("segments"), F.sum("n").alias("n"), *[F.bool_or(x).alias(x) for x in ("reset", "reordered", "repaired", "warned")])
    out = files.groupBy("stream").agg(
        F.sum("n").alias("n_rows"), F.count("*").alias("files"), F.sum("segments").alias("segments"), F.count_if(F.col("segments") > 1).alias("multi_segment_files"), F.count_if("reordered").alias("reordered_files"), F.count_if("reset").alias("counter_reset_files"),
        F.count_if("repaired").alias("repaired_files"), F.count_if("warned").alias("encoding_warned_files"),
    )
    lasting = segments.groupBy("stream").agg((F.median("s") / 60).alias("median_segment_min"), (F.sum("s") / 3600).alias("total_h"))
    return out.join(lasting, "stream")
