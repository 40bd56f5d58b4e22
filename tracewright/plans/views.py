"""Artifact tables of an ingest, as views over canonical rows; synchronisation and labels are stored, the others are computed when one is read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import flags as FL
from ..operators import asof, ordered, quality, runs, splits, timeline
from ..operators.store import Tables
from ..sources import raw
from . import reports


def ingest_views(rows: DataFrame) -> dict[str, DataFrame]:
    """segments, timing, freshness, availability, missingness, pairs, overlap, sync, sync_figures, labels, label_coverage, label_speeds, label_figures, label_sources, canonical_figures, windows, outages, splits, split_summary, leakage, flags.

    Give it rows that were written and read back, as the ingest does: the views take them many times over, and each time the whole plan of what made them would be taken along.
    """
    rows = rows.withColumn("t_us", F.round(F.col("analysis_time_s") * 1e6).cast("long"))
    seg = rows.groupBy("segment_id", "source_file", "session_id", "dataset_family", "stream", "payload_hash").agg(
        F.count("*").alias("n_rows"), F.min("analysis_time_s").alias("start_s"), F.max("analysis_time_s").alias("end_s"), F.max("elapsed_s").alias("duration_s")
    )
    fresh = rows.groupBy("source_file").agg(F.count_if("gnss_position_fresh").alias("updates"), F.count_if(FL.has(F.col("quality_flags"), FL.QUALITY["GNSS_STALE"])).alias("stale_rows"), F.max("gnss_stale_duration_s").alias("longest_s"))
    pairs = splits.pair_streams(seg.select("dataset_family", "session_id", "stream", "source_file").distinct(), ["dataset_family", "session_id"], "stream", "source_file")
    links = seg.select(F.concat(F.lit("payload:"), "payload_hash").alias("a"), F.concat_ws(":", F.lit("session"), "dataset_family", "session_id").alias("b")).distinct()
    member = splits.closure(links, "a", "b").where("node LIKE 'payload:%'").select(F.substring("node", 9, 64).alias("payload_hash"), "component")
    grouped = seg.join(member, "payload_hash")
    keys = grouped.groupBy("component").agg(splits.group_key(F.col("payload_hash")).alias("group_key"), F.sum("n_rows").alias("n_rows"))
    assigned = grouped.join(keys.select("component", "group_key"), "component").join(splits.pack(keys, "group_key", "n_rows"), "group_key").drop("component")
    clocks = rows.where("time_of_day_s IS NOT NULL").withColumn("u", F.round(F.col("time_of_day_s") * 1e6).cast("long"))
    of = lambda s: clocks.where(F.col("stream") == s).select("dataset_family", "session_id", "u")
    tables = Tables(rows.sparkSession, "views")
    sync, _ = tables.keep(runs.synchronize(rows))
    labels, _ = tables.keep(runs.label(rows, sync))
    phone = rows.where("stream = 'smartphone' AND t_us IS NOT NULL").withColumn("no_fix", ~F.coalesce("gnss_fix_available", F.lit(False)))
    covered = runs.coverage(labels)
    return {
        "segments": seg,
        "timing": timeline.timing(rows, ["source_file"], ["row_idx"], "t_us"),
        "freshness": fresh,
        "availability": raw.availability(rows),
        "missingness": quality.missingness(quality.profile(rows, ["accel_x", "gyro_x", "mag_x", "gravity_x", "latitude", "gnss_speed_mps", "ref_speed_mps"], ["stream"])),
        "pairs": pairs,
        "overlap": asof.overlap(of("smartphone"), of("vehicle"), ["dataset_family", "session_id"], "u"),
        "sync": sync,
        "sync_figures": reports.sync_figures(sync.join(covered.select(F.col("source_file").alias("smartphone_file"), "coverage_fraction"), "smartphone_file", "left"), "coverage_fraction"),
        "labels": labels,
        "label_coverage": covered,
        "label_speeds": reports.spread(labels.where("label_available"), ["label_source"], "ref_velocity_mps"),
        "label_figures": reports.label_figures(covered),
        "label_sources": quality.value_counts(covered, "label_source"),
        "canonical_figures": reports.canonical_figures(rows),
        "windows": asof.windows(labels.where("t_us IS NOT NULL"), ["segment_id"], ["row_idx"], "t_us", "ref_velocity_mps", "quality_flags"),
        "outages": ordered.outages(phone, ["segment_id"], ["row_idx"], "t_us", "no_fix"),
        "splits": assigned,
        "split_summary": assigned.groupBy("split").agg(F.count("*").alias("segments"), F.sum("n_rows").alias("n_rows"), F.sum("duration_s").alias("duration_s")),
        "leakage": splits.leakage(assigned, {"payload": ["payload_hash"], "session": ["dataset_family", "session_id"], "segment": ["segment_id"]}),
        "flags": FL.counts(rows, "quality_flags", FL.QUALITY, ["stream"]),
    }


def register(views: dict[str, DataFrame], prefix: str = "") -> None:
    """Makes the views available to SQL."""
    for name, df in views.items():
        df.createOrReplaceTempView(prefix + name)
