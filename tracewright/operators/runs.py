"""What a whole folder of recordings goes through after it is read: clocks of paired streams are brought together, and labels are joined to the phone's rows.

Rows are canonical. A session's pair is the first file of either stream; clocks are times of day.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import params as P
from ..functions import flags as FL
from . import asof
from .timeline import US

SESSION = ["dataset_family", "session_id"]
#: What a label comes from, and how far it is trusted.
TIERS = {"TIER_1_VEHICLE_SYNCED": "high", "TIER_2_VEHICLE_CLOCK": "medium", "TIER_3_SMARTPHONE_GNSS": "low", "UNAVAILABLE": "none"}
STATIONARY_LABEL_MPS = 0.5


def _clock(rows: DataFrame) -> DataFrame:
    return rows.withColumn("u", F.round(F.col("time_of_day_s") * US).cast("bigint"))


def synchronize(rows: DataFrame) -> DataFrame:
    """A row per session with both streams: files, first segments, ends of their clocks, and what asof.synchronize decides from them and from the lag at which the speeds agree best."""
    timed = _clock(rows)
    at = F.struct("row_idx")
    known = F.when(F.col("u").isNotNull(), at)
    two = F.count("u") >= 2
    files = timed.groupBy(*SESSION, "stream", "source_file").agg(
        F.min_by("segment_id", at).alias("segment"), F.when(two, F.min_by("u", known) / US).alias("start_s"), F.when(two, F.max_by("u", known) / US).alias("end_s")
    )
    firsts = files.groupBy(*SESSION, "stream").agg(F.min(F.struct("source_file", "segment", "start_s", "end_s")).alias("f"))
    of = lambda s: firsts.where(F.col("stream") == s).select(*SESSION, *[F.col(f"f.{c}").alias(f"{s}_{n}") for c, n in (("source_file", "file"), ("segment", "segment"), ("start_s", "start_s"), ("end_s", "end_s"))])
    pairs = of("smartphone").join(of("vehicle"), SESSION)
    mean = ((F.col("smartphone_start_s") - F.col("vehicle_start_s")) + (F.col("smartphone_end_s") - F.col("vehicle_end_s"))) / 2
    coarse = pairs.select(*SESSION, F.round(mean * US).cast("bigint").alias("coarse_us"))

    def speeds(stream: str, column: str) -> DataFrame:
        mine = pairs.select(F.col(f"{stream}_file").alias("source_file"))
        return timed.where(F.col("stream") == stream).join(mine, "source_file", "left_semi").select(*SESSION, "u", "row_idx", F.nanvl(F.col(column).cast("double"), F.lit(None).cast("double")).alias("v"))

    found = asof.offset_search(speeds("smartphone", "gnss_speed_mps"), speeds("vehicle", "ref_speed_mps"), coarse, SESSION, "u", ["row_idx"], "v")
    ends = ("smartphone_start_s", "smartphone_end_s", "vehicle_start_s", "vehicle_end_s")
    out = asof.synchronize(pairs.join(found.withColumnRenamed("margin", "peak_margin"), SESSION, "left"), "offset_s", "correlation", "peak_margin", ends)
    return out.withColumn("pair_id", F.concat_ws(":", *SESSION)).drop("offset_s")


def label(rows: DataFrame, sync: DataFrame) -> DataFrame:
    """Phone rows with ref_velocity_mps, label_source, label_quality and label_available; flags say where a pair stayed open and where the label is weak. No row is dropped.

    A file with a vehicle whose clock could be brought to its own takes the vehicle's speed between its samples, never farther than MAX_INTERPOLATION_GAP_S from one. Other files take the phone's own speed where its position is fresh.
    """
    pair = sync.select(F.col("smartphone_file").alias("source_file"), "vehicle_file", "status", "estimated_offset_s")
    phone = _clock(rows.where("stream = 'smartphone'")).join(pair, "source_file", "left")
    tied = F.col("status").isNotNull() & (F.col("status") != "UNRESOLVED") & F.col("estimated_offset_s").isNotNull()
    phone = phone.withColumn("__tied", tied).withColumn("__pair", F.when(F.col("__tied"), F.col("vehicle_file")).otherwise(F.col("source_file")))
    phone = phone.withColumn("__at", F.col("u") - F.when(F.col("__tied"), F.round(F.col("estimated_offset_s") * US).cast("bigint")).otherwise(0))
    car = _clock(rows.where("stream = 'vehicle'")).withColumn("__v", F.nanvl(F.col("ref_speed_mps").cast("double"), F.lit(None).cast("double"))).where("u IS NOT NULL AND __v IS NOT NULL")
    enough = car.groupBy(F.col("source_file").alias("vehicle_file")).agg(F.count("*").alias("__samples"))
    phone = phone.join(enough, "vehicle_file", "left")
    car = car.select(F.col("source_file").alias("__pair"), F.col("u").alias("__at"), "row_idx", "__v")
    phone = asof.interpolate(phone, car, "__pair", "__at", ["row_idx"], "__v", "__ref", P.MAX_INTERPOLATION_GAP_S).drop("__v")
    speed = F.nanvl(F.col("gnss_speed_mps").cast("double"), F.lit(None).cast("double"))
    fresh = F.coalesce("gnss_position_fresh", F.lit(False))
    usable = phone.groupBy("source_file").agg((F.bool_or(speed.isNotNull()) & F.bool_or(fresh)).alias("__own"))
    phone = phone.join(usable, "source_file")
    by_car = F.when(F.coalesce("__samples", F.lit(0)) < 2, "UNAVAILABLE").when(F.col("status") == "CONFIRMED_BY_SIGNAL", "TIER_1_VEHICLE_SYNCED").otherwise("TIER_2_VEHICLE_CLOCK")
    phone = phone.withColumn("label_source", F.when(F.col("__tied"), by_car).when(F.col("__own"), "TIER_3_SMARTPHONE_GNSS").otherwise("UNAVAILABLE"))
    source = F.col("label_source")
    value = F.when(source.isin("TIER_1_VEHICLE_SYNCED", "TIER_2_VEHICLE_CLOCK"), F.col("__ref")).when((source == "TIER_3_SMARTPHONE_GNSS") & fresh, speed)
    phone = phone.withColumn("ref_velocity_mps", value.cast("float")).withColumn("label_available", F.col("ref_velocity_mps").isNotNull())
    quality = F.create_map(*[F.lit(x) for pair_ in TIERS.items() for x in pair_])[source]
    flags = FL.set_if(F.col("quality_flags"), source.isin("TIER_3_SMARTPHONE_GNSS", "UNAVAILABLE"), FL.QUALITY["REFERENCE_LOW_CONFIDENCE"])
    flags = FL.set_if(flags, F.coalesce(F.col("status") == "UNRESOLVED", F.lit(False)), FL.QUALITY["SYNC_UNRESOLVED"])
    out = phone.withColumn("label_quality", quality).withColumn("quality_flags", flags.cast("int"))
    return out.drop("u", "vehicle_file", "status", "estimated_offset_s", "__tied", "__pair", "__at", "__samples", "__ref", "__own")


def coverage(labelled: DataFrame) -> DataFrame:
    """A row per phone file: how many rows have a label, its mean and greatest value, and the share that stands."""
    v = F.col("ref_velocity_mps").cast("double")
    rest = F.when(v.isNotNull(), (v < STATIONARY_LABEL_MPS).cast("double"))
    return labelled.groupBy("source_file").agg(
        F.min_by("segment_id", F.struct("row_idx")).alias("segment_id"), F.first("session_id").alias("session_id"), F.first("label_source").alias("label_source"), F.first("label_quality").alias("label_quality"), F.count("*").alias("n_rows"),
        F.count(v).alias("labelled_rows"), (F.count(v) / F.count("*")).alias("coverage_fraction"), F.avg(v).alias("mean_label_mps"), F.max(v).alias("max_label_mps"), F.avg(rest).alias("stationary_fraction"),
    )
