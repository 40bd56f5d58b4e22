"""What a folder of raw recordings holds and how good it is: seventeen artifact tables, from one pass over the files' lines and one over the canonical rows that are written from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import flags as FL
from ..functions import geodesy as G
from ..operators import asof, ordered, quality, splits, timeline
from ..sources import raw, sinks
from . import reports

FILE = "source_file"
ARTIFACTS = (
    "dataset_manifest", "integrity_report", "session_inventory", "schema_inventory", "smartphone_schema", "vehicle_schema", "timestamp_report", "sampling_report", "synchronization_report", "gnss_outages", "gnss_availability",
    "missingness_report", "range_findings", "session_quality", "duplicate_groups", "trajectory_points", "representative_sessions",
)


def column_figures(lines: DataFrame, headers: DataFrame) -> DataFrame:
    """A row per file and column: role, rows, blank, non-numeric and numeric values, min, max, mean, deviation, constant. Lines become (file, column, value) and are summed up before the shuffle."""
    values = lines.where("line_no > 0").where(F.trim(F.rtrim("line", F.lit("\r"))) != "").select(FILE, F.posexplode(raw.fields(F.rtrim("line", F.lit("\r")))).alias("i", "v"))
    text = F.trim("v")
    x = F.nanvl(text.try_cast("double"), F.lit(None).cast("double"))
    parsed = values.select(FILE, "i", (text == "").alias("blank"), x.alias("x"))
    sums = parsed.groupBy(FILE, "i").agg(
        F.count("*").alias("n_rows"), F.count_if("blank").alias("n_blank"), F.count_if(~F.col("blank") & F.col("x").isNull()).alias("n_non_numeric"), F.count("x").alias("n_numeric"), F.min("x").alias("min"), F.max("x").alias("max"), F.avg("x").alias("mean"),
        F.when(F.count("x") >= 2, F.stddev_pop("x")).alias("std"), F.coalesce((F.count("x") > 1) & (F.min("x") == F.max("x")), F.lit(False)).alias("constant"),
    )
    return headers.join(sums, [FILE, "i"], "left").withColumn("role", F.coalesce("role", F.lit("unmapped")))


def observed(rows: DataFrame) -> tuple[DataFrame, Observation]:
    """The rows, and figures that are gathered while they are written."""
    seen = Observation("canonical")
    flag = lambda name: F.count_if(FL.has(F.col("quality_flags"), FL.QUALITY[name])).alias(name.lower())
    return rows.observe(seen, F.count(F.lit(1)).alias("n_rows"), *[flag(n) for n in FL.QUALITY]), seen


def artifacts(files: DataFrame, lines: DataFrame, headers: DataFrame, rows: DataFrame, figures: dict[str, int]) -> dict[str, DataFrame]:
    """The tables of ARTIFACTS. files: raw.inventory; headers: raw.headers; rows: canonical, written and read back, with t_us; figures: what was observed while they were written."""
    tables = files.where("extension = '.csv'")
    readable = tables.where("NOT is_pointer")
    groups = splits.duplicate_groups(readable, "sha256", FILE)
    sessions = splits.pair_streams(readable.where("session_id IS NOT NULL"), ["dataset_family", "session_id"], "stream", FILE)
    ids = raw.schema_ids(headers)
    by_file = headers.groupBy(FILE).agg(F.count_if(F.col("role").isNull()).alias("unmapped_columns"), F.array_sort(F.collect_list(F.when(F.col("role").isNull(), F.col("raw")))).alias("unmapped"))
    schemas = ids.join(by_file, FILE).join(readable.select(FILE, "stream"), FILE)
    columns = lambda stream: headers.join(readable.where(F.col("stream") == stream).select(FILE), FILE, "left_semi").groupBy("name", "unit", "role").agg(F.count_distinct(FILE).alias("files"), F.min("i").alias("first_position"), F.max("i").alias("last_position"))
    timing = timeline.timing(rows, [FILE], ["row_idx"], "t_us")
    whole = rows.groupBy(FILE).agg(
        F.first("stream").alias("stream"), F.first("analysis_time_source").alias("clock"), F.count("*").alias("n_rows"), F.count("t_us").alias("valid_times"), F.min("analysis_time_s").alias("first_s"), F.max("analysis_time_s").alias("last_s"),
        F.count_if(FL.has(F.col("quality_flags"), FL.QUALITY["NON_MONOTONIC_TIMESTAMP"])).alias("backward"), F.count_if(FL.has(F.col("quality_flags"), FL.QUALITY["DUPLICATE_TIMESTAMP"])).alias("duplicate"),
    )
    clocks = rows.where("time_of_day_s IS NOT NULL").withColumn("u", F.round(F.col("time_of_day_s") * 1e6).cast("long"))
    of = lambda s: clocks.where(F.col("stream") == s).select("dataset_family", "session_id", "u")
    fix = G.is_fix(F.col("latitude"), F.col("longitude"))
    fixes = rows.where("stream = 'smartphone'").withColumn("no_fix", ~F.coalesce(fix, F.lit(False)))
    outages = ordered.outages(fixes.where("t_us IS NOT NULL"), FILE, ["row_idx"], "t_us", "no_fix")
    updates = ordered.update_intervals(fixes, FILE, ["row_idx"], "t_us", ["latitude", "longitude"], fix)
    profiled = column_figures(lines, headers)
    missing = quality.missingness(profiled)
    complete = missing.groupBy(FILE).agg(F.avg("missing_pct").alias("missing_pct"))
    have = fixes.groupBy(FILE).agg((1.0 - F.avg(F.col("no_fix").cast("double"))).alias("availability"))
    facts = whole.join(timing.select(FILE, "sampling"), FILE, "left").join(complete, FILE, "left").join(have, FILE, "left")
    scores = quality.sub_scores(F.col("backward") + F.col("duplicate"), F.col("valid_times"), F.col("missing_pct"), F.col("sampling"), F.col("availability"))
    names = ("timestamp_score", "completeness_score", "sampling_score", "gnss_score")
    scored = facts.select(FILE, "stream", "n_rows", *[c.alias(n) for c, n in zip(scores, names, strict=True)])
    scored = scored.withColumn("quality_score", quality.quality_score(*map(F.col, names)))
    overlap = asof.overlap(of("smartphone"), of("vehicle"), ["dataset_family", "session_id"], "u")
    findings = quality.range_findings(profiled, "role")
    lost = outages.groupBy(FILE).agg(F.count("*").alias("outages"), F.sum("duration_s").alias("outage_s"))
    first = sessions.where("paired").select("dataset_family", "session_id", F.col("first_smartphone").alias(FILE))
    shared = overlap.join(first, ["dataset_family", "session_id"]).groupBy(FILE).agg(F.max("aligned_overlap_s").alias("overlap_s"))
    facts = facts.join(findings.groupBy(FILE).agg(F.count("*").alias("n_findings")), FILE, "left").join(lost, FILE, "left").join(shared, FILE, "left").join(readable.select(FILE, "session_id"), FILE, "left")
    shown = facts.fillna(0, ["n_findings", "outages"]).withColumn("timestamp_score", scores[0])
    encodings = lines.where("line_no = 0").select(FILE, (~F.is_valid_utf8(F.encode("line", "ISO-8859-1"))).alias("other"))
    counts = files.agg(F.count("*").alias("files"), F.count_if("is_pointer").alias("pointers"), F.count_if(F.col("extension") == ".csv").alias("tables"), F.count_if((F.col("extension") == ".csv") & F.col("is_pointer")).alias("table_pointers"), F.count_distinct("dataset_family").alias("families"))
    one = counts.withColumns({
        "not_utf8": F.lit(encodings.where("other").count()), "schema_variants": F.lit(ids.select("schema_id").distinct().count()), "duplicate_groups": F.lit(groups.count()), "parse_failures": F.lit(readable.join(whole, FILE, "left_anti").count()),
        "sessions": F.lit(sessions.count()), "paired_sessions": F.lit(sessions.where("paired").count()),
    } | {name: F.lit(n) for name, n in figures.items()})
    status, reasons = quality.integrity(F.col("tables"), F.col("table_pointers"), F.lit(0), F.col("parse_failures"), F.col("not_utf8"))
    return {
        "dataset_manifest": files.withColumn("is_directory", F.lit(False)).unionByName(raw.folders(files)),
        "integrity_report": one.withColumn("integrity_status", status).withColumn("reasons", reasons),
        "session_inventory": sessions,
        "schema_inventory": schemas,
        "smartphone_schema": columns("smartphone"),
        "vehicle_schema": columns("vehicle"),
        "timestamp_report": whole,
        "sampling_report": timing,
        "synchronization_report": overlap,
        "gnss_outages": outages,
        "gnss_availability": updates,
        "missingness_report": missing,
        "range_findings": findings,
        "session_quality": scored,
        "duplicate_groups": groups,
        "trajectory_points": fixes.where("gnss_position_fresh").select(FILE, "row_idx", "analysis_time_s", "latitude", "longitude", "altitude_m"),
        "representative_sessions": reports.representatives(shown),
    }


def run(spark: SparkSession, root: str, out: str) -> dict[str, int]:
    """Writes canonical rows and the artifacts below out; the figures observed while the rows were written."""
    rows, seen = observed(raw.canonical(spark, root))
    sinks.write_canonical(rows, f"{out}/canonical")
    figures = {k: int(v) for k, v in seen.get.items()}
    back = raw.load_segments(spark, f"{out}/canonical").withColumn("t_us", F.round(F.col("analysis_time_s") * 1e6).cast("long"))
    lines = raw.lines(spark, root)
    headers = raw.headers(lines.where("line_no = 0").select(FILE, F.rtrim("line", F.lit("\r")).alias("header")))
    made = artifacts(raw.inventory(spark, root), lines, headers, back, figures)
    sinks.write_views(made, f"{out}/artifacts")
    return figures
