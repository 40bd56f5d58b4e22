"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "gap_segments", "staleness_locf", "asof_interpolate", "lag_correlation", "rolling_std_range", "stationary_runs", "nonuniform_gradient", "mechanize_prefix", "causal_windows",
    "timing_stats", "column_profile", "direction_fit", "mean_direction_spread", "duplicate_content", "leakage_audit", "split_assign", "quat_ops", "enu_projection", "orientation_scan",
]


#: Timed too, but not part of the total, which stays comparable.
MORE = ["gyro_mechanize", "residual_lag"]
HEADER = "GPS LATITUDE (degrees), GPS LONGITUDE (degrees), GPS ALTITUDE (m), GPS SPEED (Kmh), GPS ACCURACY (m), GPS ORIENTATION (deg), GPS SATELLITES IN RANGE, TIME SINCE START (ms), DATE (YYYY-MO-DD HH-MI-SS_SSS), ACCELEROMETER X (m/s2), ACCELEROMETER Y (m/s2), ACCELEROMETER Z (m/s2)"


def canonical_rows(spark: SparkSession, sf_dir: str) -> float:
    """Rows a second from raw CSV to canonical columns; the recordings are made of events, four files of a quarter each."""
    from pyspark.sql import functions as F

    from tracewright.sources import raw

    root = tempfile.mkdtemp(prefix="bench-")
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "value")
    i = F.floor(F.col("event_id") / 4)
    clock = F.date_format(F.timestamp_millis(F.lit(1567936800000) + i * 100), "yyyy-MM-dd HH:mm:ss:SSS")
    x = F.format_string("%.2f", F.col("value"))
    line = F.concat_ws(",", F.format_string("%.6f", F.lit(52.4) + i * 1e-6), F.lit("-1.5,147.5"), x, F.lit("3,241.6,27 / 28"), (i * 100).cast("string"), clock, x, F.lit("1.5,9.8"))
    for k in range(4):
        text = rows.where(f"event_id % 4 = {k}").orderBy("event_id").select(line).toPandas().iloc[:, 0]
        with open(f"{root}/S-B{k}.csv", "w") as f:
            f.write("\n".join([HEADER, *text]) + "\n")
    began = time.time()
    raw.canonical(spark, root).write.format("noop").mode("overwrite").save()
    return round(rows.count() / (time.time() - began))


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from tracewright.plans import catalog

    took: dict[str, float] = {}
    more: dict[str, float] = {}
    catalog.QUERIES[HEADLINE[0]](spark, sf_dir).write.format("noop").mode("overwrite").save()  # starts the JVM's threads
    for name in [*HEADLINE, *MORE]:
        if name in catalog.QUERIES:
            began = time.time()
            catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            (took if name in HEADLINE else more)[name] = round(time.time() - began, 3)
    rates = {"canonical": canonical_rows(spark, sf_dir)}
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")), "more": more, "rows_per_s": rates}))


if __name__ == "__main__":
    main()
