"""Column profiles, plausibility, availability and quality scores; each is one aggregation, with partial sums before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Role, least, greatest, and what a value beyond may be.
BANDS = (
    ("gnss_latitude", -90.0, 90.0, "possible_data_error"), ("gnss_longitude", -180.0, 180.0, "possible_data_error"), ("gnss_altitude", -500.0, 9000.0, "possible_data_error"),
    ("gnss_speed", 0.0, 250.0, "possible_valid_extreme"), ("gnss_accuracy", 0.0, 1000.0, "possible_sensor_artifact"),
    ("accel_x", -50.0, 50.0, "possible_sensor_artifact"), ("accel_y", -50.0, 50.0, "possible_sensor_artifact"), ("accel_z", -50.0, 50.0, "possible_sensor_artifact"),
    ("gyro_yaw", -35.0, 35.0, "possible_sensor_artifact"), ("gyro_pitch", -35.0, 35.0, "possible_sensor_artifact"), ("gyro_roll", -35.0, 35.0, "possible_sensor_artifact"),
    ("velocity", 0.0, 250.0, "possible_valid_extreme"), ("vehicle_speed", 0.0, 250.0, "possible_valid_extreme"), ("heading", -360.0, 360.0, "possible_data_error"), ("yaw_rate", -200.0, 200.0, "possible_valid_extreme"),
    ("accel_longitudinal", -2.0, 2.0, "possible_valid_extreme"), ("accel_lateral", -2.0, 2.0, "possible_valid_extreme"), ("steering_angle", -720.0, 720.0, "possible_valid_extreme"), ("engine_speed", 0.0, 10000.0, "possible_sensor_artifact"),
)


def profile(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """A row per column: rows, blank, non-numeric, numeric, min, max, mean, population deviation (from two values on), constant.

    All columns are measured in one pass over the table; the unpivot comes after the aggregation. Numbers are taken as they are, texts are trimmed and parsed once, below the aggregation.
    """
    aggs, kinds, parsed = [], dict(df.dtypes), []
    for c in columns:
        number = kinds[c].split("(")[0] in ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")
        text = F.col(c) if number else F.trim(F.col(c).cast("string"))
        x = F.col(c).cast("double") if number else text.try_cast("double")
        parsed += [F.nanvl(x, F.lit(None).cast("double")).alias(f"__x_{c}"), (text.isNull() if number else text.isNull() | (text == "")).alias(f"__blank_{c}")]
    df = df.select(*(by or []), *parsed)
    for c in columns:
        x, blank = F.col(f"__x_{c}"), F.col(f"__blank_{c}")
        aggs.append(
            F.struct(
                F.lit(c).alias("column"), F.count("*").alias("n_rows"), F.count_if(blank).alias("n_blank"), F.count_if(~blank & x.isNull()).alias("n_non_numeric"), F.count(x).alias("n_numeric"),
                F.min(x).alias("min"), F.max(x).alias("max"), F.avg(x).alias("mean"), F.when(F.count(x) >= 2, F.stddev_pop(x)).alias("std"),
                F.coalesce((F.count(x) > 1) & (F.min(x) == F.max(x)), F.lit(False)).alias("constant"),
            ).alias(c)
        )
    keys = by or []
    wide = df.groupBy(*keys).agg(*aggs)
    return wide.select(*keys, F.explode(F.array(*[F.col(c) for c in columns])).alias("p")).select(*keys, "p.*")


def missingness(profiled: DataFrame) -> DataFrame:
    n = F.greatest(F.col("n_rows"), F.lit(1))
    return profiled.withColumn("missing_pct", 100.0 * F.col("n_blank") / n).withColumn("non_numeric_pct", 100.0 * F.col("n_non_numeric") / n)


def range_findings(profiled: DataFrame, role: str, bands=BANDS) -> DataFrame:
    """Columns whose range leaves the band of their role, and columns with a band that never change, as a possible sensor artifact. The bands are a fixed list of a few rows."""
    spark = profiled.sparkSession
    b = spark.createDataFrame(list(bands), f"{role} string, lo double, hi double, interpretation string")
    beyond = profiled.join(F.broadcast(b), role).where((F.col("min") < F.col("lo")) | (F.col("max") > F.col("hi")))
    constant = profiled.where("constant").join(F.broadcast(b.select(role)), role, "left_semi").withColumn("lo", F.lit(None).cast("double")).withColumn("hi", F.lit(None).cast("double")).withColumn("interpretation", F.lit("possible_sensor_artifact"))
    return beyond.unionByName(constant, allowMissingColumns=True)


def quality_score(*scores: Column) -> Column:
    """Mean of the sub-scores to four places, half to even."""
    return F.bround(sum(scores[1:], scores[0]) / len(scores), 4)


#: Score of each sampling class.
SAMPLING_SCORES = {"stable": 1.0, "mostly_stable": 0.75, "irregular": 0.4, "severely_irregular": 0.1, "unknown": 0.0}


def sub_scores(bad_times: Column, valid_times: Column, missing_pct: Column, sampling: Column, availability: Column) -> tuple[Column, Column, Column, Column]:
    """Timestamps (share that isn't backward, duplicate or without a step), completeness (mean over columns), sampling and availability, each from 0 to 1."""
    least = lambda c: F.bround(F.greatest(F.lit(0.0), c), 4)
    classes = F.create_map(*[F.lit(x) for pair in SAMPLING_SCORES.items() for x in pair])
    return (
        F.when(valid_times > 0, least(1.0 - bad_times / valid_times)).otherwise(0.0), F.coalesce(least(1.0 - missing_pct / 100.0), F.lit(0.0)),
        F.coalesce(classes[sampling], F.lit(0.0)), F.coalesce(F.bround(availability, 4), F.lit(0.0)),
    )


def integrity(n_tables: Column, n_pointers: Column, n_unreadable: Column, n_parse_failures: Column, n_other_encoding: Column) -> tuple[Column, Column]:
    """PASS, PASS_WITH_WARNINGS or FAIL, and the reasons."""
    fail = [(n_tables == 0, "no_tables"), ((n_tables > 0) & (n_pointers >= n_tables), "only_pointers"), (n_unreadable > 0, "unreadable")]
    warn = [((n_pointers > 0) & (n_pointers < n_tables), "some_pointers"), (n_parse_failures > 0, "parse_failures"), (n_other_encoding > 0, "not_utf8")]
    reasons = F.filter(F.array(*[F.when(c, F.lit(name)) for c, name in fail + warn]), lambda x: x.isNotNull())
    any_ = lambda items: F.greatest(*[c.cast("int") for c, _ in items]) == 1
    return F.when(any_(fail), "FAIL").when(any_(warn), "PASS_WITH_WARNINGS").otherwise("PASS"), reasons


def percentiles(df: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    q = F.percentile(column, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return df.groupBy(*(by or [])).agg(q.alias("q")).select(*(by or []), F.col("q")[0].alias("p25"), F.col("q")[1].alias("p50"), F.col("q")[2].alias("p75"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n"))


def rate_bucket(hz: Column) -> Column:
    """Sampling rate classes."""
    return F.when(hz.isNull(), "unknown").when((hz >= 0) & (hz < 3), "[0,3)").when((hz >= 3) & (hz < 15), "[3,15)").when((hz >= 15) & (hz < 40), "[15,40)").when((hz >= 40) & (hz < 5000), "[40,5000)").otherwise("other")
