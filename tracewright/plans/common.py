"""Tables as the queries bind them, and rounding that both engines share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

E_SQL = "e AS (SELECT event_id, user_id AS k, epoch_us(ts) AS t, value AS x, event_type FROM events)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts: str) -> Column:
    """Microseconds of a timestamp without zone, whatever the session's zone."""
    c = F.col(ts)
    return F.unix_date(c.cast("date")).cast("bigint") * 86_400_000_000 + F.hour(c).cast("bigint") * 3_600_000_000 + F.minute(c).cast("bigint") * 60_000_000 + (F.expr(f"extract(SECOND FROM {ts})") * 1_000_000).cast("bigint")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, k (the user), t (microseconds), x (value, null for NaN), event_type."""
    return table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("k"), micros("ts").cast("bigint").alias("t"), F.nanvl("value", F.lit(None).cast("double")).alias("x"), "event_type")


def r(c, digits: int = 6) -> Column:
    """Rounded, with no negative zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + F.lit(0.0)


def rs(expr: str, digits: int = 6) -> str:
    return f"(round({expr}, {digits}) + 0.0)"


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: r(c, digits) for c in cols})
