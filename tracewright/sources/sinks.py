"""Tables to files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


BUCKETS = 64


def bucket(segment: Column) -> Column:
    """The folder of a segment."""
    return F.pmod(F.xxhash64(segment), F.lit(BUCKETS)).cast("int")


def write_canonical(rows: DataFrame, path: str) -> None:
    """Parquet by stream and bucket of segments, sorted by segment, so that a segment is a few row groups of one folder however many segments there are. A segment that was recorded in several files keeps them all, is_canonical_copy marks the first file's rows."""
    first = F.min("source_file").over(W.partitionBy("segment_id"))
    marked = rows.withColumn("is_canonical_copy", F.col("source_file") == first).withColumn("bucket", bucket(F.col("segment_id")))
    marked.repartition("stream", "bucket").sortWithinPartitions("stream", "bucket", "segment_id", "source_file", "row_idx").write.mode("overwrite").option("compression", "snappy").partitionBy("stream", "bucket").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """One headed CSV file, for tables of report size."""
    df.coalesce(1).write.mode("overwrite").option("header", "true").csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").json(path)


def splits_json(assigned: DataFrame, split: str = "split", segment: str = "segment_id") -> DataFrame:
    """One JSON object: segments in order for each split."""
    by = assigned.groupBy(split).agg(F.sort_array(F.collect_list(segment)).alias("s"))
    return by.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(split), F.col("s")))))).alias("json"))


def write_views(views: dict[str, DataFrame], folder: str) -> list[str]:
    for name, df in views.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
    return sorted(views)
