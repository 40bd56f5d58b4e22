"""python -m tracewright.navigate CANONICAL OUT: evaluates the segments of an ingest and writes evaluations, trajectories, alignments, biases and a summary.

Segments that OUT holds already are skipped, so a run that was stopped goes on where it was; --limit takes so many of the others, in the order of their ids. Exit status 1 if there is nothing to do, 2 if no segment could be propagated.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from .plans import segments
from .session import build
from .sources import raw, sinks

ARTIFACTS = ("alignments", "biases", "trajectories", "evaluations")  # evaluations last: they say which segments are done


def finished(spark: SparkSession, out: str) -> DataFrame | None:
    try:
        return spark.read.parquet(f"{out}/evaluations").select("segment_id").distinct()
    except AnalysisException:
        return None


def run(spark: SparkSession, canonical: str, out: str, limit: int | None = None) -> int:
    rows = raw.load_segments(spark, canonical, "smartphone").withColumn("t_us", F.round(F.col("analysis_time_s") * 1e6).cast("long"))
    if "is_canonical_copy" in rows.columns:
        rows = rows.where("is_canonical_copy")
    todo = rows.select("segment_id").distinct()
    if (done := finished(spark, out)) is not None:
        todo = todo.join(done, "segment_id", "left_anti")
    if limit is not None:
        todo = todo.orderBy("segment_id").limit(limit)
    if todo.isEmpty():
        return 1
    made = segments.evaluate(rows.join(todo, "segment_id", "left_semi"))
    for name in ARTIFACTS:
        kept = made[name]
        if name != "evaluations" and (old := _there(spark, f"{out}/{name}")) is not None:
            kept = kept.join(old.select("segment_id").distinct(), "segment_id", "left_anti")  # of a run that stopped before its evaluations
        kept.write.mode("append").parquet(f"{out}/{name}")
    every = spark.read.parquet(f"{out}/evaluations")
    sinks.write_json(segments.summary(every), f"{out}/summary")
    sinks.write_json(segments.frame_summary(spark.read.parquet(f"{out}/alignments")), f"{out}/frame_summary")
    return 0 if not every.where("error IS NULL").isEmpty() else 2


def _there(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("canonical")
    p.add_argument("out")
    p.add_argument("--limit", type=int)
    a = p.parse_args(args)
    return run(build(), a.canonical, a.out, a.limit)


if __name__ == "__main__":
    sys.exit(main())
