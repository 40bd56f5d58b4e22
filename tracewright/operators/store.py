"""Tables between the jobs of one operator, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; made on this machine where it is unset and the master is local."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is unset: tables between jobs need a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="tracewright-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


class Tables:
    """Stored tables of a run, each under a new path; a lost executor costs nothing that is behind one."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder, self._count = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}", 0

    def keep(self, df: DataFrame) -> tuple[DataFrame, str]:
        """The stored table, and its path for drop()."""
        path = f"{self.folder}/{self._count}"
        self._count += 1
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path), path

    def drop(self, *paths: str) -> None:
        for path in paths:
            at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
