"""Size-tiered compaction of immutable shards under a versioned manifest, in DataFrame functions only.

append() writes what arrives as small Parquet shards beside those that exist. compact() puts the live
shards into tiers by the power of TIER_FACTOR of their size, lines up each tier's shards into runs of
about the target size, and rewrites each run of at least MIN_RUN shards as one file. Shards of the
target size or more are never rewritten. Every step ends with one commit: the new list of live shards is
written aside and becomes version n + 1 by an atomic rename that fails if that version exists, so a reader
sees the old list or the new one, and of two writers one has to try again. Files are never changed in place;
vacuum() deletes those that only versions before the kept ones name; files that no version names may be of a writer that hasn't committed yet, so they go only when older than GRACE_S.

Only the list of shards (paths, sizes, counts) is handled on the driver, never rows.

Defined results: nulls, empty and very long texts, ties and repeated rows are kept as they are; an empty table
commits a version without shards and reads as an empty table; columns of any name are kept: where a table has a column named like one that scan() or a merge adds, the added one gets
underscores behind its name. shard() deals arrivals by doc_id, or by a hash of the first column that can be hashed where there is none.
"""

from __future__ import annotations

import math
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import settings, unused

TARGET_BYTES = 32 << 20
TIER_FACTOR, MIN_RUN = 4, 2
GRACE_S = 7 * 24 * 3600
#: A job's shuffle files go when it has ended.
CLEAN = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
ADDED = ("__shard", "__shard_rows", "__shard_bytes", "__shard_tier", "__shard_version")
MANIFEST = "path string, rows bigint, bytes bigint, tier int, added bigint"
CODEC = "zstd"


def _inside(path):
    """A file's path below the store's root."""
    return F.concat(F.lit("data/"), F.substring_index(path, "/data/", -1))


class Conflict(RuntimeError):
    """Another writer committed this version first."""


class ShardStore:
    """Shards below root, which is a path that all executors share."""

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, target_bytes: int = TARGET_BYTES):
        self.spark, self.root, self.schema, self.target = spark, root.rstrip("/"), schema, target_bytes
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(self.root).getFileSystem(conf)
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), conf)
        self._no_overwrite = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        self._fs.mkdirs(self._path(f"{self.root}/manifest"))

    def version(self) -> int:
        return max(self._versions(), default=0)

    def _versions(self) -> list[int]:
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.root}/manifest"))]
        return [int(n[1:]) for n in names if n.startswith("v")]

    def manifest(self, version: int | None = None) -> DataFrame:
        """The live shards of a version, by default of the last."""
        v = self.version() if version is None else version
        if v == 0:
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifest/v{v:08d}")

    def commit(self, shards: DataFrame, seen: int) -> int:
        """Makes shards the version after `seen`, or raises Conflict."""
        aside, to = f"{self.root}/manifest/_{uuid.uuid4().hex}", f"{self.root}/manifest/v{seen + 1:08d}"
        shards.coalesce(1).write.parquet(aside)
        try:
            self._context.rename(self._path(aside), self._path(to), self._no_overwrite)
        except Exception as e:
            self._fs.delete(self._path(aside), True)
            if "FileAlreadyExists" in str(e):
                raise Conflict(to) from e
            raise
        return seen + 1

    def _listed(self, folder: str, version: int) -> DataFrame:
        """Manifest rows for the files with rows in a folder below root."""
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(f"{self.root}/{folder}").select("path", F.col("length").alias("bytes"))
        rows = self.spark.read.schema(self.schema).option("recursiveFileLookup", "true").parquet(f"{self.root}/{folder}")
        rows = rows.groupBy(_inside(F.col("_metadata.file_path")).alias("path")).agg(F.count("*").alias("rows"))
        files = files.withColumn("path", _inside(F.col("path")))
        tier = F.floor(F.log(F.greatest(F.col("bytes"), F.lit(1))) / math.log(TIER_FACTOR)).cast("int")
        return files.join(rows, "path").select("path", "rows", "bytes", tier.alias("tier"), F.lit(version).cast("bigint").alias("added"))

    def append(self, rows: DataFrame, arrival: str | None = None) -> int:
        """Adds rows as new shards; the column `arrival`, if given, keeps arrivals in files of their own and isn't stored."""
        seen, folder = self.version(), f"data/append-{uuid.uuid4().hex[:12]}"
        out = rows.write.option("compression", CODEC)
        with settings(self.spark, CLEAN):
            (out.partitionBy(arrival) if arrival else out).parquet(f"{self.root}/{folder}")
        return self.commit(self.manifest(seen).unionByName(self._listed(folder, seen + 1)), seen)

    def plan(self, shards: DataFrame) -> DataFrame:
        """(path, run) of the shards to rewrite: runs of neighbours in a tier, about the target size each."""
        by = W.partitionBy("tier").orderBy("path").rowsBetween(W.unboundedPreceding, W.currentRow)
        small = shards.where(F.col("bytes") < self.target).withColumn("upto", F.sum("bytes").over(by))
        runs = small.withColumn("k", F.floor((F.col("upto") - F.col("bytes") / 2) / self.target))
        runs = runs.withColumn("n", F.count("*").over(W.partitionBy("tier", "k"))).where(F.col("n") >= MIN_RUN)
        return runs.select("path", F.dense_rank().over(W.orderBy("tier", "k")).alias("run"))

    def compact(self) -> int:
        """One round of compaction; gives the version, which is the old one if there was nothing to do."""
        seen = self.version()
        shards = self.manifest(seen)
        todo = self.plan(shards).collect()  # of the list of shards
        if not todo:
            return seen
        folder, n = f"data/merge-{uuid.uuid4().hex[:12]}", max(r["run"] for r in todo)
        file, run = unused(self._empty(), "__shard_file", "__shard_run")
        plan = self.spark.createDataFrame([(r["path"], r["run"]) for r in todo], f"`{file}` string, `{run}` int")
        rows = self.read([r["path"] for r in todo]).withColumn(file, _inside(F.col("_metadata.file_path")))
        # One row per file of this round, so the list is as small as the manifest that the driver holds already.
        rows = rows.join(F.broadcast(plan), file).drop(file)
        with settings(self.spark, CLEAN):  # a task for each run
            rows.repartitionById(n, F.col(run) - 1).write.option("compression", CODEC).partitionBy(run).parquet(f"{self.root}/{folder}")
        gone = self.spark.createDataFrame([(r["path"],) for r in todo], "path string")
        return self.commit(shards.join(gone, "path", "left_anti").select("path", "rows", "bytes", "tier", "added").unionByName(self._listed(folder, seen + 1)), seen)

    def _empty(self) -> DataFrame:
        return self.spark.createDataFrame([], self.schema)

    def read(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*[f"{self.root}/{p}" for p in paths])

    def added(self) -> list[str]:
        """The names of the columns that scan() adds: ADDED, or longer where the table has such columns."""
        return unused(self._empty(), *ADDED)

    def scan(self, version: int | None = None) -> DataFrame:
        """All rows of a version and, in the columns added(), the shard's number in path order, its rows, bytes and tier, and the version."""
        v = self.version() if version is None else version
        live, names = self.manifest(v), self.added()
        paths = [r["path"] for r in live.select("path").orderBy("path").collect()]
        if not paths:
            return self._empty().select("*", *[F.lit(None).cast(t).alias(c) for c, t in zip(names, ("int", "bigint", "bigint", "int", "bigint"), strict=True)])
        (file,) = unused(self._empty(), "__shard_file")
        values = [(F.row_number().over(W.orderBy("path")) - 1), F.col("rows"), F.col("bytes"), F.col("tier"), F.lit(v).cast("bigint")]  # a row per shard
        facts = live.select(F.col("path").alias(file), *[c.alias(n) for c, n in zip(values, names, strict=True)])
        return self.read(paths).withColumn(file, _inside(F.col("_metadata.file_path"))).join(F.broadcast(facts), file).drop(file)

    def vacuum(self, keep: int = 1, grace_s: float = GRACE_S) -> int:
        """Deletes the files that none of the last `keep` versions names, and the older manifests; gives the number of files.

        A file that an older version names is known to be replaced. One that no version names may be written just now by a writer that hasn't committed: it goes only when older than grace_s.
        """
        v = self.version()
        named = {n: {r["path"] for r in self.manifest(n).select("path").collect()} for n in self._versions()}
        live = set().union(*[p for n, p in named.items() if n > v - keep])
        old = set().union(*named.values()) - live
        gone, before = 0, (time.time() - grace_s) * 1000
        found = self._fs.listFiles(self._path(f"{self.root}/data"), True)
        while found.hasNext():
            status = found.next()
            p = status.getPath()
            inside = "data/" + p.toString().rpartition("/data/")[2]
            if inside.endswith(".parquet") and inside not in live and (inside in old or status.getModificationTime() < before):
                gone += bool(self._fs.delete(p, False))
        for n in named:
            if n <= v - keep:
                self._fs.delete(self._path(f"{self.root}/manifest/v{n:08d}"), True)
        return gone


def arrival_wave(key) -> F.col:
    """Splits rows into four arrivals of 1/2, 1/4, 1/8 and 1/8 by a hash of the key."""
    h = F.pmod(F.xxhash64(key), F.lit(16))
    return F.when(h < 8, 0).when(h < 12, 1).when(h < 14, 2).otherwise(3)


def shard(spark: SparkSession, docs: DataFrame, root: str, target_bytes: int = TARGET_BYTES) -> DataFrame:
    """Stores docs in arrivals, compacts them until no run is left to rewrite, drops what is no longer live after each round, and reads the last version back."""
    store = ShardStore(spark, root, docs.schema, target_bytes)
    (arrival,) = unused(docs, "__shard_arrival")
    key = next((f.name for f in docs.schema if f.name.lower() == "doc_id"), None) or next((f.name for f in docs.schema if "map<" not in f.dataType.simpleString()), None)
    store.append(docs.withColumn(arrival, F.lit(0) if key is None else arrival_wave(F.col("`" + key.replace("`", "``") + "`"))), arrival)
    seen = store.version()
    while (version := store.compact()) != seen:  # a round has fewer shards than the one before
        seen = version
        store.vacuum()
    return store.scan()
