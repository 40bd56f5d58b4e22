"""Shared folder handling, table materialisation and byte-level word splitting."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII blanks of the word rule [^\x20\x09-\x0D]+; bytes.split() with no argument cuts at exactly these.
BLANKS = b" \t\n\x0b\x0c\r"
WORD = "[^\\x20\\x09-\\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session.

    Where it is unset (tests in local mode) a folder on this machine is made and set; on a
    cluster that would lose data, so there it is an error.
    """
    try:
        found = spark.conf.get("spark.checkpoint.dir")
    except Exception:  # the key has no default in this Spark
        found = None
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is unset: the driver and the executors need a shared folder")
    made = "file://" + tempfile.mkdtemp(prefix="tracewright-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; nothing is created yet."""
    return f"{shared_dir(spark)}/tracewright/{name}-{uuid.uuid4().hex}"


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Holds session settings while a job runs, and puts back what was there."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class Workspace:
    """Tables of one run, each in a folder of its own in the shared folder.

    write() ends a lineage: a lost executor costs nothing that is behind the table. The shuffle files of the job go when it has ended. Tables are deleted by drop(), or all at
    once at the end of the `with` block, so what is returned from a block must be kept with keep=True; it stays in the shared folder until
    the caller or whoever clears that folder removes it.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name, self._paths = spark, name, {}

    def __enter__(self) -> Workspace:
        return self

    def __exit__(self, *_) -> None:
        self.drop(*list(self._paths))

    def write(self, df: DataFrame, name: str, keep: bool = False) -> DataFrame:
        """Stores the table under a name, in place of an older one of that name, which the new one may be made of."""
        path = scratch(self.spark, f"{self.name}-{name}")
        with settings(self.spark, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}):
            df.write.option("compression", "zstd").parquet(path)
        self.drop(name)
        if not keep:
            self._paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for n in names:
            if n in self._paths:
                delete(self.spark, self._paths.pop(n))

    def drop_all_but(self, *names: str) -> None:
        self.drop(*[n for n in self._paths if n not in names])


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared store."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """A table that stays in the shared folder."""
    return Workspace(df.sparkSession, name).write(df, "table", keep=True)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of few rows, so that a worker has few texts as Python objects at a time; Spark bounds a batch's bytes."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def keep_texts(docs: DataFrame, decide: Callable[[list[bytes | None]], list[bool]]) -> DataFrame:
    """The rows whose texts decide() keeps, judged in place, with all columns of docs whatever their names."""
    at = next(k for k, c in enumerate(docs.columns) if c.lower() == "text")
    plain = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])  # mapInArrow takes no names with dots

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield b.filter(pa.array(decide(b.column(at).cast(pa.binary()).to_pylist()), pa.bool_()))

    return plain.mapInArrow(kept, plain.schema).toDF(*docs.columns)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, *stems: str) -> list[str]:
    """Column names that begin like the stems and that the table doesn't have."""
    have = {c.lower() for c in df.columns}
    out = []
    for s in stems:
        while s.lower() in have:
            s += "_"
        out.append(s)
    return out


def all_columns(df: DataFrame) -> list:
    """The table's columns, whatever is in their names."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def ascii_lower(col):
    return F.translate(col, UPPER, LOWER)


def n_words(col):
    """Number of [^\\x20\\x09-\\x0D]+ in a string column; 0 for null."""
    return F.coalesce(F.regexp_count(col, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def fits_broadcast(df: DataFrame, most: int) -> bool:
    """Whether the table has at most so many rows; reads no more than one row beyond."""
    return df.limit(most + 1).count() <= most


def small_side_join(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner", most: int = 100_000, salt: int = 16) -> DataFrame:
    """Equi-join with a side that is small as a rule.

    The side is broadcast only if a count shows at most `most` rows. Beyond that, both sides are
    shuffled, and each key is spread over `salt` partitions, the small side's rows being repeated
    for each, so that a key with a large part of `big` meets many tasks.
    """
    if fits_broadcast(small, most):
        return big.join(F.broadcast(small), on, how)
    dealt = big.withColumn("__salt", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in big.columns if not c.startswith("__")]), F.lit(salt)).cast("int"))
    spread = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
    return dealt.join(spread, [*on, "__salt"], how).drop("__salt")
