"""A corpus pipeline of five stages over the documents table.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before it kept, which is written as Parquet and read again; run() deletes a stage's table when the next one is written.

Defined results, for all stages: a null or empty text has no word, so the quality rules drop its row and no later stage meets it; given to a later stage alone, it has no near copy and no contamination, stays there, and
the mix takes it zero times. Null doc_ids are documents like others, without near copies. Very long texts are read whole. Repeated rows: one of the copies stays in the near-duplicate stage; the mix may give a row out twice. Ties
(equal scores, equal hashes, repeated ids) go by the operators' docstrings. An empty table gives an empty table with the same columns. Extra columns of any name are kept; where documents has a column named like
one that the last stage adds, the added one gets underscores behind its name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm import decontaminate, mixing, near_dedup, quality_rules, sharding
from tracewright.llm.common import all_columns, delete, scratch, table, unused


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality rules reject."""
    return quality_rules.keep_good(docs, table(spark, sf_dir, "labels"))


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies."""
    return near_dedup.drop_near_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that benchmark items contaminate."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Gives each document out where the slot schedule reads its first word: never, once or twice, in the schedule's order."""
    return mixing.mix_documents(spark, docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stores the rows in compacted shards and reads them from the committed version, with the shard of each."""
    out = sharding.shard(spark, docs, scratch(spark, "shards"))
    added = out.columns[len(docs.columns) :]
    names = unused(docs, "shard", "shard_rows", "shard_bytes", "shard_tier", "manifest_version")
    return out.select(*all_columns(docs), *[F.col(a).alias(n) for a, n in zip(added, names, strict=True)])


STAGES = [("quality rules", quality), ("near-duplicates", dedup), ("decontamination", decontamination), ("mixing", mix), ("sharding", shards)]

#: An isolation forest has no SQL; tests/llm holds the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    before = None
    for k, (name, stage) in enumerate(STAGES):
        path = scratch(spark, f"stage-{k}-{name.replace(' ', '-')}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before is not None:
            delete(spark, before)
        before = path
    return docs
