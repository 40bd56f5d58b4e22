from __future__ import annotations

import corpus_pipeline
from pyspark.sql import functions as F
from test_near_dedup import brute as near
from test_decontaminate import brute as hits
from tracewright.llm import quality_rules

D = "/root/testdata/sf0.001"


def test_stages_one_by_one(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{D}/benchmark.parquet").collect()]
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        out = stage(spark, docs, D)
        path = corpus_pipeline.scratch(spark, "test-stage")
        out.write.parquet(path)
        after = spark.read.parquet(path)
        ids = [r.doc_id for r in after.select("doc_id").collect()]
        if name == "quality rules":
            judged = quality_rules.judge(docs, spark.read.parquet(f"{D}/labels.parquet")).where("kept").collect()
            assert sorted(ids) == sorted(r.doc_id for r in judged)
        elif name == "near-duplicates":
            assert sorted(ids) == sorted(i for i, _, c in near(sorted(before.items())) if i == c)
        elif name == "decontamination":
            bad = {i for i, t in before.items() if (h := hits(t, items))[1] and 20 * h[1] >= h[0]}
            assert sorted(ids) == sorted(set(before) - bad)
        elif name == "mixing":
            assert set(ids) <= set(before) and max(ids.count(i) for i in set(ids)) <= 2
        else:
            assert sorted(ids) == seen["ids"] and "shard" in after.columns
        if name != corpus_pipeline.STAGES[-1][0]:
            assert after.columns == docs.columns
        seen["ids"], docs = sorted(ids), after


def test_run(spark):
    out = corpus_pipeline.run(spark, D)
    assert out.count() > 0 and {"doc_id", "text", "shard", "manifest_version"} <= set(out.columns)


def test_awkward_tables(spark, tmp_path, awkward):
    """Nulls, repeats, long texts and columns named like the stages' own go through all stages; so does an empty table."""
    good = [(100 + i, " ".join(f"word{(i * 31 + k * 7) % 997}" for k in range(40 + i % 9))) for i in range(60)]
    names = ["shard", "shard_rows", "manifest_version", "__target", "__sid", "__size", "__order", "a.b", "near_id", "mix_slot", "__shard_run"]
    labels = spark.createDataFrame([(i, int(i % 2)) for i, _ in good], "doc_id long, quality int").withColumn("toxic", F.lit(0))
    bench = spark.createDataFrame([(1, "no such words anywhere")], "item_id long, text string")
    for k, rows in enumerate(([*awkward, *good, good[0], (good[1][0], "another text " * 30)], [])):
        folder = f"{tmp_path}/t{k}"
        docs = spark.createDataFrame([(i, t, ["a", "b", None][(i or 0) % 3]) for i, t in rows], "doc_id long, text string, source string")
        for c in names:
            docs = docs.withColumn(c, F.concat(F.lit(c), "doc_id"))
        docs.write.parquet(f"{folder}/documents.parquet")
        labels.write.parquet(f"{folder}/labels.parquet")
        bench.write.parquet(f"{folder}/benchmark.parquet")
        out = corpus_pipeline.run(spark, folder)
        assert out.columns == [*docs.columns, "shard_", "shard_rows_", "shard_bytes", "shard_tier", "manifest_version_"]
        got = out.collect()
        assert bool(got) == bool(rows)
        assert all(r[c] is None if r.doc_id is None else r[c] == f"{c}{r.doc_id}" for r in got for c in names)
        assert {(r.doc_id, r.text) for r in got} <= set(rows)
