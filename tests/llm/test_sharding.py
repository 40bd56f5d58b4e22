from __future__ import annotations

import os

import pyarrow.parquet as pq
import pytest

from tracewright.llm import registry, sharding
from tracewright.llm.common import scratch


def rows(df):
    return sorted(map(str, df.collect()))


def test_append_compact_vacuum(spark, make_docs):
    docs = make_docs([(i, f"text {i} " * (i % 40)) for i in range(2000)])
    store = sharding.ShardStore(spark, scratch(spark, "t"), docs.schema, target_bytes=60_000)
    assert store.scan().count() == 0 and store.version() == 0
    for k in range(3):
        store.append(docs.where(f"doc_id % 3 = {k}").repartition(6))
    before = store.manifest()
    assert before.count() == 18 and store.version() == 3
    v = store.compact()
    after = store.manifest()
    assert v == 4 and after.count() < 18 and after.agg({"rows": "sum"}).first()[0] == 2000
    assert all(r.bytes < 2.5 * 60_000 for r in after.collect())
    assert rows(store.scan().select(docs.columns)) == rows(docs)
    assert rows(store.scan(3).select(docs.columns)) == rows(docs)  # older versions stay readable
    assert store.vacuum() > 0
    assert rows(store.scan().select(docs.columns)) == rows(docs)


def test_shard_leaves_no_run(spark, make_docs, monkeypatch):
    """Rounds go on until one finds nothing to rewrite."""
    todo, compact = [], sharding.ShardStore.compact

    def seen(store):
        todo.append(store.plan(store.manifest()).count())
        return compact(store)

    monkeypatch.setattr(sharding.ShardStore, "compact", seen)
    docs = make_docs([(i, f"text {i} " * (i % 40)) for i in range(2000)]).repartition(6)
    out = sharding.shard(spark, docs, scratch(spark, "t"), target_bytes=60_000)
    assert todo[0] > 0 and todo[-1] == 0
    assert rows(out.select(docs.columns)) == rows(docs)


def test_of_two_writers_one_fails(spark, make_docs):
    docs = make_docs([(1, "a")])
    store = sharding.ShardStore(spark, scratch(spark, "t"), docs.schema)
    store.commit(store.manifest(0), 0)
    with pytest.raises(sharding.Conflict):
        store.commit(store.manifest(0), 0)
    assert store.version() == 1


def test_edges(spark, make_docs, awkward):
    docs = make_docs(awkward)
    out = sharding.shard(spark, docs, scratch(spark, "t"))
    assert rows(out.select(docs.columns)) == rows(docs)
    one = out.groupBy("__shard", "__shard_rows").count().collect()
    assert all(r["__shard_rows"] == r["count"] for r in one)
    assert sharding.shard(spark, make_docs([]), scratch(spark, "t")).count() == 0


def test_vacuum_during_an_append(spark, make_docs):
    """Files that a writer has written but not committed outlive a vacuum; once old enough, files that no version names go."""
    docs = make_docs([(i, "text") for i in range(50)])
    store = sharding.ShardStore(spark, scratch(spark, "t"), docs.schema)
    store.append(docs.repartition(3))
    seen, folder = store.version(), "data/append-slow"
    docs.write.parquet(f"{store.root}/{folder}")
    store.compact()
    assert store.vacuum() == 3  # what the merge replaced
    with pytest.raises(sharding.Conflict):
        store.commit(store.manifest(seen + 1).unionByName(store._listed(folder, seen + 1)), seen)
    store.commit(store.manifest().unionByName(store._listed(folder, seen + 2)), seen + 1)
    assert rows(store.scan().select(docs.columns)) == sorted(rows(docs) * 2)
    docs.write.parquet(f"{store.root}/data/append-lost")
    assert store.vacuum() == 0 and store.vacuum(grace_s=-60) > 0
    assert rows(store.scan().select(docs.columns)) == sorted(rows(docs) * 2)


def test_plan_against_brute_force(spark, make_docs):
    """Tiers, runs and what is left alone, worked out in Python."""
    store = sharding.ShardStore(spark, scratch(spark, "t"), make_docs([]).schema, target_bytes=1000)
    sizes = [10, 15, 1200, 900, 300, 310, 320, 330, 340, 70, 4000, 999, 5, 260, 270]
    tier = lambda b: max(k for k in range(12) if 4**k <= b)
    shards = spark.createDataFrame([(f"data/{i:02d}.parquet", 1, b, tier(b), 1) for i, b in enumerate(sizes)], sharding.MANIFEST)
    want = {}
    for t in {tier(b) for b in sizes}:
        upto = 0
        for i, b in enumerate(sizes):
            if tier(b) == t and b < 1000:
                upto += b
                want.setdefault((t, int((upto - b / 2) // 1000)), []).append(f"data/{i:02d}.parquet")
    want = [sorted(p) for _, p in sorted(want.items()) if len(p) >= 2]
    got = {}
    for r in store.plan(shards).collect():
        got.setdefault(r.run, []).append(r.path)
    assert [sorted(p) for _, p in sorted(got.items())] == want and len(want) > 2


def test_clashing_columns(spark, make_docs):
    docs = make_docs([(i, "text " * i) for i in range(40)]).withColumnRenamed("row", "__shard_run").withColumnRenamed("cls", "__shard").withColumnRenamed("size", "__shard_file").withColumnRenamed("lang", "a.b")
    out = sharding.shard(spark, docs.repartition(4), scratch(spark, "t"))
    quoted = [f"`{c}`" for c in docs.columns]
    assert rows(out.select(*quoted)) == rows(docs) and out.columns[-5:] == ["__shard_", "__shard_rows", "__shard_bytes", "__shard_tier", "__shard_version"]
    other = spark.createDataFrame([({"a": 1}, "x")], "m map<string,int>, t string")
    assert sharding.shard(spark, other, scratch(spark, "t")).count() == 1


def test_query_against_the_files(spark, make_docs, awkward, tmp_path, monkeypatch):
    """Every column of the query, from the committed version's files read one by one."""
    root = str(tmp_path / "store")
    monkeypatch.setattr(registry, "scratch", lambda *_: root)
    docs = [*awkward, *[(i, f"text {i} " * (i % 30)) for i in range(100, 600)]]
    make_docs(docs).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((tuple(r) for r in registry.op3_sharding(spark, str(tmp_path)).select("doc_id", "text_chars", "shard", "shard_rows", "shard_bytes", "shard_tier", "manifest_version").collect()), key=str)
    versions = sorted((tmp_path / "store/manifest").glob("v*"))
    live = sorted(r[0] for r in spark.read.parquet(str(versions[-1])).select("path").collect())
    want = []
    for n, path in enumerate(live):
        table, size, tier = pq.ParquetFile(f"{root}/{path}").read(["doc_id", "text"]).to_pylist(), os.path.getsize(f"{root}/{path}"), 0
        while sharding.TIER_FACTOR ** (tier + 1) <= size:
            tier += 1
        want += [(r["doc_id"], None if r["text"] is None else len(r["text"]), n, len(table), size, tier, int(versions[-1].name[1:])) for r in table]
    assert got == sorted(want, key=str) and sorted(str(r[:2]) for r in got) == sorted(str((k, None if t is None else len(t))) for k, t in docs)
