from __future__ import annotations

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tracewright.llm import mixing


def level(sizes):
    """Targets by resharing again and again, as the contract words it."""
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    left, open_, out = 1.5 * sum(sizes.values()), set(sizes), dict.fromkeys(sizes, 0.0)
    while open_ and left > 1e-9:
        total, over = sum(weight[s] for s in open_), 0.0
        for s in list(open_):
            out[s] += left * weight[s] / total
            if out[s] >= 2 * sizes[s]:
                over += out[s] - 2 * sizes[s]
                out[s] = 2.0 * sizes[s]
                open_.discard(s)
        left = over
    return out


ROWS = [(i, " ".join(["w"] * (i * 7919 % 53)), ["b", "a", None, "é", "z"][min(4, i * 31 % 9)]) for i in range(300)] + [(7, "one two", "a"), (7, "one two", "a"), (None, "no id", "b"), (900, None, "none")]


def test_targets_and_shares(spark, make_docs):
    out = mixing.mix(spark, make_docs(ROWS)).collect()
    assert len(out) == len(ROWS)
    assert all(0 <= r.taken <= 2 * r.size for r in out)
    sizes = defaultdict(int)
    for r in ROWS:
        sizes[r[2] if len(r) > 2 else "s"] += len((r[1] or "").split())
    want = sorted((sizes[s], round(t, 6)) for s, t in level(sizes).items())
    assert sorted({(r.source_size, round(r.target, 6)) for r in out}) == sorted(set(want))
    taken = defaultdict(int)
    for r in out:
        taken[r.source_size, round(r.target, 6)] += r.taken
    assert all(abs(n - t) <= 2 for (_, t), n in taken.items())


def test_reruns_agree(spark, make_docs):
    a, b = (sorted(map(str, mixing.mix(spark, make_docs(ROWS).repartition(n)).collect())) for n in (1, 5))
    assert a == b


def test_schedule_is_even(spark):
    sources = spark.createDataFrame([(0, "a", 10**6, 5e5), (1, "b", 10**6, 3e5), (2, "c", 10**6, 2e5), (3, "d", 5, 1.0)], "sid int, source string, source_size long, target double")
    rows = mixing.slot_schedule(spark, sources).orderBy("slot", "sid").collect()
    share, seen = {0: 0.5, 1: 0.3, 2: 0.2}, defaultdict(int)
    for n, r in enumerate((r for r in rows if r.sid != 3), 1):
        assert r["rank"] == seen[r.sid]
        seen[r.sid] += 1
        assert all(abs(seen[s] - n * share[s]) < 8 for s in share)
    assert sum(r.sid == 3 for r in rows) == 1  # too small for a point of its own


def test_fragments_cover_what_is_taken(spark, make_docs):
    rows = mixing.materialize(mixing.sized(make_docs(ROWS).select("doc_id", "source", "text")).drop("text"), "t")
    parts, at = mixing.mix_fragments(spark, rows, mixing.source_targets(rows))
    slots = parts.groupBy("sid", "rank").sum("length").collect()
    assert slots and parts.where("length <= 0").count() == 0 and at.count() == len(ROWS)


def test_documents(spark, make_docs, awkward):
    docs = make_docs(awkward)
    out = mixing.mix_documents(spark, docs)
    assert out.columns == docs.columns
    n = defaultdict(int)
    for r in out.collect():
        n[r.text] += 1
    assert n[None] == n[""] == 0 and 1 <= n[awkward[6][1]] <= 2
    assert mixing.mix(spark, docs).count() == len(awkward)


def test_stage_copies_equal_the_mix(spark, make_docs):
    """The stage gives a document out once for each pass whose first word the schedule's fragments take."""
    want, got = defaultdict(int), defaultdict(int)
    for r in mixing.mix(spark, make_docs(ROWS)).where("taken > 0").collect():
        want[r.doc_id] += -(-r.taken // r.size)
    for r in mixing.mix_documents(spark, make_docs(ROWS)).collect():
        got[r.doc_id] += 1
    assert got == want and {1, 2} <= set(got.values())


@pytest.mark.parametrize("rows", [[], [(1, None)]])
def test_nothing_to_take(spark, make_docs, rows):
    assert [r.taken for r in mixing.mix(spark, make_docs(rows)).collect()] == [0] * len(rows)
    assert mixing.mix_documents(spark, make_docs(rows)).count() == 0


def test_golden_points(spark):
    """Exact for every slot, also beyond 2**26."""
    slots = [0, 1, 2, 12345, 2**24 - 1, 2**24, 2**26 + 5, 2**36 - 1, 2**36 + 3, 2**45 + 17]
    got = spark.createDataFrame([(s,) for s in slots], "id long").select("id", mixing.golden("id").alias("u")).collect()
    assert {r.id: r.u for r in got} == {s: (s * mixing.GOLDEN) % 2**36 / 2**36 for s in slots}


def test_prefixes_of_the_stage_are_near_the_targets(spark, make_docs, monkeypatch):
    """Rows in the order in which they are written: after any part of them, each source's share is near that of its target."""
    monkeypatch.setattr(mixing, "TOKENS_PER_SLOT", 16)
    docs = make_docs([(i, " ".join(["w"] * (5 + i % 11)), "abc"[i * 7 % 10 // 4]) for i in range(6000)])
    out = [(r.source, len(r.text.split())) for part in mixing.mix_documents(spark, docs).rdd.glom().collect() for r in part]
    sizes = defaultdict(int)
    for r in docs.collect():
        sizes[r.source] += len(r.text.split())
    want, total, seen, n = level(sizes), sum(level(sizes).values()), defaultdict(int), 0
    for source, size in out:
        seen[source] += size
        n += size
        assert all(abs(seen[s] - n * want[s] / total) < 400 for s in want)
    assert abs(n - total) < 100


def test_clashing_columns(spark, make_docs):
    docs = make_docs(ROWS)
    names = ["mix_size", "__target", "__sid", "__size", "__order", "mix_slot", "a.b"]
    for c in names:
        docs = docs.withColumn(c, F.concat(F.lit(c), "doc_id"))
    out = mixing.mix_documents(spark, docs)
    assert out.columns == docs.columns
    rows = out.collect()
    assert rows and all(r[c] is None if r.doc_id is None else r[c] == f"{c}{r.doc_id}" for r in rows for c in names)
    assert sorted(r.doc_id or -1 for r in rows) == sorted(r.doc_id or -1 for r in mixing.mix_documents(spark, make_docs(ROWS)).collect())


def test_long_text(spark, make_docs):
    rows = [(1, "w " * 300_000, "a"), (2, "w " * 50, "b"), (3, "v " * 70_000, "b")]
    out = {r.doc_id: r for r in mixing.mix(spark, make_docs(rows)).collect()}
    assert out[1].size == 300_000 and sum(r.taken for r in out.values()) == pytest.approx(1.5 * 370_050, abs=3)
