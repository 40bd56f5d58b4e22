"""Operators whose work is spread over blocks or sizes, against plain loops."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright.operators import asof, ordered, splits
from tracewright.plans import scan_queries


def test_trailing_windows_keep_a_small_spread(spark):
    """Mean 1e9, deviation 1e-3: squares of the values alone would lose it."""
    rng = np.random.default_rng(4)
    t = np.sort(rng.integers(0, 40_000_000, 800)).tolist()
    x = (1e9 + 1e-3 * rng.standard_normal(800)).tolist()
    df = spark.createDataFrame([("a", i, a, b) for i, (a, b) in enumerate(zip(t, x, strict=True))], "k string, i int, t long, x double")
    got = {r.i: r for r in ordered.trailing(df, "k", ["i"], "t", "x", 3.0, "w").collect()}
    for i, now in enumerate(t):
        own = [x[j] for j in range(i + 1) if t[j] >= now - 3_000_000]
        assert got[i].w_n == len(own) and got[i].w_mean == pytest.approx(np.mean(own), rel=1e-15)
        if len(own) > 1:
            assert got[i].w_std == pytest.approx(np.std(np.array(own) - 1e9), rel=1e-6)


def test_trailing_windows_of_awkward_rows(spark):
    rng = random.Random(8)
    rows = []
    for i in range(300):
        t = None if rng.random() < 0.05 else rng.choice([-7_000_000, 0, 1_000_000, 2_000_000, rng.randrange(-9_000_000, 9_000_000)])
        rows.append((rng.choice(["a", "b", None]), i, t, None if rng.random() < 0.1 else rng.gauss(0, 1), rng.random()))
    df = spark.createDataFrame(rows, "k string, i int, t long, x double, y double")
    out = ordered.trailing_many(df, "k", ["i"], "t", {"p": "x", "q": "y"}, 2.0)
    assert out.columns == ["k", "i", "t", "x", "y", "p_n", "p_mean", "p_std", "q_n", "q_mean", "q_std"]
    got = {r.i: r for r in out.collect()}
    assert len(got) == 300
    for k, i, t, _, _ in rows:
        for c, name in ((3, "p"), (4, "q")):
            own = [] if t is None else [r[c] for r in rows if r[0] == k and r[2] is not None and (r[2], r[1]) <= (t, i) and r[2] >= t - 2_000_000 and r[c] is not None]
            assert got[i][f"{name}_n"] == len(own)
            assert got[i][f"{name}_mean"] == (pytest.approx(np.mean(own)) if own else None)
            assert got[i][f"{name}_std"] == (pytest.approx(np.std(own), abs=1e-9) if len(own) > 1 else None)


def walk(sizes, shares):
    """Group after group, as greedy packing is defined."""
    lack, out = [sum(sizes) * s for s in shares], []
    for n in sizes:
        best = lack.index(max(lack))
        lack[best] -= n
        out.append(best)
    return out


def test_dealing_by_sizes_is_the_walk():
    rng = random.Random(11)
    for _ in range(300):
        shares = [rng.choice([0.0, 0.1, 0.25, 0.5, rng.random()]) for _ in range(rng.randrange(1, 5))]
        if not sum(shares):
            continue
        shares = [s / sum(shares) for s in shares]
        sizes = sorted((rng.choice([0, 1, 2, 3, 7, 50, 1000]) for _ in range(rng.randrange(1, 400))), reverse=True)
        lack, got = [sum(sizes) * s for s in shares], []
        for n in sorted(set(sizes), reverse=True):
            runs = splits.deal(lack, n, sizes.count(n))
            assert len(runs) <= 3 * len(shares) + 1 and [r[1] for r in runs[:-1]] == [r[0] for r in runs[1:]]
            got += [turn[i % len(turn)] for lo, hi, turn in runs for i in range(hi - lo)]
        assert got == walk(sizes, shares)


def test_packing_of_many_groups(spark):
    rng = random.Random(2)
    groups = [(f"g{k}", rng.choice([1, 1, 1, 2, 5, 40])) for k in range(3000)]
    got = {r.key: r.split for r in splits.pack(spark.createDataFrame(groups, "key string, n long"), "key", "n").collect()}
    score = lambda k: int.from_bytes(hashlib.sha256(f"tracewright:{k}".encode()).digest()[:8], "big") / 2.0**64
    order = sorted(groups, key=lambda g: (-g[1], score(g[0]), g[0]))
    names = ["test", "train", "validation"]
    assert got == {g[0]: names[b] for g, b in zip(order, walk([g[1] for g in order], [0.15, 0.7, 0.15]), strict=True)}


def test_packing_of_groups_without_rows(spark):
    got = [r.split for r in splits.pack(spark.createDataFrame([(f"g{k}", 0) for k in range(20)], "key string, n long"), "key", "n").collect()]
    assert {s: got.count(s) for s in set(got)} == {"train": 14, "test": 3, "validation": 3}
    assert splits.pack(spark.createDataFrame([], "key string, n long"), "key", "n").collect() == []


def test_fingerprint_is_a_tree(spark):
    rows = [("a", i, i / 3) for i in range(23)] + [("b", 0, None)]
    got = {r.k: (r.n, r.fingerprint) for r in splits.fingerprint(spark.createDataFrame(rows, "k string, i int, x double"), ["k"], ["i"], ["x"], fan=4).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for k, n in (("a", 23), ("b", 1)):
        level = [sha("" if x is None else f"{x:.6f}") for key, _, x in rows if key == k]
        for _ in range(2):
            level = [sha("".join(level[i : i + 4])) for i in range(0, len(level), 4)]
        assert got[k] == (n, sha(f"{n}|x|" + "".join(level)))


def test_closure_of_random_graphs(spark):
    rng = random.Random(3)
    edges = [(f"n{rng.randrange(400)}", f"n{rng.randrange(400)}") for _ in range(260)] + [("hub", f"h{k}") for k in range(300)] + [("solo", "solo")]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        root[find(a)] = find(b)
    parts: dict[str, list[str]] = {}
    for x in {x for e in edges for x in e}:
        parts.setdefault(find(x), []).append(x)
    want = {x: min(p) for p in parts.values() for x in p}
    assert {r.node: r.component for r in splits.closure(spark.createDataFrame(edges, "a string, b string"), "a", "b").collect()} == want


@pytest.fixture(scope="module")
def long_events(spark, tmp_path_factory):
    """Events of one type: 21,480 rows, so that tenths of a second in microseconds are more than 32 bits hold."""
    at = str(tmp_path_factory.mktemp("long"))
    x = (F.col("id") * 37 % 1009) / 10.0
    e = spark.range(21_480).select(F.col("id").alias("event_id"), F.timestamp_micros(F.col("id") * 1_000_000).cast("timestamp_ntz").alias("ts"), (F.col("id") % 7).alias("user_id"), F.lit("view").alias("event_type"), x.alias("value"))
    e.write.parquet(f"{at}/events.parquet")
    return at


def test_recordings_of_many_samples(spark, long_events):
    """alignment_fit, calibration_stream, frame_run_summary and segment_evaluation run over these rows."""
    got = scan_queries.driven(spark, long_events).agg(F.count("*"), F.min("t"), F.max("t"), F.max(F.col("t") - F.col("i") * F.lit(100_000).cast("long"))).first()
    assert list(got) == [21_480, 0, 2_147_900_000, 0]


def test_residual_lag_of_many_samples(spark, long_events):
    got = scan_queries.residual_lag(spark, long_events).collect()
    assert len(got) == 1 and got[0].accepted and got[0].lag_s == pytest.approx(0.8)


def test_values_read_in_time_share_two_sorts(spark):
    """However many values are read, rows are sorted once forwards and once backwards; a value that only one row has isn't read."""
    own = spark.createDataFrame([("a", i, t) for i, t in enumerate((0, 5, 10, 15, 20))] + [("b", 9, 10)], "k string, i int, t long")
    ref = spark.createDataFrame([("a", 0, 0, 1.0, None, None), ("a", 1, 10, 3.0, 7.0, None), ("a", 2, 10, 5.0, None, 4.0), ("a", 3, 20, None, None, 8.0), ("b", 4, 10, 1.0, 2.0, None), ("b", 5, 10, 3.0, None, None)], "k string, i int, t long, x double, y double, z double")
    out = asof.interpolate_many(own, ref, "k", "t", ["i"], {"p": "x", "q": "y", "r": "z"})
    got = {r.i: (r.p, r.q, r.r) for r in out.collect()}
    assert got == {0: (1.0, None, None), 1: (2.0, None, None), 2: (5.0, None, 4.0), 3: (None, None, 6.0), 4: (None, None, 8.0), 9: (3.0, None, None)}
    assert out._jdf.queryExecution().sparkPlan().toString().count("Window [") == 2


def test_trailing_windows_of_many_values_share_two_sorts(spark):
    """Rows that lie by key already are dealt to their blocks all the same."""
    df = spark.range(100).selectExpr("id div 1000 AS k", "cast(id AS int) AS i", "id * 1000000 AS t", "id * 1D AS x", "id * 2D AS y", "id * 3D AS z").repartition("k")
    out = ordered.trailing_many(df, "k", ["i"], "t", {"p": "x", "q": "y", "r": "z"}, 3.0)
    assert [tuple(r) for r in out.where("i IN (0, 50)").orderBy("i").select("p_n", "p_mean", "q_mean", "r_mean").collect()] == [(1, 0.0, 0.0, 0.0), (4, 48.5, 97.0, 145.5)]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Window [") == 3 and plan.count("hashpartitioning(k") == 2
