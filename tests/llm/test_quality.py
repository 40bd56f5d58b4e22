from __future__ import annotations

import random

from tracewright.llm import quality_rules as q


def brute(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text or "") if w]
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    hit, seen = set(), {}
    for i in range(len(words) - 7):
        seen.setdefault(tuple(words[i : i + 8]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            hit |= {i + k for i in at for k in range(8)}
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(hit)


def test_measure_against_brute_force():
    rng = random.Random(5)
    for _ in range(150):
        words = [rng.choice(["a", "bé", "c#", "日本", "|", "e"]) for _ in range(rng.randrange(60))]
        text = "".join(w + rng.choice([" ", "\n", "\t", "  "]) for w in words) * rng.choice([1, 1, 2])
        assert q.measure(text.encode())[:5] == brute(text)
    assert q.measure(None)[:5] == (0, 0, 0, 0, 0)


def test_forest_separates_outliers():
    import numpy as np

    rng = np.random.default_rng(1)
    x = np.vstack([rng.normal(size=(500, 3)), rng.normal(loc=9, size=(10, 3))])
    s = q.IsolationForest(x).score(x)
    assert s[500:].min() > np.quantile(s[:500], 0.98)


def test_judge_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    half = labels.where("xxhash64(doc_id) % 2 = 0")
    out = q.judge(docs, half).join(labels.where("xxhash64(doc_id) % 2 != 0"), "doc_id").select("kept", "base_failed", "quality").collect()
    bad = [r for r in out if r.quality == 0]
    good = [r for r in out if r.quality == 1 and not r.base_failed]
    assert sum(not r.kept for r in bad) >= 0.9 * len(bad)
    assert sum(r.kept for r in good) >= 0.98 * len(good)


def test_edges(spark, make_docs, awkward):
    labels = spark.createDataFrame([(4, 1, 0), (None, 0, 0), (5, None, 1)], "doc_id long, quality int, toxic int")
    docs = make_docs(awkward)
    out = q.judge(docs, labels).collect()
    assert len(out) == len(awkward)
    assert all(not r.kept for r in out if r.n_words < 20)
    assert [r.kept for r in out if r.doc_id == 5] == [True]  # labels of one kind reject nothing
    assert q.keep_good(docs, labels).columns == docs.columns
    assert [r.doc_id for r in q.keep_good(docs, labels).collect()] == [5]
    empty = make_docs([])
    assert q.judge(empty, labels).count() == 0 and q.keep_good(empty, labels.limit(0)).count() == 0


def test_path_lengths_and_threshold(spark):
    """The forest's scores and the threshold, worked out again: each row walked through each tree, each threshold tried."""
    import numpy as np

    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(0, 1, (400, len(q.FEATURES))), rng.normal(6, 1, (12, len(q.FEATURES)))])
    forest = q.IsolationForest(x, trees=20, subsample=64)
    harmonic = lambda n: sum(1 / k for k in range(1, n))
    c = lambda n: 0 if n < 2 else 2 * harmonic(n) - 2 * (n - 1) / n
    want = []
    for row in x:
        total = 0.0
        for feature, value, left, right, length in forest.trees:
            at = 0
            while left[at] != at:
                at = left[at] if row[feature[at]] < value[at] else right[at]
            total += length[at]
        want.append(2 ** (-total / 20 / c(64)))
    got = forest.score(x)
    assert np.abs(got - want).max() < 0.01 and got[400:].min() > np.median(got[:400])
    bad = set(range(400, 412)) | {3}
    scored = spark.createDataFrame([(i, float(s)) for i, s in enumerate(got)], "doc_id long, anomaly double")
    labels = spark.createDataFrame([(i, int(i not in bad)) for i in range(412)], "doc_id long, quality int")
    bins = np.floor(got * q.SCORE_BINS)
    gain = {t: sum(bins[i] >= t for i in bad) / len(bad) - q.GOOD_WEIGHT * sum(bins[i] >= t for i in range(412) if i not in bad) / (412 - len(bad)) for t in range(q.SCORE_BINS + 2)}
    best = max(gain.values())
    assert q.calibrate(scored, labels) == max(t for t, g in gain.items() if g >= best - 1e-12) / q.SCORE_BINS


def test_fit_takes_the_smallest_hashes(spark, monkeypatch):
    """The bound on the hash doesn't change the sample."""
    import numpy as np

    monkeypatch.setattr(q, "TREES", 4)
    monkeypatch.setattr(q, "SUBSAMPLE", 16)
    rng = np.random.default_rng(1)
    stats = spark.createDataFrame([(i, *map(float, rng.random(len(q.FEATURES)))) for i in range(3000)], "doc_id long, " + ", ".join(f"{f} double" for f in q.FEATURES))
    seen = []
    monkeypatch.setattr(q, "IsolationForest", lambda x: seen.append(x))
    q.fit(stats)
    q.fit(stats.where("doc_id < 200"))
    for x, rows in zip(seen, (stats, stats.where("doc_id < 200")), strict=True):
        want = rows.select(*q.FEATURES).orderBy(q.F.xxhash64(q.F.lit(q.SEED), "doc_id", *q.FEATURES)).limit(64).collect()
        assert x.tolist() == [list(r) for r in want]
