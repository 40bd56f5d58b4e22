from __future__ import annotations

import random

import numpy as np
import pytest

from tracewright.llm import near_dedup as n
from tracewright.llm.common import Workspace


def sets(t):
    w = (t or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(docs):
    s = {i: sets(t) for i, t in docs}
    comp = {i: i for i in s}

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    ids = sorted(s)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(s[a] & s[b])
            if both and 100 * both >= 75 * (len(s[a]) + len(s[b]) - both):
                x, y = sorted((root(a), root(b)))
                comp[y] = x
    return {(i, len(s[i]), root(i)) for i in s}


def family(rng, base, n_docs, edits):
    out = []
    for _ in range(n_docs):
        w = list(base)
        for _ in range(rng.randrange(edits + 1)):
            w[rng.randrange(len(w))] = f"edit{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.fixture
def corpus():
    rng = random.Random(8)
    word = lambda: f"v{rng.randrange(4000)}"
    texts = []
    for size, count, edits in ((12, 12, 1), (60, 25, 3), (200, 130, 9), (300, 20, 20), (7, 6, 1), (3, 4, 1)):
        texts += family(rng, [word() for _ in range(size)], count, edits)
    common = " ".join(word() for _ in range(60))  # a passage that unrelated documents share
    texts += [" ".join(word() for _ in range(rng.randrange(20, 60))) + " " + common for _ in range(120)]
    texts += [" ".join(word() for _ in range(rng.randrange(1, 40))) for _ in range(80)]
    texts += texts[:30] + [texts[0].upper(), texts[1].replace(" ", "\n ")]
    return [(i, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize(("rounds", "block"), [(2, 512), (1, 16), (0, 7)])
def test_against_brute_force(make_docs, corpus, monkeypatch, rounds, block):
    monkeypatch.setattr(n, "ROUNDS", rounds)  # fewer leave more to the blocks
    monkeypatch.setattr(n, "BLOCK", block)
    monkeypatch.setattr(n, "HEAVY", 4)
    monkeypatch.setattr(n, "PARTNERS", 8)
    out = n.link(make_docs(corpus)).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in out} == brute(corpus)
    assert all(r.kept == (r.doc_id == r.component_id) for r in out)


def test_near_copies_with_a_common_passage(make_docs, monkeypatch):
    """Pairs of near copies in large buckets of unlinked documents, some of which share one bucket only."""
    monkeypatch.setattr(n, "BLOCK", 16)
    rng = random.Random(4)
    common = [f"c{k}" for k in range(80)]
    texts = []
    for k in range(360):
        own = [f"w{rng.randrange(10**6)}" for _ in range(70)]
        texts.append(" ".join(own + common))
        if k % 4 == 0:
            own[5], own[20], own[35], own[50] = (f"edit{rng.randrange(10**6)}" for _ in range(4))
            texts.append(" ".join(own + common))
    docs = list(enumerate(texts))
    out = n.link(make_docs(docs)).collect()
    want = brute(docs)
    assert len(docs) - len({c for _, _, c in want}) >= 80
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in out} == want


def test_a_pair_with_one_large_bucket():
    """Of all the members of one bucket, two are similar enough, and this bucket is all that they share."""
    rng = np.random.default_rng(6)
    regs = rng.integers(0, 2**16, (40, n.REGISTERS)).astype("<u2")
    regs[:, :4] = regs[0, :4]
    regs[7] = np.where(np.arange(n.REGISTERS) % 4 < 3, regs[31], regs[7])
    regs[7, :4] = regs[31, :4]
    keys, size = regs.view("<i8"), np.full(40, 100)
    for side in (np.full(40, n.BOTH), np.where(np.arange(40) < 20, n.LEFT, n.RIGHT)):
        assert [x.tolist() for x in n.candidates(keys, np.zeros(40, int), np.arange(40), side, size)] == [[7], [31]]
    for args in ((np.ones(40, int), np.arange(40), size), (np.zeros(40, int), np.zeros(40, int), size), (np.zeros(40, int), np.arange(40), np.where(np.arange(40) == 7, 74, 100))):
        band, comp, sizes = args
        assert not len(n.candidates(keys, band, comp, np.full(40, n.BOTH), sizes)[0])


def test_verify():
    rng = np.random.default_rng(9)
    base = np.unique(rng.integers(0, 2**63, 150, dtype=np.uint64))
    sets = {k: np.unique(np.concatenate([base[rng.random(len(base)) > 0.06], rng.integers(0, 2**63, int(rng.integers(0, 25)), dtype=np.uint64)])) for k in range(40)}
    i, j = map(np.array, zip(*[(a, b) for a in range(20) for b in range(20, 40)], strict=True))
    good = n.verify(i, j, sets)
    assert good.tolist() == [n.similar(sets[a], sets[b]) for a, b in zip(i.tolist(), j.tolist(), strict=True)]
    assert 20 < good.sum() < 380


def test_blocks_of_a_bucket(spark, monkeypatch):
    """Every pair of a bucket with a member outside the largest component meets in one block, and no other pair does."""
    monkeypatch.setattr(n, "BLOCK", 5)
    members = [(1, 0, bytes([k]), b"main" if k < 17 else bytes([k % 29]), 10) for k in range(40)] + [(2, 1, bytes([k]), bytes([k]), 10) for k in range(4)] + [(3, 2, bytes([k]), b"one", 10) for k in range(4)]
    rows = spark.createDataFrame(members, "bucket long, band int, cls binary, comp binary, n long")
    classes = spark.createDataFrame([(bytes([k]), [k] * n.BANDS) for k in range(40)], "cls binary, keys array<bigint>")
    groups = {}
    for r in n.in_blocks(rows, classes).collect():
        groups.setdefault((r.bucket, r.left, r.right), []).append((bytes(r.cls)[0], r.side))
    met = []
    for (bucket, _, _), at in groups.items():
        left, right = [x for x in at if x[1] != n.RIGHT], [x for x in at if x[1] != n.LEFT]
        met += [(bucket, *sorted((a, b))) for a, x in left for b, y in right if a != b and (x + y < 2 * n.BOTH or a < b)]
    assert len(met) == len(set(met))
    assert set(met) == {(1, a, b) for a in range(40) for b in range(a + 1, 40) if b >= 17} | {(2, a, b) for a in range(4) for b in range(a + 1, 4)}
    assert max(map(len, groups.values())) < 40


def test_recall_near_the_threshold(make_docs):
    """Pairs of similarity 0.75 to 0.8, of texts of 30 to 600 words: each is found."""
    rng = random.Random(12)
    texts, want = [], 0
    while want < 150:
        size = rng.randrange(30, 600)
        base = [f"r{rng.randrange(10**7)}" for _ in range(size)]
        other = list(base)
        for _ in range(max(1, round(size * 0.028))):
            other[rng.randrange(size)] = f"e{rng.randrange(10**7)}"
        a, b = sets(" ".join(base)), sets(" ".join(other))
        if 0.75 <= len(a & b) / len(a | b) < 0.8:
            texts += [" ".join(base), " ".join(other)]
            want += 1
    out = n.link(make_docs(list(enumerate(texts)))).collect()
    assert sum(not r.kept for r in out) >= want - 1  # 5e-6 of these pairs may share no band
    assert all(r.component_id // 2 == r.doc_id // 2 for r in out)


def test_rows_that_share_an_id(spark, make_docs):
    """The stage decides by row: an id's text goes or stays by its own class, and a column of any name is kept."""
    rng = random.Random(2)
    base = [f"w{rng.randrange(10**6)}" for _ in range(60)]
    other = " ".join(f"u{rng.randrange(10**6)}" for _ in range(60))
    a, near = " ".join(base), " ".join([*base[:-1], "edited"])
    docs = make_docs([(3, near), (5, a), (5, other), (5, other), (8, None), (8, None), (9, other)]).withColumnRenamed("row", "a.b").withColumnRenamed("cls", "near_id")
    left = n.drop_near_copies(docs)
    assert left.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in left.collect() if r.text) == [(3, near), (5, other)]
    assert left.where("text IS NULL").count() == 2


def test_equal_counts():
    rng = np.random.default_rng(2)
    a, b = (rng.integers(0, 3, (k, n.REGISTERS)).astype("<u2") for k in (9, 14))
    assert (n.equal_counts(a, b) == (a[:, None] == b[None]).sum(axis=2)).all()


def test_edges(make_docs, awkward):
    docs = make_docs(awkward)
    out = n.link(docs).collect()
    assert len(out) == len(awkward)
    by = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in out}
    assert by[1] == (0, 1, True) and by[3] == (0, 3, True) and by[None][1:] == (None, True)
    assert by[4] == (1, 4, True) and by[7] == (1, 4, False)
    left = n.drop_near_copies(docs)
    assert left.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in left.collect()) == [0, 1, 2, 3, 4, 5, 6]
    assert n.link(make_docs([])).count() == 0 and n.drop_near_copies(make_docs([])).count() == 0


def test_estimate():
    rng = np.random.default_rng(3)
    for share in (0.3, 0.75, 0.95):
        got = []
        for size in (20, 300, 5000):
            for _ in range(20):
                both, own = int(size * share), size - int(size * share)
                a, b, c = (rng.integers(0, 2**63, k, dtype=np.uint64) * np.uint64(2) for k in (both, own // 2 + 1, own // 2 + 1))
                x, y = (np.frombuffer(n.signature(np.unique(np.concatenate([a, z]))), "<u2")[None] for z in (b, c))
                got.append(float(n.estimate(x, y)[0]) - both / (both + len(b) + len(c)))
        assert abs(np.mean(got)) < 0.03 and np.max(np.abs(got)) < 0.3
    apart = [float(n.estimate(*(np.frombuffer(n.signature(np.unique(rng.integers(0, 2**64, 800, dtype=np.uint64))), "<u2")[None] for _ in "ab"))[0]) for _ in range(50)]
    assert abs(np.mean(apart)) < 0.005


def test_chains(spark):
    edges = n._ordered(spark.createDataFrame([(bytes([k * 37 % 101]), bytes([(k + 1) * 37 % 101])) for k in range(60)] + [(b"\xf0", b"\xf1")], "a binary, b binary"))
    with Workspace(spark, "t") as tmp:
        out = n.components(edges, tmp).groupBy("comp").count().collect()
    assert sorted(r["count"] for r in out) == [2, 61]
