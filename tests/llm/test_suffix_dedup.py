from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tracewright.llm import suffix_dedup as s
from tracewright.llm.registry import op12_suffix_dedup


def brute(docs):
    """Every string of 200 bytes, counted; covered bytes by text."""
    texts = [(i, (t or "").encode()) for i, t in docs]
    seen = Counter(t[p : p + 200] for _, t in texts for p in range(len(t) - 199))
    out = []
    for i, t in texts:
        gone = np.zeros(len(t) + 2, bool)
        for p in range(len(t) - 199):
            if seen[t[p : p + 200]] > 1:
                gone[p + 1 : p + 201] = True
        kept = bytes(b for b, g in zip(t, gone[1:], strict=False) if not g)
        out.append((i, len(t), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def words(rng, n):
    return " ".join(rng.choice(["é", "日本", "a", "the", "of"]) + str(rng.randrange(500)) for _ in range(n))


@pytest.fixture
def run(spark, make_docs, tmp_path):
    def go(docs):
        make_docs(docs).repartition(3).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
        out = op12_suffix_dedup(spark, str(tmp_path))
        assert out.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        return sorted(map(tuple, out.collect()), key=str)

    return go


@pytest.fixture
def corpus():
    rng = random.Random(12)
    passages = [words(rng, n) for n in (30, 45, 60, 90, 200)] + ["x" * 230, "ab" * 140, "-" * 199, "=" * 1000]
    docs = []
    for k in range(120):
        parts = [words(rng, rng.randrange(1, 60))]
        for _ in range(rng.randrange(4)):
            p = rng.choice(passages)
            a = rng.randrange(max(1, len(p) // 2))
            b = rng.randrange(a, len(p) + 1)
            parts += [p[a:b] if rng.random() < 0.6 else p, rng.choice(["", "q", " "]) + words(rng, rng.randrange(1, 20))]
        docs.append((k, rng.choice(["", " ", "\n"]).join(parts)))
    docs += [(200 + k, docs[k][1]) for k in range(8)]  # copies
    for k in range(20):  # near copies, edited at bytes so that repeats are some of just 199 and 200
        t = docs[k][1]
        for _ in range(rng.randrange(1, 4)):
            at = rng.randrange(len(t))
            t = t[:at] + "#" + t[at + 1 :]
        docs.append((300 + k, t))
    docs += [(400, passages[4] + "!" + passages[4]), (401, passages[3][:150]), (402, "z" * 200), (403, "z" * 199), (None, words(rng, 80)), (None, docs[5][1])]
    return docs


@pytest.mark.parametrize("heavy", [s.HEAVY, 3])
def test_against_brute_force(run, corpus, monkeypatch, heavy):
    monkeypatch.setattr(s, "HEAVY", heavy)  # most blocks by the hashes of their windows
    want = brute(corpus)
    assert sum(r[2] for r in want) > 20000 and any(0 < r[2] < r[1] for r in want)
    assert run(corpus) == want


def test_edges_of_200_bytes(run):
    rng = random.Random(1)
    docs = []
    for k, n in enumerate((198, 199, 200, 201, 263, 264, 330)):
        common = "".join(rng.choice("abcdefgh \n\0") for _ in range(n))
        for side in range(3):
            docs.append((10 * k + side, ["", "A" * 17, words(rng, 40)][side] + common + [words(rng, 30), "", "B"][side]))
    assert run(docs) == brute(docs)


def test_awkward(run, awkward):
    rows = [r for r in awkward if r[0] != 5] + [(5, awkward[6][1][:3000])]
    assert run(rows) == brute(rows)
    assert run([]) == []
    n = len(awkward[6][1].encode())
    assert [r for r in run([awkward[6]])][0][:4] == (5, n, 0, 0)


def test_samples_depend_on_content():
    """Any 200 bytes have their next sample at the same distance, wherever they stand."""
    rng = random.Random(3)
    common = "".join(rng.choice("abcd") for _ in range(900)).encode()
    for left, right in ((b"", b""), (b"zz" * 50, b"q" * 99), (b"abcd" * 33, b"dcba" * 70), (bytes(100), b"\xff" * 300)):
        at = s.samples(left + common + right) - len(left)
        plain = s.samples(common)
        for p in range(len(common) - 199):
            a, b = (x[x >= p][:1] for x in (at, plain))
            assert a.tolist() == b.tolist() and a[0] - p <= s.REACH


def test_drop_repeats(make_docs):
    rng = random.Random(6)
    p = words(rng, 60)
    docs = [(1, "one " + p), (2, "two " + p), (3, "three"), (4, None)]
    out = s.drop_repeats(make_docs(docs).withColumnRenamed("row", "kept"))
    assert out.columns[-1] == "kept_" and {r.doc_id: r["kept_"] for r in out.collect()} == {1: b"one", 2: b"two", 3: b"three", 4: None}
