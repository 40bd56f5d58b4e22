from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest

from tracewright.llm import vector_codes as v
from tracewright.llm.common import Workspace
from tracewright.llm.registry import op13_vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int, code string, error long"


def brute(rows):
    """The contract with plain integers, vector by vector."""
    kept = sorted((i, [float(np.float32(x)) for x in e], lab) for i, e, lab in rows if e and all(x is not None and math.isfinite(x) for x in e))
    parts = [[[math.floor(4096 * x) for x in e[p * len(e) // 8 : (p + 1) * len(e) // 8]] for p in range(8)] for _, e, _ in kept]
    books = [[list(q[p]) for q in parts[:16]] for p in range(8)]

    def assign(q, p):
        return min((sum((a - b) ** 2 for a, b in zip(q[p], c, strict=True)), k) for k, c in enumerate(books[p]))

    for _ in range(6):
        at = [[assign(q, p)[1] for p in range(8)] for q in parts]
        for p in range(8):
            for k in range(len(books[p])):
                own = [q[p] for q, a in zip(parts, at, strict=True) if a[p] == k]
                if own:
                    books[p][k] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    sha = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    out, by = [], {}
    for (i, _, lab), q in zip(kept, parts, strict=True):
        found = [assign(q, p) for p in range(8)]
        err = sum(d for d, _ in found)
        by[lab] = by.get(lab, 0) + err
        out.append((i, "".join(f"{k:02x}" for _, k in found), err, lab))
    return sorted((i, c, e, by[lab], sha) for i, c, e, lab in out)


@pytest.fixture
def run(spark, tmp_path):
    def go(rows):
        spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(3).write.mode("overwrite").parquet(f"{tmp_path}/embeddings.parquet")
        got = [(r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in op13_vector_codes(spark, str(tmp_path)).collect()]
        return sorted(got, key=lambda r: (r[0] is None, r))

    return go


def test_against_brute_force(run, monkeypatch):
    monkeypatch.setattr(v, "BLOCK", 7)
    rng = random.Random(3)
    centre = [[rng.gauss(0, 1) for _ in range(16)] for _ in range(9)]
    rows = [(i, [c + rng.gauss(0, 0.1) for c in rng.choice(centre)], rng.choice([None, 0, 1, -1])) for i in range(400)]
    rows += [(500 + i, rows[3][1], 5) for i in range(60)]  # one very common vector
    rows += [(600, None, 1), (601, [float("nan")] * 16, 1), (602, [None] + [0.5] * 15, 1), (603, [float("inf")] + [0.5] * 15, 1), (604, [], 1)]
    rng.shuffle(rows)
    assert run(rows) == brute(rows)


def test_ties_few_rows_and_floors(run):
    rows = [(3, [-0.00001] * 8, None), (1, [0.25] * 8, 2), (2, [0.25] * 8, 2), (9, [0.5] * 8, 2)]  # entries of equal value: the lower index
    assert run(rows) == brute(rows)


def test_nothing_usable(run):
    assert run([]) == [] and run([(1, None, 1), (None, [float("nan")], None)]) == []


def test_other_lengths_and_ids(run, spark):
    ten = [(i, [i / 7 - j for j in range(10)], 1) for i in range(20)]
    got = run([*ten, (None, [0.5] * 10, None), (50, [1.0] * 8, 1), (3, ten[3][1], 1)])  # no multiple of 8, a null id, another length, a repeated row
    assert sorted(x for x in [r[0] for r in got] if x is not None) == sorted([*range(20), 3]) and len(got) == 22
    with pytest.raises(Exception, match="beyond"):
        run([(1, [1e6] * 8, 1)])


def test_decode_is_near(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 16)).astype(np.float32)
    df = spark.createDataFrame([(i, r.tolist(), 0) for i, r in enumerate(x)], "vec_id long, embedding array<float>, label int")
    with Workspace(spark, "t") as tmp:
        books, width = v.fit(df, tmp)
        got = v.decode(v.encode(df, books, width), books, width).collect()
    for r in got:
        err = ((np.floor(x[r.vec_id].astype(float) * 4096) - np.array(r.approx) * 4096) ** 2).sum()
        assert round(err) == r.error
    assert np.mean([r.error for r in got]) < 0.5 * 4096**2 * 16
