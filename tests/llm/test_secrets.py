from __future__ import annotations

import hashlib
import random
import re

from tracewright.llm import secret_scan as s
from tracewright.llm.registry import op9_secret_scan

A = re.compile(r"(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")


def brute(t):
    out = [(m.start(), 0, m.end()) for m in A.finditer(t) if len(m[1]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return [(a, e, k) for a, k, e in sorted(out)]


def test_base_against_brute_force():
    rng, words = random.Random(2), s.automaton()
    bits = ["token", "=", ":", " ", "secret", "API_key", "apikey", "\"", "'", "abcdef", "0123456789abcdef" * 2, "AKIA", "ABCDEFGHIJ0123456789", "é", "日", "\n", "passwd", "PASSWORD", "K", "ſecret", "x", "token=ab"]
    for _ in range(3000):
        t = "".join(rng.choice(bits) for _ in range(rng.randrange(14)))
        assert [x for x in s.find(t.encode(), words) if x[2] < 3] == brute(t), t


def test_checksums():
    words, body = s.automaton(), "abcdefghijKLMNOPQRST0123456789"
    good = body + s.crc_base62(body.encode()).decode()
    assert s.find(f"é ghp_{good} npm_{good}".encode(), words) == [(2, 42, 3), (43, 83, 4)]
    assert s.find(f"ghp_{body}000000".encode(), words) == []
    assert s.find(b"card: 4111 1111 1111 1111", words) == [(0, 25, 5)] and s.find(b"card: 4111 1111 1111 1112", words) == []


def test_edges(spark, make_docs, awkward):
    out = s.scan_secrets(make_docs(awkward + [(8, "é token: abcdefg")]))
    rows = out.collect()
    assert len(rows) == len(awkward) + 1 and [tuple(x) for r in rows if r.doc_id == 8 for x in r.spans] == [("assign", 2, 16)]
    assert s.scan_secrets(make_docs([])).count() == 0


def test_query_against_brute_force(spark, make_docs, awkward, tmp_path):
    """Every column of the query; one text is long, with secrets at both ends and others cut by multi-byte characters."""
    far = "token = é token=abcdefgh " + "日本 word " * 200_000 + 'passwd: "x1y2z3w4" 0123456789abcdef01234567'
    docs = [*awkward, (20, far), (21, "AKIA" + "Z" * 16 + " " + "ab" * 12), (22, "secret=short1 secret=ab"), (22, "secret=short1 secret=ab")]
    make_docs(docs).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((tuple(r) for r in op9_secret_scan(spark, str(tmp_path)).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans").collect()), key=str)
    want = []
    for key, text in docs:
        found = brute(text or "")
        spans = ",".join(f"{s.KINDS[k]}:{a}:{e}" for a, e, k in found)
        want.append((key, *[sum(x[2] == kind for x in found) for kind in range(3)], hashlib.sha256(spans.encode()).hexdigest(), spans))
    assert got == sorted(want, key=str) and next(r for r in got if r[0] == 20)[1:4] == (2, 0, 1)
