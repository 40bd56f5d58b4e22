from __future__ import annotations

import hashlib
import heapq
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tracewright.llm import conversation_repair as c
from tracewright.llm.registry import op11_conversation_repair

SCHEMA = "conv_id long, turn long, role string, text string, conv string, seq long"


def search(rows):
    """Cheapest edits by search over (row, roles' state), audits compared as whole strings. rows: (role, text, must go, truncated)."""
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, at, last, out = heapq.heappop(heap)
        if (at, last) in done:
            continue
        done.add((at, last))
        if at == len(rows) and last in ("", "a"):
            return cost, audit, out
        fits = {"": "su", "s": "u", "u": "a", "a": "u"}[last]
        steps = [(3, "I", 0, r[0], ((r, ""),)) for r in ("user", "assistant") if r[0] in fits]
        if at < len(rows):
            role, text, must, cut = rows[at]
            steps.append((4, "D", 1, last, ()))
            if not must:
                if role[:1] and role[:1] in fits:
                    steps.append((3 * cut, "K", 1, role[:1], ((role, text),)))
                steps += [(3 + 3 * cut, "R", 1, r[0], ((r, text),)) for r in ("user", "assistant") if r[0] in fits]
        for more, letter, step, to, add in steps:
            heapq.heappush(heap, (cost + more, audit + letter, at + step, to, out + add))


def brute(rows, damaged=True):
    sp = lambda x: " " if x is None else str(x)
    convs = {}
    for conv, turn, role, text in rows:
        own = convs.setdefault(conv, [])
        role, text = sp(role), sp(text)
        hit = zlib.crc32(f"{sp(conv)}:{sp(turn)}".encode()) % 20 if damaged else 9
        if hit == 0:
            continue
        text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
        own += [(turn, "user" if hit == 4 else role, text)] * (2 if hit == 3 else 1)
    out = {}
    for conv, own in convs.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
        seen, faults, tokens = set(), [0, 0, 0], []
        for _, role, text in own:
            last = re.findall(r"[^\x20\x09-\x0D]", text)[-1:]
            fault = 0 if not last else 1 if (role, text) in seen else 2 if last[0] not in ".!?" else None
            seen.add((role, text))
            if fault is not None:
                faults[fault] += 1
            tokens.append((role, text, fault in (0, 1), fault == 2))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False))
        turns = {t for t, _, _ in own if t is not None}
        cost, audit, left = search(tokens)
        told = "\n".join(f"{r}:{t}" for r, t in left)
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *faults, illegal, cost, audit, hashlib.sha256(told.encode()).hexdigest())
    return out


@pytest.fixture
def run(spark, tmp_path):
    def go(rows):
        spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(3).write.mode("overwrite").parquet(f"{tmp_path}/conversations.parquet")
        out = op11_conversation_repair(spark, str(tmp_path))
        assert out.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
        got = out.collect()
        assert len({r[0] for r in got}) == len(got)
        return {r[0]: tuple(r[1:]) for r in got}

    return go


def made(rng, conv, n):
    roles = ["system"] * (rng.random() < 0.3) + ["user", "assistant"] * n
    texts = ["Yes.", "no", "What?", "é!\n", " \t", "", "..", "Who ", "x" * 9, None]
    out = []
    for t in range(n):
        role = roles[t] if rng.random() < 0.7 else rng.choice(["user", "assistant", "system", "tool", "", None, "unit"])
        out.append((conv, None if rng.random() < 0.05 else t + (rng.random() < 0.1), role, rng.choice(texts) if rng.random() < 0.6 else f"Text {t}."))
    return out


def test_against_search(run):
    rng = random.Random(2)
    rows = [r for conv in range(150) for r in made(rng, conv, rng.randrange(1, 11))]
    rows += [(None, None, "user", "a."), (None, 1, None, None), (None, 1, "user", "a."), (999, 5, "user", "word " * 20000)]
    rows += [(1000, 3, "assistant", "Twice.")] * 3
    rng.shuffle(rows)
    assert run(rows) == brute(rows)


@pytest.mark.parametrize("bits", [1, 3])
def test_long_conversations_in_pieces(run, monkeypatch, bits):
    monkeypatch.setattr(c, "PIECE_BITS", bits)
    rng = random.Random(bits)
    rows = [r for conv in range(25) for r in made(rng, conv, rng.randrange(1, 60))]
    assert run(rows) == brute(rows)


def test_a_conversation_of_full_pieces(run):
    rng = random.Random(5)
    rows = made(rng, 1, 700) + made(rng, 2, 129) + [(3, t, "tool", "x") for t in range(300)]
    assert run(rows) == brute(rows)


def test_empty_and_all_gone(run):
    assert run([]) == {}
    gone = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    assert run([(gone, 0, "user", "a.")]) == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_repaired_rows(spark):
    rng = random.Random(7)
    rows = [r for conv in range(40) for r in made(rng, conv, 6)]
    got = c.repair_conversations(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)).orderBy("conv_id", "position").collect()
    want = brute(rows, damaged=False)
    for conv in want:
        own = [r for r in got if r.conv_id == conv]
        assert re.fullmatch("(s?(ua)+)?", "".join(r.role[:1] for r in own))
        assert hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in own).encode()).hexdigest() == want[conv][-1]
        assert [r.edit for r in own] == [e for e in want[conv][-2] if e != "D"]


def test_damage(spark):
    rows = [(k, t, "assistant", "A. b! c?") for k in range(30) for t in range(6)]
    got = c.damage(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)).groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("n")).collect()
    kinds = {0: None, 1: ("assistant", "", 1), 2: ("assistant", "A b c", 1), 3: ("assistant", "A. b! c?", 2), 4: ("user", "A. b! c?", 1)}
    want = {(k, t): kinds.get(zlib.crc32(f"{k}:{t}".encode()) % 20, ("assistant", "A. b! c?", 1)) for k, t, _, _ in rows}
    assert {(r.conv_id, r.turn): (r.role, r.text, r.n) for r in got} == {k: v for k, v in want.items() if v}
