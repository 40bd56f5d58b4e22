from __future__ import annotations

import random
import re

import pytest

from tracewright.llm import decontaminate as d

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(t):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute(text, items):
    w, hit, ids = words(text), set(), set()
    for i, t in items:
        v = words(t)
        n = min(13, len(v))
        for k in range(len(v) - n + 1) if v else ():
            for at in range(len(w) - n + 1):
                if w[at : at + n] == v[k : k + n]:
                    hit |= set(range(at, at + n))
                    ids |= {str(i)} - {"None"}
    return len(w), len(hit), sorted(ids)


@pytest.mark.parametrize("broadcast_bytes", [1 << 20, 2000, 0])
def test_against_brute_force(spark, make_docs, broadcast_bytes):
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(12)] + ["É", "日本", "It's"]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i % 22, say(rng.choice([1, 3, 12, 13, 14, 30]))) for i in range(24)] + [(None, say(20)), (50, None), (51, "..."), (3, "W1 w1")]
    docs = [(i, say(rng.randrange(80)) + " " + (rng.choice(items)[1] or "") + "," + say(5)) for i in range(60)] + [(60, None), (61, ""), (None, items[0][1]), (1, items[1][1].upper())]
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = d.find_contamination(make_docs(docs), bench, broadcast_bytes=broadcast_bytes).collect()
    got = sorted(((r.doc_id, r.n_words, sum(p.end - p.start for p in r.places), list(r["items"])) for r in out), key=str)
    assert got == sorted(((i, *brute(t, items)) for i, t in docs), key=str)


def test_edges(spark, make_docs, awkward):
    bench = spark.createDataFrame([(1, "same words here")], "item_id long, text string")
    docs = make_docs(awkward)
    left = d.drop_contaminated(docs, bench)
    assert left.columns == docs.columns and sorted(r.doc_id or 0 for r in left.collect()) == [0, 1, 2, 3, 5, 6]
    assert d.drop_contaminated(docs, bench.limit(0)).count() == len(awkward)
    assert d.find_contamination(make_docs([]), bench).count() == 0


def test_shuffled_stage(spark, make_docs, awkward):
    """Beyond the broadcast bound the stage keeps the same rows, with columns of any name."""
    bench = spark.createDataFrame([(1, "same words here"), (2, " ".join(f"word{i % 977}x{i}" for i in range(20000, 20013)))], "item_id long, text string")
    docs = make_docs([*awkward, (20, "same words here " + "other " * 70)]).withColumnRenamed("cls", "text_key").withColumnRenamed("row", "a.b")
    key = lambda df: sorted((r.doc_id or 0) for r in df.collect())
    near, far = d.drop_contaminated(docs, bench), d.drop_contaminated(docs, bench, broadcast_bytes=0)
    assert near.columns == far.columns == docs.columns and key(near) == key(far) == [0, 1, 2, 3, 5, 6, 20]
    assert d.drop_contaminated(docs, bench.limit(0), broadcast_bytes=-1).count() == docs.count()
