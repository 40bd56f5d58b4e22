from __future__ import annotations

import zlib

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from tracewright.llm import token_files as t  # noqa: E402
from tracewright.llm.common import scratch  # noqa: E402

VOCABULARY = str(public_tokenizers.path("word_bpe_49k.json"))
TEXTS = [
    "", " ", "a b c d's don't we'LL x'S", "é e\u0301 \u0301x \u212b \u00c5 ﬁ İstanbul ΣΑΣ ß", "<|endoftext|>hi <|startoftext|>a b<|endoftext|>", "hi <|endoftext|> there", "日本語 текст 123 4a5 a_b --x.. ...a!?b",
    "\x00 \x1c\x1d \x85 a\x1cb \ufeff", "🙂👍🏽 a\u200bb a\u00a0b", "'s 't ''s it''s", "Words, words. (More) words!", "ÀÉÎ naïve œuvre",
]


def test_encoder_equals_the_library(monkeypatch):
    monkeypatch.setattr(t, "CACHE_WORDS", 5)
    e = t.Encoder(VOCABULARY)
    for x in TEXTS * 2:
        assert np.frombuffer(e.encode(x.encode()), e.type).tolist() == e.library.encode(x, add_special_tokens=False).ids + [1]


def test_files_round_trip(spark, make_docs, awkward):
    rows = awkward + [(100 + i, x) for i, x in enumerate(TEXTS)] + [(-5, "minus")]
    e = t.Encoder(VOCABULARY)
    out = [tuple(r) for r in t.tokenize(spark, make_docs(rows), VOCABULARY).collect()]
    out.sort(key=lambda r: r[1])
    assert [r[0] for r in out] == sorted((r[0] for r in rows), key=lambda i: (i is not None, i or 0))
    at = 0
    for _, start, n, _ in out:
        assert start == at
        at += n
    want = sorted(((i, zlib.crc32(np.frombuffer(e.encode((x or "").encode()), e.type).astype("<u4").tobytes())) for i, x in rows), key=str)
    assert sorted(((r[0], r[3]) for r in out), key=str) == want


def test_files_are_flat(spark, make_docs):
    folder = scratch(spark, "t")
    m = t.write_token_files(make_docs([(2, "b a"), (1, "a")]), folder, VOCABULARY).collect()
    ids = np.concatenate([t._Numbers(r.stem + ".ids", "<u2").part(0, 1 << 20) for r in sorted(m, key=lambda r: r.base)])
    e = t.Encoder(VOCABULARY)
    assert ids.tobytes() == e.encode(b"a") + e.encode(b"b a")
    assert sum(len(t._Numbers(r.stem + ".off", "<u8").part(0, 1 << 20)) - 1 for r in m) == 2
    assert t.tokenize(spark, make_docs([]), VOCABULARY).count() == 0


def test_any_vocabulary():
    """A vocabulary that can't be cut at blanks is encoded whole; the cached way is taken for the other one only."""
    import public_tokenizers
    from tokenizers import Tokenizer

    texts = ["", "Hello  world's\n\n42nd  <|endoftext|> x", "Ünï 日本 \t tab", "a" * 5000]
    for name, by_word in (("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)):
        enc, library = t.Encoder(public_tokenizers.path(name)), Tokenizer.from_file(public_tokenizers.path(name))
        assert enc.by_word is by_word
        for x in texts:
            assert np.frombuffer(enc.encode(x.encode()), enc.type).tolist() == [*library.encode(x, add_special_tokens=False).ids, t.END_ID]
