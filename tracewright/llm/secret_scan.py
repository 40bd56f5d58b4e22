"""Secret scan: Aho-Corasick keywords, anchored regular expressions at the hits, embedded checksums.

One automaton pass over the lower-cased bytes of a text finds the keywords; a kind's expression is tried only where
one of its keywords begins. Hexadecimal runs have no keyword: bytes are mapped to digit or no digit, and a search for 24
digits in a row takes the automaton's place. Kinds assign, access and hex are the base rules. The checksum kinds
add tokens whose last six characters are the CRC-32 of the rest in base 62 (github, npm) and card
numbers, named as such, that satisfy the Luhn rule (card). Matches of a kind don't overlap, the leftmost wins,
and a match that fails its length or checksum still takes up its place.

Offsets are code points of the whole text, ends exclusive. Defined results: null and empty texts have no spans; very long texts are read
whole, from the first byte to the last, in the one task that holds their row; a null doc_id, repeated rows and ties (spans of several kinds at one start, in the order of KINDS) are kept; empty tables give empty results;
extra columns are not read.
"""

from __future__ import annotations

import binascii
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

KINDS = ("assign", "access", "hex", "github", "npm", "card")
BASE = KINDS[:3]
MIN_VALUE, MIN_ACCESS, MIN_HEX = 6, 20, 24
#: Fixed by the base rules; on bytes, so letters fold in ASCII only.
ASSIGN = re.compile(rb"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]+")
GITHUB = re.compile(rb"gh[pousr]_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")
NPM = re.compile(rb"npm_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")
CARD = re.compile(rb"(?i:card(?:[ _-]?(?:no|number))?)[\"']?\x20*[:=#]?\x20*([0-9](?:[ -]?[0-9]){12,18})(?![0-9])")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
KEYWORDS = {"assign": ("password", "passwd", "secret", "token", "api_key", "apikey"), "access": ("akia",), "github": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), "npm": ("npm_",), "card": ("card",)}
_HEX_CLASS = bytes(c in b"0123456789abcdef" for c in range(256))
_CONTINUATION = bytes(range(0x80, 0xC0))


def crc_base62(payload: bytes) -> bytes:
    n, out = binascii.crc32(payload), ""
    while n:
        n, r = divmod(n, 62)
        out = BASE62[r] + out
    return out.rjust(6, "0").encode()


def luhn(digits: bytes) -> bool:
    n = [int(c) for c in digits.decode() if c.isdigit()][::-1]
    return (sum(n[::2]) + sum(sum(divmod(2 * d, 10)) for d in n[1::2])) % 10 == 0


RULES = {
    "assign": (ASSIGN, lambda m: len(m[2]) >= MIN_VALUE),
    "access": (ACCESS, lambda m: len(m[0]) >= MIN_ACCESS),
    "github": (GITHUB, lambda m: m[2] == crc_base62(m[1])),
    "npm": (NPM, lambda m: m[2] == crc_base62(m[1])),
    "card": (CARD, lambda m: luhn(m[1])),
}


def automaton():
    a = ahocorasick.Automaton()
    for kind, words in KEYWORDS.items():
        for w in words:
            a.add_word(w, (kind, len(w)))
    a.make_automaton()
    return a


def find(text: bytes | None, keywords) -> list[tuple[int, int, int]]:
    """(start, end, number of the kind) by start, then kind; offsets in code points."""
    if not text:
        return []
    found: list[tuple[int, int, int]] = []
    upto = dict.fromkeys(RULES, 0)
    # Latin-1 gives a character per byte, so offsets are those of the bytes; bytes.lower() folds ASCII only.
    for last, (kind, n) in keywords.iter(text.lower().decode("latin-1")):
        start = last - n + 1
        if start < upto[kind]:
            continue
        rule, passes = RULES[kind]
        if m := rule.match(text, start):
            upto[kind] = m.end()
            if passes(m):
                found.append((start, m.end(), KINDS.index(kind)))
    digits = text.translate(_HEX_CLASS)
    at = digits.find(b"\x01" * MIN_HEX)
    while at >= 0:
        end = HEX.match(text, at).end()
        found.append((at, end, 2))
        at = digits.find(b"\x01" * MIN_HEX, end)
    if not found:
        return found
    found.sort(key=lambda s: (s[0], s[2]))
    if text.isascii():
        return found
    # From byte to code point offsets, in one walk over the sorted borders.
    points, byte, point = {}, 0, 0
    for b in sorted({x for s in found for x in s[:2]}):
        point += len(text[byte:b].translate(None, _CONTINUATION))
        byte, points[b] = b, point
    return [(points[s], points[e], k) for s, e, k in found]


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keywords = automaton()
    for b in slices(batches):
        spans = [[{"kind": KINDS[k], "start": s, "end": e} for s, e, k in find(t, keywords)] for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(spans, pa.list_(_SPAN))], ["doc_id", "spans"])


def scan_secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, spans) for each row; spans is an array of (kind, start, end)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(_scan, "doc_id long, spans array<struct<kind:string,start:bigint,end:bigint>>")


def joined(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
