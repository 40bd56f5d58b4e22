"""Benchmark decontamination by a prefix-filtered set join.

Items are cut into windows of WINDOW words (an item of fewer words is one window). Words are ordered by rarity: document
frequencies over all documents, kept in a sketch of SKETCH counters for the words that occur in items. A window that
occurs in a document brings all its words, so of its words in that order a prefix of one, the rarest, is necessary; documents are
joined with windows on that word alone. Positional and length bounds then drop what can't fit at that place (the window would begin before the text
or end after it), and the rest is verified word by word over the item-sized window.

Windows of up to BROADCAST_BYTES are broadcast as an index by prefix word, and documents never shuffled. Beyond that, the same join is a shuffle: each place of a text whose word may be a prefix (by a bitmap of
SKETCH bits) is sent to the windows of that word with the words around it, which is all it takes to verify there; hot words are salted. What is found is joined back by the text's digest.

Defined results: a null or empty text has no words and no hits; a null or empty item has no window; items with null ids hit words but aren't
counted or listed; repeated items count once; repeated documents and null doc_ids are judged one by one; empty tables give no hits or empty results;
texts of any length are searched whole; ties in rarity go to the least word; extra columns of any name are not read by the query, and kept by the pipeline stage.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keep_texts, materialize, slices, small_side_join, unused

WINDOW = 13
MIN_SHARE = 20  # contaminated if MIN_SHARE * n_hit >= n_words
SKETCH, BROADCAST_BYTES = 1 << 20, 64 << 20
#: ASCII other than digits and letters separates words; A-Z fold to a-z; bytes from 0x80 on belong to words.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_FOLD).split()


def windows_of(words: list[bytes], window: int = WINDOW) -> list[list[bytes]]:
    if not words:
        return []
    return [words[i : i + window] for i in range(max(1, len(words) - window + 1))]


def _counter(word: bytes) -> int:
    return zlib.crc32(word) & (SKETCH - 1)


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(window, items) for each distinct window; words are joined by spaces, items is sorted."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows = [(i, b" ".join(w)) for i, t in zip(b.column("item_id").to_pylist(), b.column("text").to_pylist(), strict=True) for w in windows_of(words_of(t), window)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary())], ["item", "window"])

    cuts = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("binary").alias("text")).mapInArrow(cut, "item string, window binary")
    return cuts.groupBy("window").agg(F.array_sort(F.collect_set("item")).alias("items"))


def rarity(docs: DataFrame, windows: DataFrame) -> np.ndarray:
    """Document frequency over all documents, by counter; only the counters of window words are kept."""
    spark = docs.sparkSession

    def touched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([pa.array(sorted({_counter(x) for w in b.column("window").to_pylist() for x in w.split()}), pa.int32())], ["c"])

    wanted = np.zeros(SKETCH, dtype=bool)
    wanted[[r["c"] for r in windows.select("window").mapInArrow(touched, "c int").distinct().collect()]] = True  # SKETCH rows at most
    shared = spark.sparkContext.broadcast(np.packbits(wanted))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask, total = np.unpackbits(shared.value).astype(bool), np.zeros(SKETCH, dtype=np.int64)
        crc = zlib.crc32
        for b in slices(batches):
            for t in b.column("text").to_pylist():
                if t:
                    c = np.fromiter(map(crc, set(t.translate(_FOLD).split())), dtype=np.uint32) & np.uint32(SKETCH - 1)
                    np.add.at(total, c[mask[c]], 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["c", "n"])

    out = np.zeros(SKETCH, dtype=np.int64)
    if wanted.any():
        counts = docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(count, "c int, n long").groupBy("c").agg(F.sum("n").alias("n")).toPandas()
        out[counts["c"].to_numpy(dtype=int)] = counts["n"].to_numpy(dtype=np.int64)
    return out


def prefix_index(windows: DataFrame, frequency: np.ndarray) -> DataFrame:
    """Adds prefix, the rarest word of the window (ties: the least word), and at, its first place there."""
    shared = windows.sparkSession.sparkContext.broadcast(frequency)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = shared.value
        for b in slices(batches):
            split = [w.split() for w in b.column("window").to_pylist()]
            best = [min(w, key=lambda x: (f[_counter(x)], x)) for w in split]
            yield b.append_column("prefix", pa.array(best, pa.binary())).append_column("at", pa.array([w.index(x) for w, x in zip(split, best, strict=True)], pa.int32()))

    return windows.mapInArrow(pick, "window binary, items array<string>, prefix binary, at int")


def index_bytes(index: DataFrame) -> int:
    return index.agg(F.sum(F.length("window") + F.length("prefix") + F.size("items") * 24 + 200)).first()[0] or 0


def by_prefix(index: DataFrame) -> dict[bytes, list]:
    """The index as a dictionary; its size has been checked."""
    out: dict[bytes, list] = {}
    for w, items, prefix, at in index.toPandas().itertuples(index=False):
        out.setdefault(bytes(prefix), []).append((bytes(w).split(), at, tuple(items)))
    return out


def hits_of(words: list[bytes], block: dict) -> tuple[list[tuple[int, int]], set[str]]:
    """Places (start, end) of the block's windows in a text, and the items they are of."""
    places, items = [], set()
    near = block.keys() & set(words)
    if near:
        n = len(words)
        for i, w in enumerate(words):
            if w in near:
                for window, at, ids in block[w]:
                    start = i - at
                    if start >= 0 and start + len(window) <= n and words[start : start + len(window)] == window:
                        places.append((start, start + len(window)))
                        items.update(ids)
    return places, items


def merged(places: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(places):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


PLACES = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def build_index(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    windows = materialize(item_windows(benchmark, window), "windows")
    return materialize(prefix_index(windows, rarity(docs, windows)), "prefixes")


def _broadcast_search(docs: DataFrame, index: DataFrame) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(by_prefix(index))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            split = [words_of(t) for t in b.column("text").to_pylist()]
            found = [hits_of(w, shared.value) for w in split]
            places = [[{"start": s, "end": e} for s, e in merged(p)] for p, _ in found]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([len(w) for w in split], pa.int64()), pa.array(places, PLACES), pa.array([sorted(i) for _, i in found], pa.list_(pa.string()))],
                ["doc_id", "n_words", "places", "items"],
            )

    return docs.mapInArrow(look, FOUND)


FOUND = "doc_id long, n_words long, places array<struct<start:bigint,end:bigint>>, items array<string>"


def _text_key(text):
    return F.md5(F.coalesce(text.cast("binary"), F.lit("").cast("binary")))


def shuffled_hits(docs: DataFrame, index: DataFrame, window: int) -> DataFrame:
    """(key, n_words, places, items) for each distinct text with hits; places may overlap."""

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(sorted({_counter(w) for w in b.column("prefix").to_pylist()}), pa.int32())], ["c"])

    prefixes = np.zeros(SKETCH, bool)
    prefixes[[r["c"] for r in index.select("prefix").mapInArrow(marked, "c int").distinct().collect()]] = True  # SKETCH rows at most
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(prefixes))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = np.unpackbits(shared.value).astype(bool)
        for b in slices(batches, 32):
            out = []
            for key, text in zip(b.column("key").to_pylist(), b.column("text").to_pylist(), strict=True):
                words = words_of(text)
                near = {w for w in set(words) if mask[_counter(w)]}
                for i, w in enumerate(words):
                    if w in near:
                        lo = max(0, i - window + 1)
                        out.append((key, len(words), i, lo, w, b" ".join(words[lo : i + window])))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()))], ["key", "n_words", "i", "lo", "prefix", "around"])

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 4096):
            good, starts, ends = [], [], []
            for i, lo, around, at, w in zip(*(b.column(c).to_pylist() for c in ("i", "lo", "around", "at", "window")), strict=True):
                words, item = around.split(), w.split()
                start = i - at - lo
                good.append(start >= 0 and words[start : start + len(item)] == item)
                starts.append(i - at)
                ends.append(i - at + len(item))
            t = pa.RecordBatch.from_arrays([b.column("key"), b.column("n_words"), pa.array(starts, pa.int64()), pa.array(ends, pa.int64()), b.column("items")], ["key", "n_words", "start", "end", "items"])
            yield t.filter(pa.array(good, pa.bool_()))

    texts = docs.select(_text_key(F.col("text")).alias("key"), F.col("text").cast("binary").alias("text"))
    met = small_side_join(texts.mapInArrow(places, "key string, n_words long, i long, lo long, prefix binary, around binary"), index, ["prefix"], most=0)
    hits = met.select("key", "n_words", "i", "lo", "around", "at", "window", "items").mapInArrow(verified, "key string, n_words long, start long, end long, items array<string>").distinct()
    # The places of one text, which are no more than its words times the lengths of windows.
    return hits.groupBy("key", "n_words").agg(F.collect_set(F.struct("start", "end")).alias("places"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))


def _shuffled_search(docs: DataFrame, index: DataFrame, window: int) -> DataFrame:
    hits = materialize(shuffled_hits(docs, index, window), "hits")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("key"), pa.array([len(words_of(t)) for t in b.column("text").to_pylist()], pa.int64())], ["doc_id", "key", "n_words"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            places = [[{"start": s, "end": e} for s, e in merged([(x["start"], x["end"]) for x in p or ()])] for p in b.column("places").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_words"), pa.array(places, PLACES), pa.array([i or [] for i in b.column("items").to_pylist()], pa.list_(pa.string()))], ["doc_id", "n_words", "places", "items"])

    rows = docs.select("doc_id", _text_key(F.col("text")).alias("key"), "text").mapInArrow(count, "doc_id long, key string, n_words long")
    return rows.join(hits.drop("n_words"), "key", "left").select("doc_id", "n_words", "places", "items").mapInArrow(merge, FOUND)


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(doc_id, n_words, places, items) for each document: places are word ranges without overlap, items the ids found."""
    index = build_index(docs, benchmark, window)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return _broadcast_search(rows, index) if index_bytes(index) <= broadcast_bytes else _shuffled_search(rows, index, window)


def n_hit(places):
    return F.aggregate(places, F.lit(0).cast("long"), lambda a, p: a + p["end"] - p["start"])


def is_contaminated(hit, words):
    return (hit > 0) & (MIN_SHARE * hit >= words)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The documents that aren't contaminated, with the columns of docs. With a broadcast index rows are judged in place."""
    index = build_index(docs, benchmark, window)
    if index_bytes(index) > broadcast_bytes:
        (key,) = unused(docs, "text_key")

        def bad(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in slices(batches):
                hit = [sum(e - s for s, e in merged([(x["start"], x["end"]) for x in p])) for p in b.column("places").to_pylist()]
                out = [MIN_SHARE * h >= n for h, n in zip(hit, b.column("n_words").to_pylist(), strict=True)]
                yield b.select(["key"]).filter(pa.array(out, pa.bool_())).rename_columns([key])

        gone = shuffled_hits(docs, index, window).mapInArrow(bad, f"`{key}` string")
        return docs.join(gone, _text_key(F.col("text")) == F.col(key), "left_anti")
    shared = docs.sparkSession.sparkContext.broadcast(by_prefix(index))

    def clean(texts: list[bytes | None]) -> list[bool]:
        out = []
        for words in map(words_of, texts):
            hit = sum(e - s for s, e in merged(hits_of(words, shared.value)[0]))
            out.append(not (hit and MIN_SHARE * hit >= len(words)))
        return out

    return keep_texts(docs, clean)
