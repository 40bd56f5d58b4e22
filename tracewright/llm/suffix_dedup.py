"""Removes long byte strings that the corpus holds more than once, by merging the sampled Burrows-Wheeler transforms of shards.

A Burrows-Wheeler transform lists the byte before each suffix in the suffixes' order. Here each shard (a slice of a task's texts) lists sampled suffixes only, and with each not one but the REACH bytes before it, which are the symbols that as many
LF steps from it would read. Samples are chosen by content: the window of W hashes of K bytes that lies within any SPAN bytes picks the same sample wherever these bytes stand, so for each place p the next sample s(p), at most REACH behind it, lies equally far from p in
every occurrence of the SPAN bytes from p on. Equal strings therefore meet at their samples, and a suffix from p is its sample's after s(p) - p LF steps.

1. Suffixes that no other shares CORE = SPAN - REACH bytes with are merged with nothing: their core's hash occurs once among all samples, and they are left out.
2. Each shard sorts its other samples and gives out its transform: core, the REACH bytes behind the core, the REACH bytes before the sample.
3. Transforms are merged block by block, a block being the samples with one core. The interleave of the shards' lists is refined one symbol at a time, as in Holt and McMillan's merge: a stable counting sort by the symbol that stands before those that are already in order, first through the bytes
   behind the core, then the core, then the bytes before. Suffixes are never compared or sorted anew. Common prefixes follow from neighbours once the symbols behind are in order; after i symbols before, runs of equal symbols before and common prefix CORE + REACH - i
   behind are the repeated intervals of the suffixes that begin i bytes before their samples, and every member of an interval with two places in it is marked.
4. A block of more than HEAVY distinct contexts (a passage that very many texts share, at whose ends they all differ) isn't gathered: the windows of its members are counted by their hashes, which tells the same.

Equal texts are one text with a count, equal contexts are one member with a count. Marked places become runs, runs are cut out.

Texts are bytes in UTF-8, so what is kept may begin or end within a character and is binary. Defined results: null and empty texts have no bytes; texts shorter than SPAN keep everything; strings never cross texts; very long texts are read whole, by one task each; equal places within one text count; repeated
rows repeat each other, so of SPAN bytes or more they lose everything; null ids are ids like others; empty tables give empty results; extra columns of any name are kept by drop_repeats and not read otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, all_columns, slices, small_side_join, unused
from .near_dedup import whole_groups

SPAN, W, K = 200, 64, 8  # 3 * W + K <= SPAN + 4: what picks a sample lies within the SPAN bytes
REACH, CORE = W - 1, SPAN - W + 1
HEAVY = 4096
_ODD = np.uint64(0x9E3779B97F4A7C15)
_HIGH, _LOW = np.uint64(0xFFFFFFFF00000000), np.uint64(0xFFFFFFFF)


def samples(text: bytes) -> np.ndarray:
    """Where the sampled suffixes of a text begin: REACH before each place that holds the least hash of some W neighbouring ones, the first of equals."""
    n = len(text) - K + 1
    if len(text) < SPAN:
        return np.zeros(0, np.int64)
    grams = np.ndarray((n,), "<u8", text, strides=(1,)) * _ODD
    grams ^= grams >> np.uint64(32)
    grams *= _ODD
    least = (grams & _HIGH) | np.arange(n, dtype=np.uint64)
    step = 1
    while step < W:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    at = (least & _LOW).astype(np.int64)
    at = at[np.concatenate([[True], at[1:] != at[:-1]])] - REACH
    return at[(at >= 0) & (at + CORE <= len(text))]


def _cores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        row, at, core, copies = [], [], [], []
        for r, n, text in zip(b.column("row").to_numpy(), b.column("copies").to_numpy(), b.column("text").to_pylist(), strict=True):
            s, view = samples(text), memoryview(text)
            at.append(s.astype(np.int32))
            core += [xxhash.xxh3_64_intdigest(view[x : x + CORE]) for x in s.tolist()]
            row.append(np.full(len(s), r))
            copies.append(np.full(len(s), n))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(row)), pa.array(np.concatenate(at)), pa.array(np.array(core, np.uint64).view(np.int64)), pa.array(np.concatenate(copies))], ["row", "at", "core", "copies"])


TRANSFORM = "row long, at int, copies long, core binary, behind binary, before binary, context binary"


def _transforms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The transform of each shard's samples that share their cores."""
    for b in slices(batches, 1024):
        listed = []
        for row, copies, places, text in zip(*(b.column(c).to_pylist() for c in ("row", "copies", "places", "text")), strict=True):
            listed += [(text[x : x + SPAN], text[max(0, x - REACH) : x], row, x, copies) for x in places]
        listed.sort(key=lambda m: m[0])
        core = [xxhash.xxh3_128_digest(m[0][:CORE]) for m in listed]
        context = [xxhash.xxh3_128_digest(bytes((len(m[0]), len(m[1]))) + m[1] + m[0]) for m in listed]
        columns = [pa.array([m[k] for m in listed], t) for k, t in ((2, pa.int64()), (3, pa.int32()), (4, pa.int64()))]
        columns += [pa.array(x, pa.binary()) for x in (core, [m[0][CORE:] for m in listed], [m[1] for m in listed], context)]
        yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in TRANSFORM.split(", ")])


def symbols(parts: list[bytes], from_end: bool) -> np.ndarray:
    """(place, part): the bytes plus 1 from the front, or from the end backwards; 0 where a part has ended."""
    out = np.zeros((len(parts), REACH), np.uint16)
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    flat = np.frombuffer(b"".join(parts), np.uint8).astype(np.uint16) + 1
    k = np.arange(REACH)
    out[k[None] < lengths[:, None]] = flat
    if from_end:
        back = lengths[:, None] - 1 - k[None]
        out = np.where(back >= 0, np.take_along_axis(out, np.maximum(back, 0), axis=1), 0).astype(np.uint16)
    return np.ascontiguousarray(out.T)


def merge(core: np.ndarray, behind: list[bytes], before: list[bytes], count: np.ndarray) -> np.ndarray:
    """For each member of blocks a mask of the i for which the SPAN bytes that begin i before its sample stand at two places or more. core: a number for each block's core; count: how many places a member is."""
    ahead, back, n = symbols(behind, False), symbols(before, True), len(core)
    order = np.arange(n)
    for symbol in ahead[::-1]:
        order = order[np.argsort(symbol[order], kind="stable")]
    order = order[np.argsort(core[order], kind="stable")]
    same = ahead[:, order[1:]] == ahead[:, order[:-1]]
    prefix = np.where(same.all(axis=0), REACH, same.argmin(axis=0))  # common bytes behind the core with the one before
    prefix[core[order[1:]] != core[order[:-1]]] = -1
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    length, room = (ahead > 0).sum(axis=0), (back > 0).sum(axis=0)
    run, marks = np.zeros(n, np.int64), np.zeros(n, np.uint64)
    for i in range(REACH + 1):
        if i:
            order = order[room[order] >= i]  # the others' texts begin here
            symbol = back[i - 1]
            order = order[np.argsort(symbol[order], kind="stable")]
            new = np.concatenate([[0], np.cumsum((symbol[order[1:]] != symbol[order[:-1]]) | (run[order[1:]] != run[order[:-1]]))]) if len(order) else order
            run[order] = new
        if not len(order):
            break
        right = np.concatenate([[0], np.cumsum(prefix < REACH - i)])[rank[order]]
        first = np.flatnonzero(np.concatenate([[True], (run[order[1:]] != run[order[:-1]]) | (right[1:] != right[:-1])]))
        places = np.add.reduceat(count[order], first)
        found = np.repeat(places >= 2, np.diff(np.append(first, len(order)))) & (length[order] >= REACH - i)
        marks[order[found]] |= np.uint64(1) << np.uint64(i)
    return marks


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t, _ in whole_groups(batches, ["block"]):
        names: dict[bytes, int] = {}
        core = np.fromiter((names.setdefault(c, len(names)) for c in t.column("core").to_pylist()), np.int64, t.num_rows)
        marks = merge(core, t.column("behind").to_pylist(), t.column("before").to_pylist(), t.column("places").to_numpy())
        out = pa.RecordBatch.from_arrays([t.column("context").combine_chunks(), pa.array(marks.view(np.int64))], ["context", "marks"])
        yield out.filter(pa.array(marks > 0))


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of all windows of contexts."""
    for b in slices(batches):
        key, context, at, places = [], [], [], []
        for core, behind, before, ctx, n in zip(*(b.column(c).to_pylist() for c in ("core", "behind", "before", "context", "places")), strict=True):
            own = range(max(0, REACH - len(behind)), len(before) + 1)
            key += [xxhash.xxh3_128_digest(core + bytes((i,)) + before[len(before) - i :] + behind[: REACH - i]) for i in own]
            at += own
            context += [ctx] * len(own)
            places += [n] * len(own)
        yield pa.RecordBatch.from_arrays([pa.array(key, pa.binary()), pa.array(context, pa.binary()), pa.array(at, pa.int32()), pa.array(places, pa.int64())], ["window", "context", "i", "places"])


def marked(contexts: DataFrame, tmp: Workspace) -> DataFrame:
    """(context, marks) of contexts with repeated windows. contexts: (core, context, behind, before, places)."""
    heavy = tmp.write(contexts.groupBy("core").agg(F.count("*").alias("n")).where(F.col("n") > HEAVY).select("core", F.lit(True).alias("heavy")), "heavy")
    rest, out = contexts, None
    if not heavy.isEmpty():
        dealt = small_side_join(contexts, heavy, ["core"], "left")
        rest = dealt.where("heavy IS NULL").drop("heavy")
        windows = tmp.write(dealt.where("heavy").mapInArrow(_windows, "window binary, context binary, i int, places long"), "windows")
        twice = windows.groupBy("window").agg(F.sum("places").alias("n")).where("n > 1").select("window")
        out = windows.join(twice, "window").groupBy("context").agg(F.bit_or(F.expr("shiftleft(1L, i)")).alias("marks"))
    blocks = rest.withColumn("block", F.xxhash64("core")).repartition("block").sortWithinPartitions("block")
    light = blocks.mapInArrow(_merged, "context binary, marks long")
    return light if out is None else light.unionByName(out)


def spans_of(places: list[int], marks: list[int], size: int) -> list[tuple[int, int]]:
    """Maximal runs that SPAN bytes from the marked places on cover."""
    at, bits = np.array(places, np.int64), np.array(marks, np.int64).view(np.uint64)
    starts = [at[(bits >> np.uint64(i)) & np.uint64(1) > 0] - i for i in range(REACH + 1)]
    s = np.unique(np.concatenate(starts))
    if not len(s):
        return []
    cut = np.flatnonzero(np.diff(s) > SPAN) + 1
    return list(zip(s[np.concatenate([[0], cut])].tolist(), (s[np.concatenate([cut - 1, [len(s) - 1]])] + SPAN).tolist(), strict=True))


CUT = "cls binary, spans array<struct<start:long,end:long>>, kept binary"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        spans, kept = [], []
        for marks, text in zip(b.column("marks").to_pylist(), b.column("text").to_pylist(), strict=True):
            spans.append(spans_of([m["at"] for m in marks], [m["marks"] for m in marks], len(text)))
            at, left = 0, []
            for start, end in spans[-1]:
                left.append(text[at:start])
                at = end
            kept.append(b"".join([*left, text[at:]]))
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        yield pa.RecordBatch.from_arrays([b.column("cls"), pa.array([[{"start": s, "end": e} for s, e in x] for x in spans], kind), pa.array(kept, pa.binary())], ["cls", "spans", "kept"])


def text_class(text):
    """Equal for equal texts; null counts as empty."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def cut_texts(docs: DataFrame, tmp: Workspace) -> DataFrame:
    """(cls, spans, kept) of each distinct text with repeated bytes, stored."""
    long = docs.where(F.octet_length("text") >= SPAN).select(text_class(F.col("text")).alias("cls"), F.col("text").cast("binary").alias("text"))
    texts = tmp.write(long.groupBy("cls").agg(F.first("text").alias("text"), F.count("*").alias("copies")).withColumn("row", F.monotonically_increasing_id()), "texts")
    found = tmp.write(texts.select("row", "copies", "text").mapInArrow(_cores, "row long, at int, core long, copies long"), "samples")
    shared = tmp.write(found.groupBy("core").agg(F.sum("copies").alias("n")).where("n > 1").select("core"), "shared")
    open_ = tmp.write(found.join(shared, "core").groupBy("row").agg(F.collect_list("at").alias("places")), "open")
    tmp.drop("samples", "shared")
    listed = tmp.write(open_.join(texts.select("row", "copies", "text"), "row").mapInArrow(_transforms, TRANSFORM), "transforms")
    contexts = tmp.write(listed.groupBy("context").agg(F.first("core").alias("core"), F.first("behind").alias("behind"), F.first("before").alias("before"), F.sum("copies").alias("places")), "contexts")
    marks = tmp.write(marked(contexts, tmp), "marks")
    places = listed.select("row", "at", "context").join(marks, "context").groupBy("row").agg(F.collect_list(F.struct("at", "marks")).alias("marks"))
    tmp.drop_all_but("texts", "transforms", "marks")
    return tmp.write(places.join(texts.select("row", "cls", "text"), "row").select("cls", "marks", "text").mapInArrow(_cut, CUT), "cut", keep=True)


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, text, spans, kept) of each row: spans are the byte runs that strings of SPAN bytes cover which also begin elsewhere; kept is the rest, null where nothing is removed."""
    with Workspace(docs.sparkSession, "suffix") as tmp:
        cut = cut_texts(docs, tmp)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("cls", text_class(F.col("text")))
    return rows.join(cut, "cls", "left").select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "text", "spans", "kept")


def drop_repeats(docs: DataFrame) -> DataFrame:
    """docs with one more column, kept (underscores behind the name where docs has it): the bytes of the text that no repeated string covers, null for null."""
    with Workspace(docs.sparkSession, "suffix") as tmp:
        cut = cut_texts(docs, tmp)
    cls, own, kept, name = unused(docs, "cls", "own_cls", "kept_bytes", "kept")
    cut = cut.select(F.col("cls").alias(cls), F.col("kept").alias(kept))
    keyed = docs.withColumn(own, text_class(F.col("text")))
    left = F.coalesce(F.col(kept), F.col("text").cast("binary")).alias(name)
    return keyed.join(cut, F.col(own) == F.col(cls), "left").select(*all_columns(docs), left)
