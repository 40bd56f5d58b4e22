"""Near-duplicate documents by HyperMinHash, with exact links.

A document's set is its distinct shingles of SHINGLE words. One 64-bit hash of each shingle falls, by its first
bits, into one of REGISTERS buckets; a bucket keeps its least hash as a leading-zero count and MANTISSA bits, 16 bits in all. Empty
buckets borrow from occupied ones in an order that is fixed for each bucket, so small sets have full signatures too.
BANDS bands of compressed registers make candidates; the share of equal registers, less the collisions expected of compressed registers, estimates
the similarity, and pairs far below the threshold go. The others are verified on their full sets of shingles.

Exact copies (same words) are one class, represented by its words' 128-bit hash; only classes are compared. No bucket is capped, and no list of a bucket's pairs is ever made:

1. in ROUNDS rounds, each class is verified against members of its buckets that aren't in its component yet: first the least of all, then one of each of the largest components that
   its buckets hold, TRIES at most. What is linked is joined into components, so a large group of near copies costs about one pair for each of its members;
2. in every bucket that still spans components, the signatures of the members outside the largest component are compared with those of all members of other components, in blocks of
   BLOCK times BLOCK. What leaves a block is its members that have a partner there, at most once each; a pair counts in the first band that it shares only;
3. these members meet again in the same blocks with their texts, where the pairs are verified by the postings of their shingles, and a block gives out as many links as join its components.

So what is written grows with the members of the buckets and their blocks, and never with their pairs. The time of step 2 grows with outside * members of a bucket, which is what it takes to lose no link between different texts that
are each similar to few others; ROUNDS leaves few outside where a group is linked at all.

Two documents of similarity 0.75 share a band with probability 1 - 5e-6, more for more similar ones.

Defined results: a null or blank text has no set, is its own component and is kept; a document of fewer words than a shingle has its
whole sequence as its one shingle; texts of any length are read whole, and a block takes fewer of long ones; null doc_ids aren't linked, have a null component and are kept; repeated rows get a row each, with the same component;
where rows share a doc_id, the pipeline stage decides by row: of a component, one row of its least id stays, that of the least class if there are several; empty tables give empty results; extra columns of any name are not read by the query, and kept by the stage.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Workspace, all_columns, slices, unused

SHINGLE, PERCENT = 5, 75
REGISTERS, MANTISSA, BANDS = 128, 10, 32
ESTIMATE_AT_LEAST = 0.5  # 6 standard deviations below PERCENT
EQUAL_AT_LEAST = math.ceil(REGISTERS * (ESTIMATE_AT_LEAST + (1 - ESTIMATE_AT_LEAST) * 2.0**-MANTISSA / 3))  # equal registers that make this estimate
ROUNDS, TRIES = 2, 6
BLOCK, BLOCK_SHINGLES = 512, 1 << 20
SEEN_BITS = (1 << 16, 1 << 28)  # least and most bits of the bitmap that keeps texts that aren't wanted out of the shuffle; 32 MB at most
HEAVY, PARTNERS = 32, 256
WORD_CACHE = 500_000
LEFT, RIGHT, BOTH = 0, 1, 2
_FREE = 64 - REGISTERS.bit_length() + 1  # hash bits below those that pick the bucket
_STARTS = (np.arange(REGISTERS, dtype=np.uint64) << np.uint64(_FREE))
_PROBES = np.argsort(np.random.default_rng(11).random((REGISTERS, REGISTERS)), axis=1)
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
_words: dict[bytes, int] = {}


def shingles(text: bytes | None) -> tuple[bytes, np.ndarray]:
    """The class of a text (128-bit hash of its words) and its set, as sorted distinct 64-bit hashes."""
    words = (text or b"").lower().split()
    if not words:
        return b"", np.zeros(0, np.uint64)
    joined = b" ".join(words)
    key = xxhash.xxh3_128_digest(joined)
    if len(words) < SHINGLE:
        return key, np.array([xxhash.xxh3_64_intdigest(joined, 1)], np.uint64)
    if len(_words) > WORD_CACHE:
        _words.clear()
    get, new = _words.get, xxhash.xxh3_64_intdigest
    hashed = [get(w) for w in words]
    if None in hashed:
        for i, h in enumerate(hashed):
            if h is None:
                hashed[i] = _words[words[i]] = new(words[i])
    w = np.array(hashed, np.uint64)
    n = len(w) - SHINGLE + 1
    h = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        h = h * _ODD[0] + w[k : k + n]
    h = (h ^ (h >> np.uint64(29))) * _ODD[1]
    h = (h ^ (h >> np.uint64(32))) * _ODD[2]
    return key, np.unique(h ^ (h >> np.uint64(30)))


def signature(s: np.ndarray) -> bytes:
    """REGISTERS registers of 16 bits for a set that isn't empty."""
    at = np.searchsorted(s, _STARTS)
    first = s[np.minimum(at, len(s) - 1)]
    full = (at < len(s)) & ((first >> np.uint64(_FREE)) == np.arange(REGISTERS, dtype=np.uint64))
    m, e = np.frexp((first & np.uint64((1 << _FREE) - 1)).astype(np.float64))
    zeros = np.where(m > 0, _FREE - e, _FREE).astype(np.int64)
    bits = np.where(m > 0, (2 * m - 1) * (1 << MANTISSA), 0).astype(np.int64)
    reg = (np.minimum(zeros, 63) << MANTISSA | np.minimum(bits, (1 << MANTISSA) - 1)).astype("<u2")
    empty = np.flatnonzero(~full)
    if len(empty):
        reg[empty] = reg[_PROBES[empty, full[_PROBES[empty]].argmax(axis=1)]]
    return reg.tobytes()


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity from rows of registers: the share of equal ones, corrected for equal compressed registers of unequal hashes."""
    chance = 2.0**-MANTISSA / 3  # equal leading-zero counts: sum of 4**-k; then equal mantissas
    return ((a == b).mean(axis=1) - chance) / (1 - chance)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    if len(a) < len(b):
        a, b = b, a
    if not len(b) or 100 * len(b) < PERCENT * len(a):
        return False
    both = int((a[np.minimum(np.searchsorted(a, b), len(a) - 1)] == b).sum())
    return 100 * both >= PERCENT * (len(a) + len(b) - both)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        sets = [shingles(t) for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [
                b.column("doc_id"), pa.array([k or None for k, _ in sets], pa.binary()), pa.array([len(s) for _, s in sets], pa.int64()),
                pa.array([np.frombuffer(signature(s), "<i8") if len(s) else None for _, s in sets], pa.list_(pa.int64())),
            ],
            ["doc_id", "cls", "n_shingles", "keys"],
        )


def signed(docs: DataFrame) -> DataFrame:
    """(doc_id, cls, n_shingles, keys): keys holds a 64-bit integer for each band, together the signature."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(_sign, "doc_id long, cls binary, n_shingles long, keys array<bigint>")


def components(edges: DataFrame, tmp: Workspace) -> DataFrame:
    """(cls, comp) for the nodes of edges (a, b), a < b; comp is one of the component's nodes.

    Every round sends each node to the least node beside it and contracts; node names are hashes, so that the graph
    shrinks by a factor each round, long chains included.
    """
    steps = []
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = tmp.write(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("cls"), F.least("a", "m").alias("to")), f"step-{len(steps)}")
        steps.append(step)
        ends = edges.join(step.select(F.col("cls").alias("a"), F.col("to").alias("ta")), "a").join(step.select(F.col("cls").alias("b"), F.col("to").alias("tb")), "b")
        edges = tmp.write(_ordered(ends.where("ta != tb").select(F.col("ta").alias("a"), F.col("tb").alias("b"))), "contracted")
    if not steps:
        return edges.select(F.col("a").alias("cls"), F.col("b").alias("comp"))
    label = steps[0].withColumnRenamed("to", "comp")
    for step in steps[1:]:
        label = label.join(step.withColumnRenamed("cls", "comp"), "comp", "left").select("cls", F.coalesce("to", "comp").alias("comp"))
    return label


def promising(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs whose corrected estimate is ESTIMATE_AT_LEAST or more and whose sets are of sizes that can be similar."""

    def enough(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ra, rb = (b.column(c).flatten().to_numpy().view("<u2").reshape(b.num_rows, REGISTERS) for c in ("ka", "kb"))
            yield b.select(["a", "b"]).filter(pa.array(estimate(ra, rb) >= ESTIMATE_AT_LEAST))

    with_b = pairs.join(classes.select(F.col("cls").alias("b"), F.col("keys").alias("kb"), F.col("n").alias("nb")), "b")
    both = with_b.join(classes.select(F.col("cls").alias("a"), F.col("keys").alias("ka"), F.col("n").alias("na")), "a")
    return both.where(F.lit(100) * F.least("na", "nb") >= PERCENT * F.greatest("na", "nb")).select("a", "b", "ka", "kb").mapInArrow(enough, "a binary, b binary")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are similar. texts: (cls, text), one row for each class.

    An a with few partners makes a group with them. Those with HEAVY or more are dealt into blocks of about HEAVY, their partners into blocks of about PARTNERS, and each pair of blocks is a group:
    it holds the sets of its a's and reads its b's one by one, so a text is shipped once for a block and not once for a pair.
    """

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = None, {}
        for batch in slices(batches):
            out = []
            for ia, ib, node, partners, text in zip(*(batch.column(c).to_pylist() for c in ("ia", "ib", "node", "partners", "text")), strict=True):
                if at != (ia, ib):
                    at, own = (ia, ib), {}
                _, s = shingles(text)
                if partners is None:
                    own[node] = s
                else:
                    out += [(a, node) for a in partners if similar(own[a], s)]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.binary())], ["a", "b"])

    counts = pairs.groupBy("a").agg(F.count("*").alias("n"))
    blocks_a = max(1, -(-counts.where(F.col("n") >= HEAVY).count() // HEAVY))
    blocks_b = max(1, -(-texts.count() // PARTNERS))
    heavy = F.col("n") >= HEAVY
    dealt = pairs.join(counts, "a").select(
        "a", "b", F.when(heavy, F.pmod(F.xxhash64("a"), F.lit(blocks_a))).otherwise(F.xxhash64("a")).alias("ia"), F.when(heavy, F.pmod(F.xxhash64("b"), F.lit(blocks_b)) + 1).otherwise(0).alias("ib")
    )
    own = dealt.select("ia", "ib", "a").distinct().join(texts.withColumnRenamed("cls", "a"), "a").select("ia", "ib", F.lit(0).alias("side"), F.col("a").alias("node"), F.lit(None).cast("array<binary>").alias("partners"), "text")
    other = dealt.groupBy("ia", "ib", "b").agg(F.collect_list("a").alias("partners")).join(texts.withColumnRenamed("cls", "b"), "b").select("ia", "ib", F.lit(1).alias("side"), F.col("b").alias("node"), "partners", "text")
    ordered = own.unionByName(other).repartition("ia", "ib").sortWithinPartitions("ia", "ib", "side")
    return ordered.mapInArrow(check, "a binary, b binary")


def equal_counts(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many registers each row of a has in common with each row of b."""
    if len(a) * len(b) <= 1024:
        return (a[:, None] == b[None]).sum(axis=2)
    a, b = np.ascontiguousarray(a.T), np.ascontiguousarray(b.T)
    n, same = np.zeros((a.shape[1], b.shape[1]), np.uint8), np.empty((a.shape[1], b.shape[1]), bool)
    for x, y in zip(a, b, strict=True):
        np.equal(x[:, None], y[None], out=same)
        n += same.view(np.uint8)
    return n


def candidates(keys: np.ndarray, band: np.ndarray, comp: np.ndarray, side: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (i, j) of a block's rows to verify: left and right rows of different components whose estimate and sizes allow it and whose first common band is this one."""
    a, b = np.flatnonzero(side != RIGHT), np.flatnonzero(side != LEFT)
    regs = keys.view("<u2")
    near = equal_counts(regs[a], regs[b]) >= EQUAL_AT_LEAST
    near &= comp[a][:, None] != comp[b][None]
    i, j = np.nonzero(near)
    i, j = a[i], b[j]
    ok = (side[i] + side[j] < 2 * BOTH) | (i < j)  # a block with itself has each pair once
    ok &= 100 * np.minimum(n[i], n[j]) >= PERCENT * np.maximum(n[i], n[j])
    i, j = i[ok], j[ok]
    own = np.zeros(len(i), bool)
    for at in range(0, len(i), 1 << 16):
        x, y = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
        same = keys[x] == keys[y]
        first = same.argmax(axis=1)
        own[at : at + (1 << 16)] = (first == band[x]) & (first == band[y]) & same[np.arange(len(x)), first]
    return i[own], j[own]


def verify(i: np.ndarray, j: np.ndarray, sets: dict[int, np.ndarray]) -> np.ndarray:
    """Which of the pairs are similar on their full sets, by the postings of the shingles of the rows in i."""
    if len(i) <= 4:
        return np.array([similar(sets[x], sets[y]) for x, y in zip(i.tolist(), j.tolist(), strict=True)], bool)
    left, li = np.unique(i, return_inverse=True)
    size = np.array([len(sets[x]) for x in left.tolist()])
    values = np.concatenate([sets[x] for x in left.tolist()])
    order = np.argsort(values, kind="stable")
    values, owner = values[order], np.repeat(np.arange(len(left)), size)[order]
    good = np.zeros(len(i), bool)
    by = np.argsort(j, kind="stable")
    for at in np.split(by, np.flatnonzero(np.diff(j[by])) + 1):
        s = sets[int(j[at[0]])]
        lo, hi = np.searchsorted(values, s, "left"), np.searchsorted(values, s, "right")
        met = hi - lo
        total = int(met.sum())
        posted = np.repeat(lo - (np.cumsum(met) - met), met) + np.arange(total)
        both = np.bincount(owner[posted], minlength=len(left))[li[at]]
        good[at] = 100 * both >= PERCENT * (size[li[at]] + len(s) - both)
    return good


def whole_groups(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[tuple[pa.Table, list[int]]]:
    """Tables of whole groups of rows that are sorted by some numbers, with the bounds of the groups."""
    held = None
    for b in batches:
        t = pa.Table.from_batches([b])
        t = t if held is None else pa.concat_tables([held, t])
        changes = np.zeros(max(0, t.num_rows - 1), bool)
        for c in by:
            x = t.column(c).to_numpy()
            changes |= x[1:] != x[:-1]
        bounds = [0, *(np.flatnonzero(changes) + 1).tolist()]
        if bounds[-1]:
            yield t.slice(0, bounds[-1]), bounds
        held = t.slice(bounds[-1])
    if held is not None and held.num_rows:
        yield held, [0, held.num_rows]


AT = ["bucket", "left", "right"]
MEMBERS = "bucket long, left long, right long, side int, band int, cls binary, comp binary, n long, keys array<bigint>"


def _columns(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    names: dict[bytes, int] = {}
    comp = np.fromiter((names.setdefault(c, len(names)) for c in t.column("comp").to_pylist()), np.int64, t.num_rows)
    keys = t.column("keys").combine_chunks().flatten().to_numpy().reshape(t.num_rows, BANDS)
    return keys, t.column("band").to_numpy(), comp, t.column("side").to_numpy(), t.column("n").to_numpy()


def with_partners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The members of blocks that have a candidate there."""
    for t, bounds in whole_groups(batches, AT):
        cols, found = _columns(t), np.zeros(t.num_rows, bool)
        for lo, hi in zip(bounds, bounds[1:], strict=False):
            i, j = candidates(*[c[lo:hi] for c in cols])
            found[lo + i] = found[lo + j] = True
        yield from t.filter(pa.array(found)).combine_chunks().to_batches()


def linked_components(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b): components of a block that similar members join, no more than it takes to join them."""
    for t, bounds in whole_groups(batches, AT):
        cols, comp, text, out = _columns(t), t.column("comp").to_pylist(), t.column("text"), []
        for lo, hi in zip(bounds, bounds[1:], strict=False):
            i, j = candidates(*[c[lo:hi] for c in cols])
            if not len(i):
                continue
            sets = {x: shingles(text[lo + x].as_py())[1] for x in np.unique(np.concatenate([i, j])).tolist()}
            good = verify(i, j, sets)
            root: dict[bytes, bytes] = {}
            for x, y in zip(i[good].tolist(), j[good].tolist(), strict=True):
                a, b = comp[lo + x], comp[lo + y]
                ra, rb = _root(root, a), _root(root, b)
                if ra != rb:
                    root[ra] = rb
                    out.append((min(a, b), max(a, b)))
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.binary()) for k in (0, 1)], ["a", "b"])


def _root(root: dict, x):
    while x in root:
        x = root[x]
    return x


def in_blocks(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """MEMBERS of the blocks of all buckets that span components. rows: (bucket, band, cls, comp, n).

    Members outside a bucket's largest component are dealt into blocks 0 .. outer - 1, which meet each other and themselves, and those of the largest into blocks from outer on, which meet these only.
    A bucket that fits into one block is one.
    """
    sizes = rows.groupBy("bucket", "comp").agg(F.count("*").alias("m"), F.sum("n").alias("s"))
    spans = sizes.groupBy("bucket").agg(F.sum("m").alias("members"), F.sum("s").alias("shingles"), F.max(F.struct("m", "comp", "s")).alias("main")).where("members > main.m")
    blocks = lambda m, s: F.greatest(F.ceil(m / BLOCK), F.ceil(s / BLOCK_SHINGLES))
    spans = spans.select(
        "bucket", F.col("main.comp").alias("main"), (blocks(F.col("members"), F.col("shingles")) == 1).alias("single"),
        blocks(F.col("members") - F.col("main.m"), F.col("shingles") - F.col("main.s")).alias("outer"), blocks(F.col("main.m"), F.col("main.s")).alias("inner"),
    )
    met = rows.join(spans, "bucket").withColumn("in_main", F.col("comp") == F.col("main"))
    own = F.when(F.col("in_main"), F.col("outer") + F.pmod(F.xxhash64("cls"), "inner")).otherwise(F.pmod(F.xxhash64("cls"), "outer"))
    met = met.withColumn("own", own)
    zero = F.lit(0).cast("long")
    at = lambda left, right, side: F.struct(left.alias("left"), right.alias("right"), side.cast("int").alias("side"))
    before = lambda upto: F.transform(F.filter(F.sequence(zero, F.greatest(upto, zero)), lambda x: x < upto), lambda x: at(x, F.col("own"), F.lit(RIGHT)))
    after = F.transform(F.sequence("own", F.col("outer") + F.col("inner") - 1), lambda x: at(F.col("own"), x, F.when(x == F.col("own"), BOTH).otherwise(LEFT)))
    cells = (
        F.when(F.col("single"), F.array(at(zero, zero, F.when(F.col("in_main"), RIGHT).otherwise(BOTH))))
        .when(F.col("in_main"), before(F.col("outer"))).otherwise(F.concat(after, before(F.col("own"))))
    )
    dealt = met.select("bucket", "band", "cls", "comp", "n", F.inline(cells))
    return dealt.join(classes.select("cls", "keys"), "cls").select(*[c.split()[0] for c in MEMBERS.split(", ")])


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _by_block(rows: DataFrame) -> DataFrame:
    return rows.repartition(*AT).sortWithinPartitions(*AT)


def _members(docs: DataFrame, tmp: Workspace) -> DataFrame:
    """(doc_id, cls, n_shingles, component_id, root) of each row, stored; root: the row's class is the least class of its component's least id."""
    rows = tmp.write(signed(docs), "signed")
    usable = rows.where("cls IS NOT NULL AND doc_id IS NOT NULL")
    classes = tmp.write(usable.groupBy("cls").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("keys").alias("keys")), "classes")
    # A bucket is a hash of the band and its key; should two buckets share one, they only make more candidates.
    banded = classes.select("cls", "n", F.posexplode("keys").alias("band", "key")).select("cls", "n", "band", F.xxhash64("band", "key").alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.count("*").alias("members"), F.min("cls").alias("least")).where("members > 1").select("bucket", "least")
    buckets = tmp.write(banded.join(shared, "bucket").select("cls", "n", "band", "bucket", "least"), "buckets")
    comps = None

    def labelled(b: DataFrame) -> DataFrame:
        return b.withColumn("comp", F.col("cls")) if comps is None else b.join(comps, "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))

    def joined(links: DataFrame) -> DataFrame:
        """Components after links between components."""
        new = components(links, tmp)
        if comps is None:
            return tmp.write(new, "comps")
        moved = comps.join(new.select(F.col("cls").alias("comp"), F.col("comp").alias("to")), "comp", "left").select("cls", F.coalesce("to", "comp").alias("comp"))
        alone = new.join(comps, "cls", "left_anti")
        return tmp.write(moved.unionByName(alone), "comps")

    def texts(wanted: DataFrame) -> DataFrame:
        return tmp.write(_texts(docs, wanted.select("cls").distinct().join(classes.select("cls", "rep"), "cls")), "texts")

    # 1: the least member of all buckets first; then members of the buckets' largest components.
    for k in range(ROUNDS):
        if k == 0:
            pairs = buckets.groupBy("cls").agg(F.min("least").alias("a")).select("a", F.col("cls").alias("b")).where("a != b")
        else:
            now = labelled(buckets.select("cls", "bucket"))
            sizes = now.groupBy("bucket", "comp").agg(F.count("*").alias("m"), F.min_by("cls", F.xxhash64("cls", "bucket", F.lit(k))).alias("p"))
            main = sizes.groupBy("bucket").agg(F.max(F.struct("m", "comp", "p")).alias("top"), F.count("*").alias("comps")).where("comps > 1 AND top.m > 1")
            tried = now.join(main.select("bucket", "top"), "bucket").where("top.comp != comp")
            few = F.slice(F.array_sort(F.collect_set(F.struct(F.xxhash64("top.p", "cls").alias("o"), F.col("top.p").alias("p")))), 1, TRIES)  # a class is in BANDS buckets
            pairs = tried.groupBy("cls").agg(few.alias("ps")).select(F.explode("ps").alias("p"), F.col("cls").alias("b")).select(F.col("p.p").alias("a"), "b")
        good = tmp.write(promising(_ordered(pairs), classes), "pairs")
        if good.isEmpty():
            break
        ends = good.select(F.col("a").alias("cls")).unionByName(good.select(F.col("b").alias("cls")))
        found = tmp.write(verified(good, texts(ends)), "links")
        if comps is not None:
            for c in "ab":
                found = found.join(comps.select(F.col("cls").alias(c), "comp"), c, "left").withColumn(c, F.coalesce("comp", c)).drop("comp")
            found = tmp.write(_ordered(found.where("a != b")), "joined")
        if found.isEmpty():
            break
        comps = joined(found)
    # 2: what buckets still hold across components, by signature.
    open_ = tmp.write(_by_block(in_blocks(labelled(buckets.drop("least")), classes)).mapInArrow(with_partners, MEMBERS), "open")
    # 3: and by their texts.
    if not open_.isEmpty():
        links = _by_block(open_.join(texts(open_), "cls").select(*open_.columns, "text")).mapInArrow(linked_components, "a binary, b binary")
        links = tmp.write(links.distinct(), "links")
        if not links.isEmpty():
            comps = joined(links)

    least = tmp.write(labelled(classes.select("cls", "rep")), "least")
    roots = least.groupBy("comp").agg(F.min(F.struct("rep", "cls")).alias("root"))
    by_class = least.join(roots, "comp").select("cls", F.col("root.rep").alias("component_id"), ((F.col("root.rep") == F.col("rep")) & (F.col("root.cls") == F.col("cls"))).alias("root"))
    single = rows.where("cls IS NULL OR doc_id IS NULL").select("doc_id", "cls", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("root"))
    known = usable.select("doc_id", "cls", "n_shingles").join(by_class, "cls").select("doc_id", "cls", "n_shingles", "component_id", (F.col("root") & (F.col("doc_id") == F.col("component_id"))).alias("root"))
    return tmp.write(single.unionByName(known), "members", keep=True)


def link(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each document."""
    with Workspace(docs.sparkSession, "near") as tmp:
        out = _members(docs, tmp)
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(cls, text) for the wanted (cls, rep): the text of a row rep that is of class cls.

    A bitmap of wanted ids, of eight bits an id up to SEEN_BITS[1], keeps most other texts out of the shuffle; the join decides.
    """
    bits = min(SEEN_BITS[1], max(SEEN_BITS[0], 1 << (8 * wanted.count()).bit_length()))
    bit = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    marks = wanted.select(bit("rep").alias("h")).groupBy(F.bitmap_bucket_number(F.col("h") + 1).alias("n")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("h") + 1)).alias("bits"))
    seen = np.zeros(bits // 8, np.uint8)
    for r in marks.toLocalIterator():  # bits / 32768 rows of 4 kB
        seen[(r["n"] - 1) * 4096 : r["n"] * 4096] = np.frombuffer(r["bits"], np.uint8)[: bits // 8]
    shared = docs.sparkSession.sparkContext.broadcast(seen)

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = shared.value
        for b in batches:
            h = b.column("h").to_numpy()
            yield b.filter(pa.array((mask[h >> 3] >> (h & 7)) & 1 == 1)).select(["rep", "text"])

    def of_class(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            same = [_class(t) == c for c, t in zip(b.column("cls").to_pylist(), b.column("text").to_pylist(), strict=True)]
            yield b.filter(pa.array(same, pa.bool_()))

    rows = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("rep"), F.col("text").cast("binary").alias("text"))
    rows = rows.select("rep", "text", bit("rep").alias("h")).mapInArrow(likely, "rep long, text binary")
    found = rows.join(wanted, "rep").select("cls", "text").mapInArrow(of_class, "cls binary, text binary")
    return found.groupBy("cls").agg(F.first("text").alias("text"))


def _class(text: bytes | None) -> bytes | None:
    words = (text or b"").lower().split()
    return xxhash.xxh3_128_digest(b" ".join(words)) if words else None


@F.pandas_udf(T.BinaryType())
def class_of(text: pd.Series) -> pd.Series:
    return text.map(_class)


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """One document of each component, with the columns of docs; documents without words or id stay."""
    with Workspace(docs.sparkSession, "near") as tmp:
        rows = _members(docs, tmp)
    columns, (id_, cls, root) = all_columns(docs), unused(docs, "near_id", "near_cls", "near_root")
    gone = rows.where("NOT root").select(F.col("doc_id").alias(id_)).distinct()
    twice = rows.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias(id_))
    same = F.col("doc_id").cast("long") == F.col(id_)
    if twice.isEmpty():
        return docs.join(gone, same, "left_anti")
    # An id of several rows doesn't say which of them goes, so their texts' classes do.
    keyed = docs.join(twice, same, "left_semi").withColumn(cls, class_of(F.col("text").cast("binary")))
    roots = rows.where("root AND cls IS NOT NULL AND doc_id IS NOT NULL").select(F.col("doc_id").alias(id_), F.col("cls").alias(root)).distinct()
    alone = keyed.where(F.col(cls).isNull()).select(*columns)
    again = keyed.join(roots, same & (F.col(cls) == F.col(root)), "left_semi").dropDuplicates(["doc_id", cls]).select(*columns)
    return docs.join(gone.unionByName(twice), same, "left_anti").unionByName(alone).unionByName(again)
