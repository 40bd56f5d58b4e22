"""Product quantisation of vectors in integers: an RDD's treeAggregate over columnar NumPy blocks.

Vectors are scaled to integers and cut into PARTS equal parts; each part has a codebook of ENTRIES entries. The rows are stored once as blocks of BLOCK vectors, each an array (part, dimension, vector), so that a
round reads long columns: distances to the entries accumulate one dimension after the other, np.add.at adds the parts up by their entry, and treeAggregate merges these int64 sums and counts through a tree of
partial tables. A table has PARTS * ENTRIES * dimensions numbers however many rows there are, and it is all that reaches the driver. All sums are of integers, so the result doesn't depend on how rows are dealt out or on tasks that run again.

Defined results: rows whose vector is null or empty, or holds a null or a component that isn't finite, are left out, and so are vectors of another length than that of the least id's vector. A length that PARTS doesn't divide
is filled up with zeros. Codebooks start from the least ids, null ids last; rows that share an id go by their vectors, and equal rows are as many entries (of which the first is always nearest). With fewer rows than ENTRIES there are as many entries as rows.
An entry without parts stays as it is. An empty table, or one without usable vectors, gives no codes and an empty codebook. Very long vectors are like others; extra columns of any name are not read. Scaled components beyond 2^24 are
an error, because squared distances could leave 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, small_side_join

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
BLOCK = 2048  # vectors; distances of a block of 64 components are 2 MB
MOST = 1 << 24
TREE_DEPTH = 3


def _usable(rows: DataFrame) -> DataFrame:
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return rows.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", finite))


def scaled(flat: np.ndarray, width: int) -> np.ndarray:
    """Integer components (part, dimension, vector) of vectors of equal length that lie one behind the other."""
    v = np.floor(flat.astype(np.float64) * SCALE).reshape(-1, width)
    if len(v) and np.abs(v).max() > MOST:
        raise ValueError(f"a component is beyond {MOST // SCALE}")
    per = -(-width // PARTS)
    out = np.zeros((len(v), PARTS * per), np.int64)
    out[:, :width] = v
    return np.ascontiguousarray(out.reshape(len(v), PARTS, per).transpose(1, 2, 0))


def nearest(block: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(part, vector): index of the nearest entry, the least of equals, and its squared distance. books: (part, entry, dimension)."""
    far = np.zeros((PARTS, books.shape[1], block.shape[2]), np.int64)
    for d in range(block.shape[1]):
        step = block[:, d][:, None] - books[:, :, d][:, :, None]
        far += step * step
    at = far.argmin(axis=1)
    return at, np.take_along_axis(far, at[:, None], axis=1)[:, 0]


def tally(total: tuple[np.ndarray, np.ndarray], block: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Adds a block's parts and their number to those of their entries."""
    sums, counts = total
    at, _ = nearest(block, books)
    part = np.broadcast_to(np.arange(PARTS)[:, None], at.shape)
    for d in range(block.shape[1]):
        np.add.at(sums, (part, at, d), block[:, d])
    np.add.at(counts, (part, at), 1)
    return sums, counts


def moved(books: np.ndarray, sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Entries at the floor of their parts' mean; those without parts stay."""
    return np.where(counts[:, :, None] > 0, sums // np.maximum(counts, 1)[:, :, None], books)


def _vectors(batches: Iterator[pa.RecordBatch], width: int, step: int = BLOCK) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for b in batches:
        for at in range(0, b.num_rows, step):
            s = b.slice(at, step)
            yield s, scaled(s.column("embedding").flatten().to_numpy(zero_copy_only=False), width)


def fit(vectors: DataFrame, tmp: Workspace) -> tuple[np.ndarray, int]:
    """Codebooks (part, entry, dimension) of the usable vectors (vec_id, embedding), and the vectors' length."""
    rows = _usable(vectors.select("vec_id", "embedding"))
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(1).collect()
    if not first:
        return np.zeros((PARTS, 0, 0), np.int64), 0
    width = len(first[0]["embedding"])
    rows = rows.where(F.size("embedding") == width)
    start = rows.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(ENTRIES).collect()
    books = np.ascontiguousarray(scaled(np.array([r["embedding"] for r in start]).ravel(), width).transpose(0, 2, 1))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, block in _vectors(batches, width):
            yield pa.RecordBatch.from_arrays([pa.array([block.shape[2]], pa.int64()), pa.array([block.astype("<i4").tobytes()], pa.binary())], ["n", "block"])

    blocks = tmp.write(rows.select("embedding").mapInArrow(packed, "n long, block binary"), "blocks")
    shape = books.shape
    zero = (np.zeros(shape, np.int64), np.zeros(shape[:2], np.int64))
    parts = blocks.rdd.map(lambda r: np.frombuffer(r["block"], "<i4").astype(np.int64).reshape(PARTS, shape[2], r["n"]))
    for _ in range(ROUNDS):
        sums, counts = parts.treeAggregate(zero, lambda t, b, books=books: tally(t, b, books), lambda s, t: (s[0] + t[0], s[1] + t[1]), TREE_DEPTH)
        books = moved(books, sums, counts)
    return books, width


def encode(vectors: DataFrame, books: np.ndarray, width: int) -> DataFrame:
    """The usable rows of length width with code, a binary of PARTS entry numbers, and error, their squared distances."""
    fields = [f for f in vectors.schema if f.name in ("vec_id", "label")]
    keep = [f.name for f in fields]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + ["code binary", "error long"])

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, block in _vectors(batches, width):
            at, far = nearest(block, books)
            codes = np.ascontiguousarray(at.T.astype(np.uint8))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array([r.tobytes() for r in codes], pa.binary()), pa.array(far.sum(axis=0))], [*keep, "code", "error"])

    rows = _usable(vectors.select(*keep, "embedding")).where(F.size("embedding") == width)
    return rows.mapInArrow(coded, schema)


def decode(codes: DataFrame, books: np.ndarray, width: int) -> DataFrame:
    """Adds approx, the vector that a code stands for."""

    def restored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.frombuffer(b"".join(b.column("code").to_pylist()), np.uint8).reshape(-1, PARTS)
            flat = books[np.arange(PARTS), at].reshape(len(at), -1)[:, :width] / SCALE
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(list(flat), pa.list_(pa.float64()))], [*b.schema.names, "approx"])

    return codes.mapInArrow(restored, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in codes.schema) + ", approx array<double>")


def books_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, code, error, label_error, codebooks_sha256) of each usable vector; label_error adds up the errors of a label's rows, those without label together."""
    with Workspace(vectors.sparkSession, "codes") as tmp:
        books, width = fit(vectors, tmp)
        out = encode(vectors, books, width)
        coded = tmp.write(out, "coded", keep=True)
    # a key that is never null, and that differs for null and every label
    keyed = coded.withColumn("__label", F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("")))
    sums = keyed.groupBy("__label").agg(F.sum("error").alias("label_error"))
    return small_side_join(keyed, sums, ["__label"], "inner").select("vec_id", "label", "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))
