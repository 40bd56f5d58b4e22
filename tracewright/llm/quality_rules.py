"""Quality rules: an isolation forest over rule statistics, with a threshold from labelled rows.

A first pass over all whole texts measures the rules (words, symbols, repeated lines and windows, ...). The forest is
fitted on TREES * SUBSAMPLE documents, those with the smallest hashes of their ids and statistics among all, SUBSAMPLE of their own for each tree (drawn again where there are fewer documents), as the
method has it; all else covers every document. A document's anomaly is 2 ** (-mean path length / c), from random splits of SUBSAMPLE rows per
tree. The threshold weighs what all labelled documents would lose, counted in a histogram of SCORE_BINS bins: it is the
highest at which (share of quality 0 rejected) - GOOD_WEIGHT * (share of quality 1 rejected) is at its best.

Defined results: a null or empty text has no words and fails the base rules. A null doc_id is measured
like others; such rows and labels never meet. Repeated rows are judged one by one. If a document has several
labels, it counts as good if any says so. Without labels of both kinds the forest rejects nothing. Empty tables give empty
results. Texts of any length are measured whole. Ties: equal statistics have equal anomalies and verdicts, and documents with the threshold's own anomaly are rejected. Extra columns are not read by the query, and kept by the pipeline stage.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANKS, keep_texts, materialize, slices

#: Fixed by the contract of the base rules.
SYMBOLS, WINDOW, MIN_WORDS, MAX_REPEAT_PERCENT = b"#*$%&|<>", 8, 20, 30

TREES, SUBSAMPLE, SEED = 128, 256, 7
GOOD_WEIGHT, SCORE_BINS = 20.0, 4096
FEATURES = ("mean_word", "symbol_rate", "repeat_rate", "top_word_rate", "same_next_rate", "variety")
_CONTINUATION = bytes(range(0x80, 0xC0))
_MIX = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB], dtype=np.uint64)


def _count(text: bytes, which: bytes) -> int:
    return len(text) - len(text.translate(None, which))


def repeated_words(ids: np.ndarray, n_ids: int) -> int:
    """Words inside windows of WINDOW words that occur twice or more. ids: a number for each word."""
    n = len(ids) - WINDOW + 1
    if n < 2 or n_ids == len(ids):
        return 0
    # A hash of each window first: if no two are equal, no windows are.
    x = (ids.astype(np.uint64) + np.uint64(1)) * _MIX[0]
    x = (x ^ (x >> np.uint64(29))) * _MIX[1]
    h = np.zeros(n, dtype=np.uint64)
    for k in range(WINDOW):
        h = h * _MIX[2] + x[k : k + n]
    s = np.sort(h)
    if not (s[1:] == s[:-1]).any():
        return 0
    # Exact: windows of 1, 2, 4, 8 words get numbers, equal for equal windows.
    rank, span = ids.astype(np.int64), 1
    while span < WINDOW:
        pair = rank[:-span] * np.int64(n_ids + len(ids)) + rank[span:]
        rank = np.unique(pair, return_inverse=True)[1]
        span *= 2
    often = np.bincount(rank)[rank] > 1
    edge = np.zeros(len(ids) + 1, dtype=np.int64)
    at = np.flatnonzero(often)
    edge[at] += 1
    np.subtract.at(edge, at + WINDOW, 1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def measure(text: bytes | None) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, *FEATURES) of a text in UTF-8."""
    text = text or b""
    words = text.split()
    n = len(words)
    if not n:
        return (0, 0, _count(text, SYMBOLS), 0, 0, *[0.0] * len(FEATURES))
    chars = len(text.translate(None, _CONTINUATION + BLANKS))
    symbols = _count(text, SYMBOLS)
    lines = [x for x in text.split(b"\n") if x.strip(BLANKS)]
    dup_lines = len(lines) - len(set(lines))
    seen: dict[bytes, int] = {}
    ids = np.fromiter([seen.setdefault(w, len(seen)) for w in words], dtype=np.int64, count=n)
    repeat = repeated_words(ids, len(seen))
    return (
        n, chars, symbols, dup_lines, repeat,
        min(chars / n, 50.0), symbols / n, repeat / n, float(np.bincount(ids).max()) / n, float((ids[1:] == ids[:-1]).sum()) / n, float(np.log(len(seen) + 1) / np.log(n + 1)),
    )


STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, " + ", ".join(f"{f} double" for f in FEATURES)
_NAMES = [x.split()[0] for x in STATS.split(", ")]


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        cols = list(zip(*[measure(t) for t in batch.column("text").to_pylist()], strict=True)) or [()] * len(_NAMES)
        types = [pa.int64()] * 5 + [pa.float64()] * len(FEATURES)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, t) for c, t in zip(cols, types, strict=True)]], ["doc_id", *_NAMES])


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and STATS of each document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(_measured, f"doc_id long, {STATS}")


class IsolationForest:
    """Trees as arrays, all of one depth: feature, split value, children, path length at leaves."""

    def __init__(self, x: np.ndarray, trees: int = TREES, subsample: int = SUBSAMPLE, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.size = min(subsample, len(x))
        self.depth = max(1, int(np.ceil(np.log2(max(2, self.size)))))
        own = len(x) >= trees * subsample  # rows come in the order of a hash
        self.trees = [self._grow(x[t * subsample : (t + 1) * subsample] if own else x[rng.choice(len(x), self.size, replace=False)], rng) for t in range(trees)]

    @staticmethod
    def mean_path(n: float) -> float:
        """Mean length of an unsuccessful search in a binary search tree of n keys."""
        return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n

    def _grow(self, x: np.ndarray, rng: np.random.Generator):
        feature, value, left, right, length = [], [], [], [], []

        def node(rows: np.ndarray, depth: int) -> int:
            at = len(feature)
            for out in (feature, value, left, right, length):
                out.append(0)
            lo, hi = rows.min(axis=0), rows.max(axis=0)
            open_ = np.flatnonzero(hi > lo)
            if depth >= self.depth or len(rows) < 2 or not len(open_):
                feature[at], left[at], right[at], length[at] = 0, at, at, depth + self.mean_path(len(rows))
                value[at] = np.inf
                return at
            f = int(rng.choice(open_))
            v = rng.uniform(lo[f], hi[f])
            mask = rows[:, f] < v
            feature[at], value[at] = f, v
            left[at], right[at] = node(rows[mask], depth + 1) if mask.any() else node(rows[:1], depth + 1), node(rows[~mask], depth + 1)
            return at

        node(x, 0)
        return tuple(np.array(a) for a in (feature, value, left, right, length))

    def score(self, x: np.ndarray) -> np.ndarray:
        """Anomaly between 0 and 1; more for shorter paths."""
        total, row = np.zeros(len(x)), np.arange(len(x))
        for feature, value, left, right, length in self.trees:
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                at = np.where(x[row, feature[at]] < value[at], left[at], right[at])
            total += length[at]
        return 2.0 ** (-total / len(self.trees) / max(self.mean_path(self.size), 1e-9))


def fit(stats: DataFrame) -> IsolationForest | None:
    """A forest from the documents with the smallest hashes; None for an empty table.

    A bound on the hash lets about four times the rows wanted through, so no more than these are sorted or sent, however many partitions there are.
    """
    want, n = TREES * SUBSAMPLE, stats.count()
    rows = stats.select(*FEATURES, F.xxhash64(F.lit(SEED), "doc_id", *FEATURES).alias("key"))
    if n > 4 * want:
        rows = rows.where(F.col("key") < F.lit(-(1 << 63) + (1 << 64) // n * 4 * want))
    x = rows.orderBy("key", *FEATURES).limit(want).drop("key").toPandas()
    return IsolationForest(x.to_numpy(dtype=float)) if len(x) else None


def score(stats: DataFrame, forest: IsolationForest) -> DataFrame:
    """Adds anomaly. The forest has TREES trees of SUBSAMPLE leaves at most, whatever the input."""
    shared = stats.sparkSession.sparkContext.broadcast(forest)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            x = np.column_stack([b.column(f).to_numpy(zero_copy_only=False) for f in FEATURES]) if b.num_rows else np.zeros((0, len(FEATURES)))
            yield b.append_column("anomaly", pa.array(shared.value.score(x), pa.float64()))

    return stats.mapInArrow(scored, f"doc_id long, {STATS}, anomaly double")


def calibrate(scored: DataFrame, labels: DataFrame) -> float:
    """The threshold from all labelled documents; over 1, so never met, if a kind of label is missing."""
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("good"))
    bins = scored.select("doc_id", F.floor(F.col("anomaly") * SCORE_BINS).cast("int").alias("bin")).join(known, "doc_id").groupBy("bin").pivot("good", [0, 1]).count().na.fill(0).collect()
    count = np.zeros((SCORE_BINS + 2, 2))
    for r in bins:  # SCORE_BINS + 1 rows at most
        count[r["bin"]] += (r["0"], r["1"])
    if not count.sum(axis=0).all():
        return 2.0
    gone = count[::-1].cumsum(axis=0)[::-1] / count.sum(axis=0)
    gain = gone[:, 0] - GOOD_WEIGHT * gone[:, 1]
    return int(np.flatnonzero(gain >= gain.max() - 1e-12)[-1]) / SCORE_BINS


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the base statistics, base_failed, anomaly, kept, a row for each document."""
    spark: SparkSession = docs.sparkSession
    stats = materialize(statistics(docs), "quality-stats")
    forest = fit(stats)
    if forest is None:
        scored, threshold = stats.withColumn("anomaly", F.lit(0.0)), 2.0
    else:
        scored = materialize(score(stats, forest), "quality-scores")
        threshold = calibrate(scored, labels)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return scored.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("anomaly") < threshold))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that judge() keeps, with the columns of docs. Rows are measured and scored in place, so none has to be joined back."""
    spark = docs.sparkSession
    stats = materialize(statistics(docs), "quality-stats")
    forest = fit(stats)
    threshold = 2.0 if forest is None else calibrate(score(stats, forest), labels)
    shared = spark.sparkContext.broadcast(forest)

    def decide(texts: list[bytes | None]) -> list[bool]:
        stats = [measure(t) for t in texts]
        x = np.array([s[5:] for s in stats], dtype=float).reshape(len(stats), len(FEATURES))
        anomaly = shared.value.score(x) if len(stats) else np.zeros(0)
        return [not (s[0] < MIN_WORDS or 100 * s[4] > MAX_REPEAT_PERCENT * s[0]) and a < threshold for s, a in zip(stats, anomaly, strict=True)]

    return keep_texts(docs, decide)
