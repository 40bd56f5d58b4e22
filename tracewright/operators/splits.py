"""Duplicates, grouping closure, split assignment and leakage audits."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..params import FINGERPRINT_DECIMALS, SPLIT_RATIOS
from .store import Tables

FAN = 4096  # digests in a node of a fingerprint's tree
BUCKETS = 1024  # of scores, in which groups of one size are ranked


def duplicate_groups(df: DataFrame, digest: str, path: str) -> DataFrame:
    """Contents with several paths, the paths in order."""
    return df.where(F.col(digest).isNotNull()).groupBy(digest).agg(F.sort_array(F.collect_list(path)).alias("paths"), F.count("*").alias("n")).where("n > 1")


def canonical_paths(df: DataFrame, digest: str, path: str) -> DataFrame:
    """The least path of each content; a path without digest stands for itself."""
    return df.groupBy(F.coalesce(F.col(digest), F.concat(F.lit("path:"), F.col(path))).alias("content")).agg(F.min(path).alias("path")).select("path")


def payload_digest(text: Column) -> Column:
    """SHA-256 of what follows the first line."""
    return F.sha2(F.when(F.instr(text, F.lit("\n")) > 0, F.substring(text, F.instr(text, F.lit("\n")) + 1, F.length(text))).otherwise(F.lit("")), 256)


def closure(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): nodes that edges connect, named by their least node.

    Each round sends every node to the least node beside it, by hash, and contracts: edges between what is left are fewer by a factor, long chains included, so the work of all rounds is about that of the first. A hub's edges are
    gathered by an aggregate of minima and met in joins that AQE may split. Lineage is cut in every round by a table in the folder that all executors share; only the last one, which the result reads, stays there.
    """
    tables = Tables(edges.sparkSession, "closure")
    named = edges.select(F.col(a).cast("string").alias("u"), F.col(b).cast("string").alias("v")).where("u IS NOT NULL AND v IS NOT NULL")
    tied = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("x"))
    pairs = lambda df: df.where("u != v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    left, at = tables.keep(pairs(named))
    steps, paths = [], []
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("v").alias("u"), F.col("u").alias("v")))
        beside = both.groupBy("u").agg(F.min(tied("v")).alias("m"))
        step, path = tables.keep(beside.select(F.col("u").alias("node"), F.least(tied("u"), F.col("m"))["x"].alias("to")))
        steps.append(step)
        paths.append(path)
        to = lambda c: step.select(F.col("node").alias(c), F.col("to").alias(f"{c}_to"))
        met = left.join(to("u"), "u").join(to("v"), "v")
        before = at
        left, at = tables.keep(pairs(met.select(F.col("u_to").alias("u"), F.col("v_to").alias("v"))))
        tables.drop(before)
    alone = named.select(F.col("u").alias("node")).unionByName(named.select(F.col("v").alias("node"))).distinct().withColumn("root", F.col("node"))
    label = alone
    for step in steps:
        label = label.join(step.select(F.col("node").alias("root"), "to"), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    if steps:
        label, _ = tables.keep(label)
        tables.drop(at, *paths)
    least = label.groupBy("root").agg(F.min("node").alias("component"))
    return label.join(least, "root").select("node", "component")


def group_key(hashes: Column) -> Column:
    """Aggregate: 16 digits of the SHA-256 of a group's distinct hashes in order."""
    return F.substring(F.sha2(F.array_join(F.array_sort(F.collect_set(hashes)), "|"), 256), 1, 16)


def score(key: Column, seed: str) -> Column:
    """A number in [0, 1) from the first 8 bytes of SHA-256(seed:key)."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(seed + ":"), key), 256), 1, 16), 16, 10).cast("decimal(20,0)").cast("double") / F.lit(18446744073709551616.0)


def deal(lack: list[float], n: float, m: int) -> list[tuple[int, int, list[int]]]:
    """Where m groups of n rows each go, one after the other, always to the split that lacks most (of equal ones the first): runs (first, end, cycle of splits). lack is brought up to date.

    Splits that lie within n of each other take turns, in the order of what they lack, until they come down to the next one; so the runs are about twice as many as the splits, however many groups there are.
    """
    if n <= 0:
        return [(0, m, [lack.index(max(lack))])]
    out, done = [], 0
    while done < m:
        order = sorted(range(len(lack)), key=lambda j: (-lack[j], j))
        ahead = lambda x, j, y, k: (-x, j) < (-y, k)
        first = order[0]
        turn = [j for j in order if j == first or not ahead(lack[first] - n, first, lack[j], j)]
        if len(turn) < len(order):
            low, nxt = turn[-1], order[len(turn)]
            rounds = int((lack[low] - lack[nxt]) // n) + 1
            while rounds > 1 and not ahead(lack[low] - (rounds - 1) * n, low, lack[nxt], nxt):
                rounds -= 1
            while ahead(lack[low] - rounds * n, low, lack[nxt], nxt):
                rounds += 1
        else:
            rounds = m
        count = min(m - done, rounds * len(turn))
        out.append((done, done + count, turn))
        for place, j in enumerate(turn):
            lack[j] -= n * (count // len(turn) + (place < count % len(turn)))
        done += count
    return out


def pack(groups: DataFrame, key: str, n_rows: str, ratios: dict[str, float] = SPLIT_RATIOS, seed: str = "tracewright") -> DataFrame:
    """(key, split): the largest groups first, each to the split that lacks most rows; ties by score, then by key, of equal splits by name. Where no group has rows, groups are balanced in their place.

    Which splits groups of one size go to, in which turn, follows from their number, so one task walks the distinct sizes, which are at most about the root of twice the rows, and the groups take their splits by their rank among those of
    their size. Ranks are counted in buckets of the score first, so no task sees all groups of a size.
    """
    if any(v < 0 for v in ratios.values()) or not sum(ratios.values()):
        raise ValueError("ratios must not be negative and must not all be zero")
    names = sorted(ratios)
    shares = [ratios[n] / sum(ratios.values()) for n in names]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lack = None
        for batch in batches:
            out = []
            for n, m, total in zip(*(batch.column(c).to_pylist() for c in ("n", "m", "total")), strict=True):
                lack = [total * share for share in shares] if lack is None else lack
                out += [(n, lo, hi, [names[j] for j in turn]) for lo, hi, turn in deal(lack, n, m)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string())))], ["n", "lo", "hi", "turn"])

    entries = groups.select(F.col(key).cast("string").alias(key), F.coalesce(F.col(n_rows), F.lit(0)).cast("long").alias("n"), score(F.col(key), seed).alias("s"))
    if not groups.agg(F.max(n_rows)).first()[0]:
        entries = entries.withColumn("n", F.lit(1).cast("long"))
    entries = entries.withColumn("b", F.floor(F.col("s") * BUCKETS))
    counts = entries.groupBy("n", "b").agg(F.count("*").alias("m"))
    below = counts.withColumn("before", F.sum("m").over(W.partitionBy("n").orderBy("b")) - F.col("m")).select("n", "b", "before")
    ranked = entries.withColumn("own", F.row_number().over(W.partitionBy("n", "b").orderBy("s", key))).join(below, ["n", "b"]).withColumn("rank", F.col("before") + F.col("own") - 1)
    sizes = counts.groupBy("n").agg(F.sum("m").alias("m")).withColumn("total", F.sum(F.col("n") * F.col("m")).over(W.partitionBy()))  # in the one task that walks them
    runs = sizes.sortWithinPartitions(F.col("n").desc()).mapInArrow(walk, "n long, lo long, hi long, turn array<string>")
    by_size = runs.groupBy("n").agg(F.array_sort(F.collect_list(F.struct("lo", "hi", "turn"))).alias("runs"))
    own = F.element_at(F.filter("runs", lambda r: (r["lo"] <= F.col("rank")) & (F.col("rank") < r["hi"])), 1)
    met = ranked.join(by_size, "n").withColumn("run", own)
    return met.select(key, F.element_at("run.turn", (F.pmod(F.col("rank") - F.col("run.lo"), F.size("run.turn")) + 1).cast("int")).alias("split"))


def leakage(assigned: DataFrame, keys: dict[str, list[str]], split: str = "split") -> DataFrame:
    """(kind, key, splits) for keys of each kind that occur in more than one split."""
    out = None
    for kind, cols in keys.items():
        named = assigned.where(" AND ".join(f"{c} IS NOT NULL" for c in cols)).groupBy(F.concat_ws("|", *cols).alias("key")).agg(F.array_sort(F.collect_set(split)).alias("splits"))
        found = named.where(F.size("splits") > 1).select(F.lit(kind).alias("kind"), "key", F.array_join("splits", ",").alias("splits"))
        out = found if out is None else out.unionByName(found)
    return out


def fingerprint(df: DataFrame, key: list[str], order: list[str], columns: list[str], decimals: int = FINGERPRINT_DECIMALS, fan: int = FAN) -> DataFrame:
    """(key, n, fingerprint): SHA-256 over the rounded values in row order, with the number of rows and the names of the columns before them.

    The hash is a tree: rows are digested, then the digests of up to `fan` rows in order, then those of up to `fan` blocks, and of up to `fan` of these, so no list holds more than fan digests (256 kB) below fan^3 rows (7e10).
    """
    cols = sorted(columns)
    row = F.sha2(F.concat_ws(",", *[F.when(F.col(c).isNotNull(), F.format_string(f"%.{decimals}f", F.round(F.col(c).cast("double"), decimals) + 0.0)).otherwise("") for c in cols]), 256)
    rows = df.select(*key, *order, row.alias("h")).withColumn("i", (F.row_number().over(W.partitionBy(*key).orderBy(*order)) - 1).cast("long")).withColumn("n", F.lit(1).cast("long"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "h"))), lambda x: x["h"]), "")
    for _ in range(2):
        rows = rows.groupBy(*key, F.expr(f"i div {fan}").alias("up")).agg(F.sha2(joined, 256).alias("h"), F.sum("n").alias("n")).withColumnRenamed("up", "i")
    top = rows.groupBy(*key).agg(joined.alias("h"), F.sum("n").alias("n"))
    return top.select(*key, "n", F.sha2(F.concat(F.col("n").cast("string"), F.lit("|" + ",".join(cols) + "|"), "h"), 256).alias("fingerprint"))


def content_audit(assigned: DataFrame, fp: str = "fingerprint", split: str = "split") -> DataFrame:
    """Contents that occur several times, and whether they lie in several splits."""
    g = assigned.groupBy(fp).agg(F.count("*").alias("n"), F.size(F.collect_set(split)).alias("n_splits"))
    return g.where("n > 1").withColumn("violation", F.col("n_splits") > 1)


def top_per(df: DataFrame, by: list[str], *order, k: int = 1) -> DataFrame:
    """The first k rows of each group."""
    return df.withColumn("__rk", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("__rk") <= k).drop("__rk")


def closest_to_median(df: DataFrame, value: str, k: int, *ties: str, digits: int = 4) -> DataFrame:
    """The k rows whose value lies closest to the median of all, distances rounded; equal ones in the order of ties."""
    middle = df.agg(F.median(value)).first()[0]
    return df.orderBy(F.round(F.abs(F.col(value) - F.lit(middle)), digits), *ties).limit(k)


def pair_streams(files: DataFrame, key: list[str], stream: str, path: str) -> DataFrame:
    """Sessions with the file lists of both streams and the first file of each; paired if both are there."""
    of = lambda s: F.when(F.col(stream) == s, F.col(path))
    out = files.groupBy(*key).agg(*[F.sort_array(F.collect_list(of(s))).alias(s) for s in ("smartphone", "vehicle")])
    return out.withColumn("first_smartphone", F.get("smartphone", F.lit(0))).withColumn("first_vehicle", F.get("vehicle", F.lit(0))).withColumn("paired", (F.size("smartphone") > 0) & (F.size("vehicle") > 0))
