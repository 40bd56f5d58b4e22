"""Searches over shifts of one signal against another, from tables of moments.

Counts and sums of products at a lag add up, so a recording is cut into blocks of time: a task reads a block with the rows of the other signal that its lags reach, takes the sums of all lags, and gives out one row for each. Directions and
correlations then follow from the added sums in closed form. A long recording is many blocks, and no task sees all of it.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import params as P
from .asof import bracket
from .timeline import US, _key

BLOCK_S = 300.0
LEAST_SHARE = 1e-12  # of a mean square: a variance below it is what rounding leaves of equal values
CHUNK = 8192  # rows of a block whose lags are held at once


def steps(max_lag_s: float, step_s: float) -> np.ndarray:
    n = int(max_lag_s / step_s)
    return np.arange(-n, n + 1)


def reached(rows: DataFrame, other: DataFrame, key, t: str, order: list[str], value: str, reach_s: float, halo_s: float = 0.0, block_s: float = BLOCK_S) -> DataFrame:
    """Rows of `other` (t, value) that blocks of `rows` need to know its values up to reach_s + halo_s before and after them: (key, block, t, value). The rows next to these spans are among them, however far they lie."""
    k, us, reach = _key(key), int(block_s * US), int((reach_s + halo_s) * US)
    blocks = rows.select(*k, F.floor(F.col(t) / us).cast("bigint").alias("__b")).distinct()
    own = other.where(F.col(t).isNotNull() & F.col(value).isNotNull()).select(*k, t, *order, F.col(value).cast("double").alias(value))
    near = own.select("*", F.explode(F.sequence(F.floor((F.col(t) - reach) / us).cast("bigint"), F.floor((F.col(t) + reach) / us).cast("bigint"))).alias("__b")).join(blocks, [*k, "__b"], "left_semi")
    low, high = F.col("__b") * us - reach, (F.col("__b") + 1) * us + reach
    empty = [F.lit(None).cast(own.schema[o].dataType).alias(o) for o in order]
    # Spans begin and end where one of the two floors steps, so what lies next to one is the first or last row of a pair of floors.
    row, at = F.struct(t, *order, value), F.struct(t, *order)
    outer = own.groupBy(*k, F.floor((F.col(t) + reach) / us), F.floor((F.col(t) - reach) / us)).agg(F.array_distinct(F.array(F.min_by(row, at), F.max_by(row, at))).alias("__r"))
    outer = outer.select(*k, F.explode("__r").alias("__r")).select(*k, "__r.*")
    ends = bracket(blocks.select(*k, "__b", low.alias(t), *empty).unionByName(blocks.select(*k, "__b", high.alias(t), *empty)), outer, key, t, order, value)
    side = F.explode(F.array(F.when(F.col(t) == low, F.col("before")), F.when(F.col(t) == high, F.col("after")))).alias("e")
    beyond = ends.select(*k, "__b", side).where("e IS NOT NULL").select(*k, "__b", F.col("e.t").alias(t), F.col("e.v").alias(value))
    beyond = beyond.where((F.col(t) < low) | (F.col(t) > high))
    return near.select(*k, "__b", t, value).unionByName(beyond).distinct()


def by_block(rows: DataFrame, other: DataFrame, key, t: str, columns: list[str], value: str, run: Callable, sums: list[str], block_s: float = BLOCK_S) -> DataFrame:
    """(key, lag, sums): run(rows of a block, their columns as an array, times and values of the other signal) gives an array (lag, sum), added up over blocks. rows have __b where they belong to other blocks than their time's too."""
    k, us = _key(key), int(block_s * US)
    rows = rows if "__b" in rows.columns else rows.withColumn("__b", F.floor(F.col(t) / us).cast("bigint"))
    left = rows.select(*k, "__b", F.col(t).alias("__t"), *columns, F.lit(None).cast("double").alias("__v"), F.lit(True).alias("__own"))
    right = other.select(*k, "__b", F.col(t).alias("__t"), *[F.lit(None).cast("double").alias(c) for c in columns], F.col(value).alias("__v"), F.lit(False).alias("__own"))
    schema = T.StructType([*[left.schema[c] for c in k], T.StructField("lag", T.IntegerType()), *[T.StructField(s, T.DoubleType()) for s in sums]])

    def table(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__t", kind="stable")
        at = int(pdf["__b"].iloc[0]) * us
        own, far = pdf[pdf["__own"]], pdf[~pdf["__own"]]
        lags, total = run((own["__t"].to_numpy() - at), own[columns].to_numpy(float), far["__t"].to_numpy() - at, far["__v"].to_numpy(float), us)
        out = pd.DataFrame(total, columns=sums)
        out.insert(0, "lag", lags.astype("int32"))
        for c in reversed(k):
            out.insert(0, c, pdf[c].iloc[0])
        return out[out[sums[0]] > 0]

    parts = left.unionByName(right).groupBy(*k, "__b").applyInPandas(table, schema)
    return parts.groupBy(*k, "lag").agg(*[F.sum(s).alias(s) for s in sums])


def shifted(t: np.ndarray, lag_us: int, far_t: np.ndarray, far: np.ndarray) -> np.ndarray:
    """The other signal at t + lag, between its rows and never beyond them."""
    if len(far_t) < 2:
        return np.full(len(t), np.nan)
    return np.interp((t + lag_us).astype(float), far_t.astype(float), far, left=np.nan, right=np.nan)


# Forward direction

HEADING_SUMS = ["n", "s", "ss", *[f"h{a}" for a in "xyz"], *[f"hs{a}" for a in "xyz"], *[f"h{a}{b}" for a, b in ("xx", "xy", "xz", "yy", "yz", "zz")]]


def heading_moments(rows: DataFrame, key, t: str, order: list[str], h: list[str], rate: str, base: str, max_lag_s: float = P.MAX_LAG_SEARCH_S, step_s: float = P.LAG_SEARCH_STEP_S, block_s: float = BLOCK_S) -> DataFrame:
    """(key, lag, HEADING_SUMS): at each lag, in steps of step_s, the moments of h and of the rate read at t + lag, over the rows where base holds and the rate is at least MIN_LONGITUDINAL_ACCEL_MPS2.

    At lag 0 a row's own rate counts, not what lies between its neighbours'.
    """
    lags, step = steps(max_lag_s, step_s), int(round(step_s * US))

    def run(at: np.ndarray, own: np.ndarray, far_t: np.ndarray, far: np.ndarray, _: int) -> tuple[np.ndarray, np.ndarray]:
        total = np.zeros((len(lags), len(HEADING_SUMS)))
        for lo in range(0, len(at), CHUNK):
            x, held = own[lo : lo + CHUNK, :3], own[lo : lo + CHUNK, 3]
            flat = np.column_stack([np.ones(len(x)), x, *[x[:, i] * x[:, j] for i, j in ((0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2))]])
            s = np.stack([held if j == 0 else shifted(at[lo : lo + CHUNK], int(j) * step, far_t, far) for j in lags])
            use = np.abs(s) >= P.MIN_LONGITUDINAL_ACCEL_MPS2  # not a number is no use
            s = np.where(use, s, 0.0)
            plain, by_s = use.astype(float) @ flat, s @ flat[:, :4]
            total += np.column_stack([plain[:, 0], by_s[:, 0], (s * s).sum(axis=1), plain[:, 1:4], by_s[:, 1:4], plain[:, 4:]])
        return lags, total

    good = rows.where(F.col(base))
    far = reached(good, rows, key, t, order, rate, max_lag_s, block_s=block_s)
    return by_block(good, far, key, t, [*h, rate], rate, run, HEADING_SUMS, block_s)


# Residual lag of a track

RATE_SUMS = ["n", "a", "b", "aa", "bb", "ab"]


def _slope(v: np.ndarray, t: np.ndarray) -> np.ndarray:
    out = np.full(len(t), np.nan)
    at = np.flatnonzero(np.isfinite(v))
    if len(at) >= 2:
        out[at] = np.gradient(v[at], t[at] / US)
    return out


def _smoothed(v: np.ndarray, t: np.ndarray, window_us: int) -> np.ndarray:
    start, ok = np.searchsorted(t, t - window_us, side="left"), np.isfinite(v)
    total, count = np.concatenate([[0.0], np.cumsum(np.where(ok, v, 0.0))]), np.concatenate([[0], np.cumsum(ok)])
    n = count[1:] - count[start]
    return np.where(n > 0, (total[1:] - total[start]) / np.maximum(n, 1), np.nan)


def rate_moments(track: DataFrame, reference: DataFrame, key, t: str, speed: str, max_lag_s: float = P.MAX_LAG_SEARCH_S, step_s: float = P.LAG_SEARCH_STEP_S, window_s: float = P.SMOOTHING_WINDOW_S, block_s: float = BLOCK_S) -> DataFrame:
    """(key, lag, RATE_SUMS): moments of the smoothed rates of a track's speed and of a reference's, read at t + lag on the track's times and differentiated there.

    A block's rows come with those whose rates its windows hold and the next one, so rates and windows are those of the whole recording (a segment: the reference isn't known at rows more than a block before their own, so a step that long ends a rate). Of rows at one time the first with a speed counts.
    """
    k, us, window = _key(key), int(block_s * US), int(round(window_s * US))
    lags, step = steps(max_lag_s, step_s), int(round(step_s * US))
    known = track.where(F.col(t).isNotNull() & F.col(speed).isNotNull()).groupBy(*k, t).agg(F.first(speed).cast("double").alias(speed))
    w = W.partitionBy(*k).orderBy(t)
    first = F.floor(F.coalesce(F.lag(t).over(w), F.col(t)) / us)  # the block of the row before needs this one for its last rate
    last = F.floor((F.coalesce(F.lead(t).over(w), F.col(t)) + window) / us)  # blocks whose windows reach the row after need it too
    dealt = known.withColumns({"__home": F.floor(F.col(t) / us).cast("bigint"), "__from": first.cast("bigint"), "__to": last.cast("bigint")}).withColumn("__b", F.explode(F.sequence("__from", "__to")))
    blocks = known.select(*k, F.floor(F.col(t) / us).cast("bigint").alias("__b")).distinct()
    dealt = dealt.join(blocks, [*k, "__b"], "left_semi").withColumn("__mine", (F.col("__home") == F.col("__b")).cast("double"))

    def run(at: np.ndarray, own: np.ndarray, far_t: np.ndarray, far: np.ndarray, _: int) -> tuple[np.ndarray, np.ndarray]:
        mine, a = own[:, 1] > 0, _smoothed(_slope(own[:, 0], at), at, window)
        total = np.zeros((len(lags), len(RATE_SUMS)))
        for i, j in enumerate(lags):
            b = _smoothed(_slope(shifted(at, int(j) * step, far_t, far), at), at, window)
            use = mine & np.isfinite(a) & np.isfinite(b)
            x, y = a[use], b[use]
            total[i] = [len(x), x.sum(), y.sum(), x @ x, y @ y, x @ y]
        return lags, total

    ref = reference.where(F.col(t).isNotNull() & F.col(speed).isNotNull()).groupBy(*k, t).agg(F.first(speed).cast("double").alias(speed))
    far = reached(known, ref, key, t, [], speed, max_lag_s, halo_s=window_s + block_s, block_s=block_s)
    return by_block(dealt, far, key, t, [speed, "__mine"], speed, run, RATE_SUMS, block_s)


def residual_lag(track: DataFrame, reference: DataFrame, key, t: str, speed: str = "speed", max_lag_s: float = P.MAX_LAG_SEARCH_S, step_s: float = P.LAG_SEARCH_STEP_S, least: int = 10, block_s: float = BLOCK_S) -> DataFrame:
    """A row per key of a track: lag_s, correlation, zero_correlation, margin, accepted and at_edge.

    The shift of the reference at which the rate of its speed follows that of the track best. Rates, since a drifting speed is alike at every lag. It counts if its peak is distinct from the median of all lags, high enough and a step away from zero; else the lag is 0.
    """
    k = _key(key)
    m = rate_moments(track, reference, key, t, speed, max_lag_s, step_s, block_s=block_s)
    n = F.col("n")
    spread = lambda s, q: F.greatest(F.col(q) / n - (F.col(s) / n) ** 2, F.lit(0.0))
    r = (F.col("ab") / n - F.col("a") / n * F.col("b") / n) / F.sqrt(spread("a", "aa") * spread("b", "bb"))
    varied = lambda s, q: (F.sqrt(spread(s, q)) >= 1e-12) & (spread(s, q) >= LEAST_SHARE * F.col(q) / n)
    good = (n >= least) & varied("a", "aa") & varied("b", "bb")
    scored = m.where(good).select(*k, "lag", r.alias("r"))
    best = scored.groupBy(*k).agg(F.max(F.struct("r", (-F.col("lag")).alias("first"))).alias("b"), F.median("r").alias("m"), F.max(F.when(F.col("lag") == 0, F.col("r"))).alias("zero_correlation"))
    lag, top = -F.col("b.first") * step_s, F.col("b.r")
    ok = F.coalesce((top - F.col("m") >= P.MIN_LAG_PEAK_MARGIN) & (top >= P.MIN_LAG_CORRELATION) & (F.abs(lag) >= step_s - 1e-9), F.lit(False))
    found = track.select(*k).distinct().join(best, k, "left")
    found = found.select(*k, "b", "m", "zero_correlation", ok.alias("accepted"))
    return found.select(
        *k, F.when(F.col("accepted"), lag).otherwise(0.0).alias("lag_s"), F.when(F.col("accepted"), top).otherwise(F.col("zero_correlation")).alias("correlation"), "zero_correlation", (top - F.col("m")).alias("margin"), "accepted",
        (F.col("accepted") & (F.abs(lag) >= max_lag_s - step_s - 1e-9)).alias("at_edge"),
    )
